"""A gated recurrent language model in numpy with a softmax factored by classes.

Words are numbered by frequency and a class is a block of CLASS_SIZE neighbouring numbers, so
P(word | state) = P(class | state) * P(word | class, state) costs two short softmaxes.  All
parameters are views of one flat vector, which is what tasks exchange.

Both training and scoring read lanes: columns of a matrix (steps, lanes) of token numbers,
each a row of texts that end with END.  The state is carried from window to window and set
to zero after END, so a text is read from its first to its last token as one sequence, and
only gradients stop at the edges of a window (truncated backpropagation).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

END, UNKNOWN = 0, 1
CLASS_SIZE, CLASSES = 40, 40
VOCABULARY = CLASS_SIZE * CLASSES
STATE = 16
WINDOW = 16
LANES = 256
LEAST_STEPS = 64
RATE, CLIP = 0.01, 1.0
# Weights and biases of the softmaxes stay within these, so no logit passes 2 * STATE + 20 and exp() never overflows.
MOST_WEIGHT, LEAST_BIAS, MOST_BIAS = 2.0, -40.0, 20.0

_SHAPES = {
    "embed": (VOCABULARY, STATE), "input": (STATE, 3 * STATE), "recur": (STATE, 3 * STATE), "gate_bias": (3 * STATE,),
    "to_class": (STATE, CLASSES), "class_bias": (CLASSES,), "to_word": (CLASSES, STATE, CLASS_SIZE), "word_bias": (CLASSES, CLASS_SIZE),
}
PARAMETERS = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def initial(counts: np.ndarray) -> np.ndarray:
    """Parameters that give every word its share of `counts` (one per number; 0: the number is not in use)."""
    flat = np.zeros(PARAMETERS, np.float32)
    rng, own = np.random.default_rng(7), views(flat)
    for name in ("embed", "input", "recur"):
        own[name][...] = rng.normal(0, 0.3 if name != "embed" else 0.5, own[name].shape)
    by_class = counts.reshape(CLASSES, CLASS_SIZE).astype(np.float64)
    total = by_class.sum(axis=1)
    # Numbers that are not in use get a chance of about e ** -30.
    own["class_bias"][...] = np.where(total > 0, np.log(np.maximum(total, 1) / max(total.sum(), 1)), -30)
    own["word_bias"][...] = np.where(by_class > 0, np.log(np.maximum(by_class, 1) / np.maximum(total, 1)[:, None]), -30)
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of bounded logits, in place, and the logs of its sums."""
    e = np.exp(x, out=x)
    total = e @ np.ones(e.shape[1], np.float32)
    return e, total


@dataclass
class Window:
    """What a forward pass leaves for the backward pass."""
    before: np.ndarray
    states: np.ndarray
    update: np.ndarray
    reset: np.ndarray
    fresh: np.ndarray
    recurred: np.ndarray


class Model:
    """The network over one flat vector."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.own = flat, views(flat)

    def read(self, previous: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, Window]:
        """States (steps, lanes, STATE) after the previous tokens."""
        p, (steps, lanes) = self.own, previous.shape
        fed = (p["embed"] @ p["input"] + p["gate_bias"])[previous] if previous.size > 4 * VOCABULARY else (
            p["embed"][previous] @ p["input"] + p["gate_bias"])
        keep = (previous != END).astype(np.float32)[:, :, None]
        out = Window(*(np.empty((steps, lanes, STATE), np.float32) for _ in range(6)))
        for t in range(steps):
            h = np.multiply(state, keep[t], out=out.before[t])
            g = h @ p["recur"]
            gates = _sigmoid(fed[t, :, :2 * STATE] + g[:, :2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            n = np.tanh(fed[t, :, 2 * STATE:] + r * g[:, 2 * STATE:])
            state = np.add(h, z * (n - h), out=out.states[t])
            out.update[t], out.reset[t], out.fresh[t], out.recurred[t] = z, r, n, g[:, 2 * STATE:]
        return state, out

    def log_chances(self, states: np.ndarray, tokens: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Natural log of the chance of each token after its state.

        With `grads` the gradients of the negative sum are added there, and those of the states are returned instead.
        """
        p = self.own
        order = np.argsort(tokens, kind="stable")
        tokens, states = tokens[order], states[order]
        classes, words, rows = tokens // CLASS_SIZE, tokens % CLASS_SIZE, np.arange(len(tokens))
        e, total = _softmax(states @ p["to_class"] + p["class_bias"])
        edges = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()
        blocks = [(c, low, high) for c, (low, high) in enumerate(zip(edges, edges[1:])) if low < high]
        out = np.empty(len(tokens), np.float32) if grads is None else np.empty_like(states)
        if grads is None:
            chances = e[rows, classes] / total
            for c, low, high in blocks:
                e, total = _softmax(states[low:high] @ p["to_word"][c] + p["word_bias"][c])
                chances[low:high] *= e[rows[:high - low], words[low:high]] / total
            out[order] = np.log(chances)
            return out
        # The gradient of a softmax is its chances less the token itself; the chances are divided by their sums on the
        # narrow side of each product, and the tokens themselves, which are sorted, are taken off all at once.
        back = np.empty_like(states)
        scale = 1 / total
        grads["to_class"] += (states * scale[:, None]).T @ e
        grads["class_bias"] += scale @ e
        np.multiply(e @ p["to_class"].T, scale[:, None], out=back)
        for c, low, high in blocks:
            e, total = _softmax(states[low:high] @ p["to_word"][c] + p["word_bias"][c])
            scale = 1 / total
            grads["to_word"][c] += (states[low:high] * scale[:, None]).T @ e
            grads["word_bias"][c] += scale @ e
            back[low:high] += (e @ p["to_word"][c].T) * scale[:, None]
        back -= p["to_class"].T[classes]
        back -= p["to_word"].transpose(0, 2, 1)[classes, words]
        for found, weights, bias in ((classes, "to_class", "class_bias"), (tokens, "to_word", "word_bias")):
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            sums, number = np.add.reduceat(states, first, axis=0), np.diff(np.append(first, len(found)))
            if weights == "to_class":
                grads[weights][:, found[first]] -= sums.T
                grads[bias][found[first]] -= number
            else:
                grads[weights][classes[first], :, words[first]] -= sums
                grads[bias][classes[first], words[first]] -= number
        out[order] = back
        return out

    def backward(self, previous: np.ndarray, seen: Window, d_states: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Gradients through the gates, back to the start of the window."""
        p, (steps, lanes) = self.own, previous.shape
        keep = (previous != END).astype(np.float32)[:, :, None]
        z, r, n = seen.update, seen.reset, seen.fresh
        to_fresh, to_update, to_reset, stay = z * (1 - n * n), (n - seen.before) * z * (1 - z), seen.recurred * r * (1 - r), (1 - z) * keep
        d_gates = np.empty((steps, lanes, 3 * STATE), np.float32)  # of what comes back from the state; the last third times r
        d_fresh = np.empty((steps, lanes, STATE), np.float32)
        d = np.zeros((lanes, STATE), np.float32)
        recur_t = np.ascontiguousarray(p["recur"].T)
        for t in range(steps - 1, -1, -1):
            d += d_states[t]
            dn = np.multiply(d, to_fresh[t], out=d_fresh[t])
            g = d_gates[t]
            np.multiply(d, to_update[t], out=g[:, :STATE])
            np.multiply(dn, to_reset[t], out=g[:, STATE:2 * STATE])
            np.multiply(dn, r[t], out=g[:, 2 * STATE:])
            d *= stay[t]
            d += (g @ recur_t) * keep[t]
        flat_recur = d_gates.reshape(-1, 3 * STATE)
        grads["recur"] += seen.before.reshape(-1, STATE).T @ flat_recur
        d_gates[:, :, 2 * STATE:] = d_fresh
        grads["gate_bias"] += np.ones(len(flat_recur), np.float32) @ flat_recur
        fed = p["embed"][previous.reshape(-1)]
        grads["input"] += fed.T @ flat_recur
        d_fed = flat_recur @ p["input"].T
        # Rows of equal tokens are summed by sorting, which is faster than adding them one by one.
        order = np.argsort(previous.reshape(-1), kind="stable")
        tokens = previous.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        grads["embed"][tokens[first]] += np.add.reduceat(d_fed[order], first, axis=0)


def lanes_of(tokens: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sequence cut into lanes of equal length: tokens, tokens before them, and which are real (steps, lanes)."""
    steps = -(-len(tokens) // lanes)
    def cut(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([x, np.zeros(steps * lanes - len(x), x.dtype)]).reshape(lanes, steps).T)
    return cut(tokens), cut(np.concatenate([[END], tokens[:-1]])), cut(np.ones(len(tokens), bool))


def train(flat: np.ndarray, tokens: np.ndarray, lanes: int = LANES, rate: float = RATE) -> np.ndarray:
    """Parameters after one pass over a sequence of texts, each ending with END, by Adam.

    A short sequence gets fewer lanes, so that it still makes LEAST_STEPS steps.
    """
    model = Model(flat.copy())
    lanes = int(max(1, min(lanes, len(tokens) // (LEAST_STEPS * WINDOW))))
    now, before, real = lanes_of(tokens.astype(np.int32), lanes)
    gradient = np.zeros(PARAMETERS, np.float32)
    grads = views(gradient)
    mean, square = np.zeros(PARAMETERS, np.float32), np.zeros(PARAMETERS, np.float32)
    state = np.zeros((lanes, STATE), np.float32)
    for k, start in enumerate(range(0, len(now), WINDOW)):
        previous, own, mask = before[start:start + WINDOW], now[start:start + WINDOW], real[start:start + WINDOW]
        gradient[:] = 0
        state, seen = model.read(previous, state)
        d_states = np.zeros((own.size, STATE), np.float32)
        at = np.flatnonzero(mask.reshape(-1))
        d_states[at] = model.log_chances(seen.states.reshape(-1, STATE)[at], own.reshape(-1)[at], grads)
        model.backward(previous, seen, d_states.reshape(seen.states.shape), grads)
        gradient /= max(len(at), 1)
        size = float(np.sqrt(np.dot(gradient, gradient)))
        if size > CLIP:
            gradient *= np.float32(CLIP / size)
        # Adam, in place.
        mean += np.float32(0.1) * (gradient - mean)
        square += np.float32(0.01) * (gradient * gradient - square)
        step = rate * np.sqrt(1 - 0.99 ** (k + 1)) / (1 - 0.9 ** (k + 1))
        model.flat -= np.float32(step) * mean / (np.sqrt(square) + np.float32(1e-6))
        for name in ("to_class", "to_word"):
            np.clip(model.own[name], -MOST_WEIGHT, MOST_WEIGHT, out=model.own[name])
        for name in ("class_bias", "word_bias"):
            np.clip(model.own[name], LEAST_BIAS, MOST_BIAS, out=model.own[name])
    return model.flat


def score(flat: np.ndarray, texts: list[np.ndarray], lanes: int = 2 * LANES) -> np.ndarray:
    """Natural log of the chance of each whole text; every text ends with END."""
    model = Model(flat)
    lengths = np.array([len(t) for t in texts], np.int64)
    if not len(lengths):
        return np.zeros(0)
    # Texts in order of length, longest first, each behind the others in the lane that is shortest so far.
    lanes = int(max(1, min(lanes, len(texts), lengths.sum() // lengths.max() + 1)))
    filled = np.zeros(lanes, np.int64)
    lane, place = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    shortest = [(0, x) for x in range(lanes)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        place[i], lane[i] = shortest[0]
        heapq.heapreplace(shortest, (int(place[i] + lengths[i]), int(lane[i])))
    for length, x in shortest:
        filled[x] = length
    steps = int(filled.max())
    now = np.zeros((lanes, steps), np.int32)
    for i, text in enumerate(texts):
        now[lane[i], place[i]:place[i] + len(text)] = text
    before = np.concatenate([np.full((lanes, 1), END, np.int32), now[:, :-1]], axis=1).T.copy()
    ordered = np.argsort(-filled, kind="stable")
    now, before, sizes = now.T[:, ordered].copy(), before[:, ordered], filled[ordered]
    logs = np.zeros((steps, lanes), np.float32)
    state = np.zeros((lanes, STATE), np.float32)
    window = max(WINDOW, 16384 // lanes)
    for start in range(0, steps, window):
        busy = int(np.searchsorted(-sizes, -start, "left"))  # lanes that go on
        own, stop = now[start:start + window, :busy], min(start + window, steps)
        state, seen = model.read(before[start:stop, :busy], state[:busy])
        found = model.log_chances(seen.states.reshape(-1, STATE), own.reshape(-1))
        logs[start:stop, :busy] = found.reshape(own.shape)
    position = np.empty(lanes, np.int64)
    position[ordered] = np.arange(lanes)
    return np.array([logs[p:p + n, position[x]].sum(dtype=np.float64) for x, p, n in zip(lane.tolist(), place.tolist(), lengths.tolist(), strict=True)])
