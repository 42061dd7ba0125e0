"""A small HTML tree builder: implied tags, raw text elements, visibility.

Only what decides the visible text is kept of a page: element names, a few
attributes, text in order.  Built in one pass over the source, in linear time, and
never deeper than MAX_DEPTH: elements nested deeper become siblings there, so no text
is lost.  They stay open as on the page and know what they stood in, so each text is
as visible as it was.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

MAX_DEPTH = 128

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())  # no markup and no character references inside
ESCAPABLE_RAW = frozenset("title textarea".split())  # no markup inside
HIDDEN = frozenset("head script style template title iframe noembed noframes datalist audio video canvas object param source track".split())
# Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section search summary table ul li dd dt xmp plaintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tag: open elements it ends, and elements at which the search for them stops.
_TABLE = frozenset(["table"])
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
# An end tag does not reach out of these.
BARRIERS = frozenset("html table td th caption template object".split())
IN_TABLE = frozenset("table tbody thead tfoot tr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())

_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"?|'[^']*+'?|[^\s>"'][^\s>]*+)?)?)*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
# Values of display; one of them counts only if all its words are known.
DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid flow flow-root list-item contents table inline-table table-row "
    "table-cell table-caption table-column table-column-group table-header-group table-footer-group table-row-group ruby run-in "
    "-webkit-box -webkit-inline-box -webkit-flex inherit initial unset revert revert-layer".split())
VISIBILITIES = frozenset("visible hidden collapse inherit initial unset revert revert-layer".split())
_COMPOUND = re.compile(r"(\*|[\w-]+)?((?:[.#][\w-]+)*)")
_BRACE = re.compile(r"[{}]")
_STRING = re.compile(r""""[^"\n]*"|'[^'\n]*'""")
# Media of a page on a screen; blocks with other conditions are taken as not valid.
_SCREEN = re.compile(r"(?:only\s+)?(?:screen|all)|not\s+(?:print|speech)")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings
    outer: Node | None = None  # what it stands in on the page
    gone: bool | None = None  # whether it and all in it has no place on the page, once worked out
    shown: bool = True  # whether its own text is visible


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if source and not source.isspace():
        for name, *values in _ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), html.unescape(values[0] or values[1] or values[2]))
    return found


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for any screen."""
    return not media.strip() or any(_SCREEN.fullmatch(m.strip().lower()) for m in media.split(","))


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on any screen."""
    sheet = _STRING.sub("", _COMMENT.sub("", sheet))
    blocks: list[tuple[str | None, bool]] = []  # selectors, or None for an at-block; whether it holds
    start = 0
    for found in _BRACE.finditer(sheet):
        before, start = sheet[start:found.start()], found.end()
        if found.group() == "{":
            opening, holds = before.rsplit(";", 1)[-1].strip(), not blocks or blocks[-1][1]
            if opening.startswith("@"):
                name, _, rest = opening[1:].partition(" ")
                blocks.append((None, holds and (name.lower() == "layer" or (name.lower() == "media" and on_screen(rest)))))
            else:
                blocks.append((opening, holds and all(s is None for s, _ in blocks)))
        elif blocks:
            selectors, holds = blocks.pop()
            if holds and selectors is not None:
                yield selectors, before


def declarations(rule: str) -> Iterator[tuple[str, str, bool]]:
    """Valid declarations of display and visibility: property, value, whether it is important."""
    for part in rule.lower().split(";"):
        name, _, value = part.partition(":")
        name = name.strip()
        if name in ("display", "visibility"):
            value, mark, word = value.partition("!")
            words = value.split()
            known = DISPLAYS if name == "display" else VISIBILITIES
            if words and all(w in known for w in words) and (name == "display" or len(words) == 1) and (not mark or word.strip() == "important"):
                yield name, " ".join(words), bool(mark)


class Styles:
    """What sheets and style attributes say of display and visibility.

    Selectors are tags, classes and ids and what is compounded of them; others are passed over.  Important
    declarations go before others, then style attributes before sheets, then the more specific selector, then the
    later one.  Attributes like `hidden` count only where no declaration of display does.
    """

    def __init__(self) -> None:
        # tag, class or id: (tag, ids, classes): property: (important, order, value)
        self.rules: dict[str, dict[tuple, dict[str, tuple[bool, int, str]]]] = {}
        self.count = 0

    def read(self, sheet: str) -> None:
        lower = sheet.lower()
        if "display" not in lower and "visibility" not in lower:
            return
        for selectors, rule in style_rules(sheet):
            for name, value, important in declarations(rule):
                self.count += 1
                for selector in selectors.split(","):
                    found = _COMPOUND.fullmatch(selector.strip())
                    if found and found.group():
                        self._add(found.group(1), re.findall(r"[.#][\w-]+", found.group(2)), name, (important, self.count, value))

    def _add(self, tag: str | None, parts: list[str], name: str, said: tuple[bool, int, str]) -> None:
        tag = "" if tag in (None, "*") else tag.lower()
        ids, classes = (tuple(sorted({p[1:] for p in parts if p[0] == sign})) for sign in "#.")
        key = f"#{ids[-1]}" if ids else f".{classes[-1]}" if classes else tag
        held = self.rules.setdefault(key, {}).setdefault((tag, ids, classes), {})
        held[name] = max(held.get(name, said), said)

    def _declared(self, node: Node) -> dict[str, str]:
        """The declarations that count for an element itself."""
        own, best = node.attributes, {}
        if self.rules:
            classes = set(own.get("class", "").split())
            for key in (f"#{own['id']}" if "id" in own else None, *(f".{c}" for c in classes), node.tag, ""):
                for (tag, ids, all_of), said in self.rules.get(key, {}).items():
                    if (not tag or tag == node.tag) and all(i == own.get("id") for i in ids) and classes.issuperset(all_of):
                        for name, (important, order, value) in said.items():
                            rank = important, False, (len(ids), len(all_of), bool(tag)), order
                            if name not in best or best[name][0] < rank:
                                best[name] = rank, value
        if "style" in own:
            for order, (name, value, important) in enumerate(declarations(_STRING.sub("", _COMMENT.sub("", own["style"])))):
                rank = important, True, (), order
                if name not in best or best[name][0] < rank:
                    best[name] = rank, value
        return {name: value for name, (_, value) in best.items()}

    def gone(self, node: Node) -> bool:
        """Whether an element has no place on the page; then also sets `shown`."""
        chain = []
        while node.gone is None:
            chain.append(node)
            if node.outer is None:
                break
            node = node.outer
        gone, shown = bool(node.gone), node.shown
        for own in reversed(chain):
            display, visibility = self._own(own)
            shown = shown if visibility is None else visibility
            gone = gone or not display
            own.gone, own.shown = gone, shown
        return gone

    def _own(self, node: Node) -> tuple[bool, bool | None]:
        """Whether an element by itself has a place, and whether its text is visible (None: as in its parent)."""
        if node.tag in HIDDEN or (node.tag == "input" and node.attributes.get("type", "").lower() == "hidden"):
            return False, None
        declared = self._declared(node) if self.rules or node.attributes else {}
        display, visibility = declared.get("display"), declared.get("visibility")
        if display in (None, "revert", "revert-layer"):
            place = "hidden" not in node.attributes and not (node.tag == "dialog" and "open" not in node.attributes)
        else:
            place = display != "none"
        if visibility == "collapse" and node.tag in ("tr", "tbody", "thead", "tfoot"):
            place = False
        return place, {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(visibility)


class Builder:
    """Open elements in `stack`, of any depth; the last one takes what comes."""

    def __init__(self) -> None:
        self.root = Node("html", gone=False)  # pages that hide themselves until a script runs are shown
        self.stack = [self.root]
        self.styles = Styles()
        self.places: dict[str, list[int]] = {}  # where open elements of a tag stand in the stack
        self.barriers: list[int] = []
        self.blocks: list[int] = []

    def _take(self, child: Node | str) -> None:
        """Adds to the last open element; beyond MAX_DEPTH to what goes on with it after its last sibling."""
        top = self.stack[-1]
        if isinstance(child, Node):
            child.outer = top
        if len(self.stack) >= MAX_DEPTH:
            siblings = self.stack[MAX_DEPTH - 2].children
            if siblings[-1] is not top:
                top = Node("span", outer=top)
                siblings.append(top)
        top.children.append(child)

    def text(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip():
            self._close(len(self.stack) - 1)  # text implies the body
        top = self.stack[-1]
        if top.tag in IN_TABLE and not data.isspace():
            # Text straight in a table stands before the table.
            at = self._last("table")
            if at > 0:
                if at < MAX_DEPTH:
                    self.stack[at - 1].children.insert(-1, data)
                else:
                    self.stack[MAX_DEPTH - 2].children.insert(-1, Node("span", children=[data], outer=self.stack[at - 1]))
                return
        self._take(data)

    def _last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def _close(self, count: int) -> None:
        while len(self.stack) > count:
            at = len(self.stack) - 1
            self.places[self.stack.pop().tag].pop()
            for held in (self.barriers, self.blocks):
                if held and held[-1] == at:
                    held.pop()

    def _end(self, tags: frozenset[str], barriers: frozenset[str]) -> None:
        """Ends the outermost open element among `tags` above a barrier."""
        if not any(self.places.get(t) for t in tags):
            return
        least = max((self._last(b) for b in barriers), default=-1)
        cuts = [found[i] for t in tags if (found := self.places.get(t)) and (i := bisect_right(found, least)) < len(found)]
        if cuts:
            self._close(min(cuts))

    def start(self, tag: str, source: str) -> None:
        if tag == "html":
            return
        if tag == "body" or (tag not in IN_HEAD and tag != "head" and any(n.tag == "head" for n in self.stack[1:2])):
            self._end(frozenset(["head"]), frozenset())
        if tag in ("body", "head") and any(n.tag == tag for n in self.stack[1:2]):
            return
        if tag in ENDS_P:
            self._end(frozenset(["p"]), BARRIERS | {"button"})
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self._close(len(self.stack) - 1)
        if tag in IMPLIED_END:
            self._end(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._open(Node("tr"))
        node = Node(tag, attributes(source))
        if tag in VOID:
            self._take(node)
        else:
            self._open(node)

    def _open(self, node: Node) -> None:
        at = len(self.stack)
        node.outer = self.stack[-1]
        if at < MAX_DEPTH:
            self.stack[-1].children.append(node)
        else:
            self.stack[MAX_DEPTH - 2].children.append(node)  # a sibling instead of a child
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BARRIERS:
            self.barriers.append(at)
        if node.tag in ENDS_P:
            self.blocks.append(at)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        if tag in ("html", "body") or tag in VOID:
            return
        found = max(map(self._last, HEADINGS)) if tag in HEADINGS else self._last(tag)
        stops = [] if tag in IN_TABLE else self.barriers[-1:]
        if tag in INLINE:
            stops = stops + self.blocks[-1:]  # an inline end tag does not end the block it stands in
        if found > 0 and all(found >= at for at in stops):
            self._close(found)
        elif tag == "p" and not stops:
            self._take(Node("p"))


INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong "
                   "sub sup time tt u var".split())


def build(source: str) -> tuple[Node, Styles]:
    """The tree of a page, and what its style sheets say."""
    builder, at, size = Builder(), 0, len(source)
    lower = None
    while at < size:
        found = _TAG.search(source, at)
        begin = found.start() if found else size
        if begin > at:
            data = source[at:begin]
            builder.text(html.unescape(data) if "&" in data else data)
        if not found:
            break
        at = found.end()
        tag = found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if found.group(1):
            builder.end(tag)
            continue
        builder.start(tag, found.group(3))
        if tag in RAW or tag in ESCAPABLE_RAW:
            lower = source.lower() if lower is None else lower
            # Lower-casing can change the length of some letters; then search without it.
            stop = lower.find(f"</{tag}", at) if len(lower) == size else _find_end(source, tag, at)
            stop = size if stop < 0 else stop
            data = source[at:stop]
            if tag == "style":
                if on_screen(attributes(found.group(3)).get("media", "")):
                    builder.styles.read(data)
            elif tag == "xmp" or tag == "textarea":
                builder.text(data if tag == "xmp" else html.unescape(data))
            at = stop
    return builder.root, builder.styles


def _find_end(source: str, tag: str, at: int) -> int:
    found = re.compile(f"</{tag}", re.I).search(source, at)
    return found.start() if found else -1
