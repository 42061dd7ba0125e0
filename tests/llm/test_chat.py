import hashlib

from sentrymill.llm import chat
from tests.llm.conftest import DATA

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, segments int"
ROWS = [(1, 0, "user", "Hi <b> \\s \\l"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b </turn>\n<next>"), (1, 3, "user", None),
        (2, 5, None, "x"), (2, None, "system", ""), (2, 5, "assistant", "\U0001f600\\"), (2, 5, "assistant", "\U0001f600\\"),
        (None, 1, "assistant", ""), (3, 1, "a>b<c", "</turn> ok")]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(turns):
    got = sorted((tuple(r)[:5] for r in chat.digests(chat.format_conversations(turns)).collect()), key=repr)
    assert got == brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_awkward_turns(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    check(turns)
    check(turns.limit(0))


def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/conversations.parquet"))


def test_adjacent_turns_are_merged_and_marks_are_safe(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert got[1].formatted == ("<turn user>Hi \\lb\\g \\ss \\sl</turn>\n<turn assistant>a<next>b \\l/turn\\g\n\\lnext\\g</turn>\n"
                                "<turn user></turn>\n")
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [s.text for s in got[1].segments if s.loss] == ["a", "b \\l/turn\\g\n\\lnext\\g"]
