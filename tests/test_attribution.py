import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sentrymill.operators import attribute as AT
from sentrymill.rules import actors as A

NAMES = [("LockBit", "c", ["LockBit 3.0", "Lock"]), ("Play", "c", ["Play ransomware"]), ("Black Basta", "c", ["BlackBasta"]), ("Øyx", "n", [])]


def brute_force(text, victim_words):
    """Offset search over the whole text of one event."""
    best = None
    for entry, (canonical, kind, aliases) in enumerate(NAMES):
        for at, alias in enumerate([canonical] + aliases):
            for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(alias)}(?![A-Za-z0-9_])", text, re.IGNORECASE):
                o = m.start()
                near = text[max(0, o - 200):o + 200].lower()
                if not any(p in near for p in A.CLAIMED + A.CONFIRMED + A.SUSPECTED):
                    continue
                if len(alias) <= 5 and alias.isalpha() and not re.search(A.ACTOR_CLASS_CONTEXT, text[max(0, o - 30):o + 30], re.I):
                    continue
                if victim_words:
                    scope = text.lower() if len(victim_words) == 1 else near
                    if not victim_words & set(re.findall(r"\w+", scope)):
                        continue
                if re.search(A.HISTORICAL_MARKER, text[max(0, o - 50):o], re.I):
                    continue
                rank = (o, -len(alias), entry, at)
                if best is None or rank < best[0]:
                    status = text[max(0, o - 160):o + 160].lower()
                    label = ("claimed" if any(p in status for p in A.CLAIMED)
                             else "confirmed" if any(p in status for p in A.CONFIRMED) else "suspected")
                    best = (rank, (canonical, kind, label))
                break
    return best and best[1]


PHRASES = ["LockBit 3.0", "lockbit", "Play", "Play ransomware gang", "the Black", "Basta crew", "BlackBasta", "øyx hackers", "Google Play Store",
           "claimed responsibility", "officials confirmed", "linked to", "last year", "Acme Mills", "acme", "Mills", "nothing here", "x" * 90, "Lock gang,",
           "previously,", "has claimed."]


@pytest.mark.parametrize("n_ranges,hot", [(40, 3), (1, 10**6)])
def test_attribution_equals_search_over_joined_text(spark, n_ranges, hot):
    rng = random.Random(n_ranges)
    links, events = [], []
    for event in range(60):
        victim = rng.choice([None, "Acme Mills", "Acme"])
        events.append((event, "incident", victim, None))
        for article in range(rng.randint(1, 9)):
            parts = [" ".join(rng.choice(PHRASES) for _ in range(rng.randint(0, 6))) for _ in range(3)]
            links.append((event, event * 20 + article, *[p or None for p in parts]))
    linked = spark.createDataFrame(links, "event_id bigint, article_id bigint, title string, summary string, content string")
    frame = spark.createDataFrame(events, "event_id bigint, event_signal_type string, victim_org_name string, actor_name string")
    dictionary = spark.createDataFrame([(i, *n) for i, n in enumerate(NAMES)], "position int, canonical string, actor_type string, aliases array<string>")
    for limit in (1000, 3):  # one trie, and several parts
        names = AT.prepare_names(dictionary, limit)
        assert (len(names.parts) > 1) == (limit == 3)
        got = {r["event_id"]: tuple(r)[1:] for r in AT.find_actors(frame, linked, names, n_ranges, hot).collect()}
        want = {}
        for event, _, victim, _ in events:
            texts = [" ".join(p or "" for p in row[2:]) for row in sorted((r for r in links if r[0] == event), key=lambda r: -r[1])]
            hit = brute_force(" ".join(texts), set(re.findall(r"\w+", victim.lower())) if victim else None)
            if hit:
                want[event] = hit
        assert got == want and len(want) > 5


def test_a_text_is_walked_once_for_what_it_mentions(spark, monkeypatch):
    walked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("boolean")
    def counted(texts: pd.Series) -> pd.Series:
        walked.add(len(texts))
        return texts.str.contains("LockBit")

    monkeypatch.setattr(AT, "mentions", lambda text, names: counted(text))
    linked = spark.range(200).selectExpr("id % 50 AS event_id", "id AS article_id", "'LockBit 3.0 claimed it' AS title",
                                         "'s' AS summary", "CAST(NULL AS string) AS content")
    events = spark.range(50).selectExpr("id AS event_id", "'incident' AS event_signal_type", "CAST(NULL AS string) AS victim_org_name",
                                        "CAST(NULL AS string) AS actor_name")
    dictionary = spark.createDataFrame([(0, *NAMES[0])], "position int, canonical string, actor_type string, aliases array<string>")
    found, _ = AT.scanned_occurrences(events, linked, AT.prepare_names(dictionary))
    assert found.select("article_id").distinct().count() == 200 and walked.value == 200
