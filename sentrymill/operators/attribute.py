"""Actor attribution: dictionary names near attribution language.

The text of an event is the text of all its articles, newest first.  It is never
put together: each article that holds a name gets the few characters around it
that the windows can reach, so a huge event stays a set of rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import any_substring, matches
from ..functions.name_filter import PROBES, NameFilter, bits_for, name_marks
from ..functions.name_trie import NameTrie
from ..rules import actors as A
from ..sources.actors import actor_names
from .merge import final_high_impact
from .spread import HOT_ROWS, dealt, join_unique, neighbour_text, staged

# Names in one trie.  Of a longer dictionary tasks hold bitmaps of bounded size, and a text is still read once.
PART_NAMES = 50_000
HELD_TRIES = 8


def article_text(title: Column, summary: Column, content: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, summary, content)])


def word_set(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def alias_needs_context(alias: Column) -> Column:
    """Short single words are common words and need an actor class next to them."""
    return (F.length(alias) <= A.SHORT_ALIAS_CHARS) & F.rlike(alias, F.lit(r"^[\p{L}-]*\p{L}[\p{L}-]*$"))


@dataclass
class Names:
    """Dictionary names and how texts are looked through for them, and the figures the scan has to know in advance.

    parts: the names themselves under the key of their trie; or, of a long dictionary, bitmaps by number of units.
    """
    table: DataFrame
    parts: list[tuple[str, list[str]]] | list[tuple[int, bytes]]
    longest: int
    filtered: bool = False


def prepare_names(dictionary: DataFrame, part_names: int = PART_NAMES) -> Names:
    """Up to `part_names` names are a list that goes to every task; of more, bitmaps of bounded size do."""
    names = actor_names(dictionary)
    stats = names.agg(F.count("*").alias("n"), F.max("alias_chars").alias("longest")).first()
    keyed, longest = names.withColumn("name_key", F.lower("alias")), stats["longest"] or 0
    if stats["n"] <= part_names:
        listed = keyed.select("name_key").distinct().collect()
        return Names(keyed, [(uuid.uuid4().hex, sorted(r[0] for r in listed if r[0]))], longest)
    return _filtered_names(keyed, longest)


def _filtered_names(keyed: DataFrame, longest: int) -> Names:
    c = F.col
    two = "array<bigint>"

    @F.pandas_udf(f"name_key string, units int, marks {two}, first {two}")
    def marked(texts: pd.Series) -> pd.DataFrame:
        keys, units, marks, first = name_marks(texts.fillna("").tolist())
        return pd.DataFrame({"name_key": keys, "units": units, "marks": list(zip(*map(list, marks))), "first": list(zip(*map(list, first)))})

    known = staged(keyed.withColumn("_m", marked("name_key")).drop("name_key").select("*", "_m.*").drop("_m").filter("units > 0"), "names")
    runs = known.select("units", "marks").union(known.select(F.lit(0), "first")).distinct()
    bits = {r["units"]: bits_for(r["n"]) for r in runs.groupBy("units").agg(F.count("*").alias("n")).collect()}
    mask = F.element_at(F.create_map(*[F.lit(x) for n, b in bits.items() for x in (n, (1 << b) - 1)]), c("units"))
    slots = F.array(*[F.shiftright(F.get("marks", F.lit(k)), shift).bitwiseAND(mask.cast("bigint")) for k, shift in PROBES])
    rows = runs.select("units", F.explode(slots).alias("at")).select("units", (c("at") + 1).alias("slot"))
    pieces = rows.groupBy("units", F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")).collect()  # at most 16 MB for each number of units
    bitmaps = {n: bytearray((1 << b) // 8) for n, b in bits.items()}
    for piece in pieces:
        at = (piece["bucket"] - 1) * len(piece["bitmap"])
        bitmaps[piece["units"]][at:at + len(piece["bitmap"])] = piece["bitmap"]
    return Names(known.drop("units", "marks", "first"), [(n, bytes(b)) for n, b in sorted(bitmaps.items())], longest, True)


_LISTS: dict[str, list[str]] = {}


@lru_cache(maxsize=HELD_TRIES)
def _trie(key: str) -> NameTrie:
    """One per worker and dictionary."""
    return NameTrie(_LISTS[key])


def _part_trie(part: tuple[str, list[str]]) -> NameTrie:
    key, names = part
    _LISTS[key] = names
    try:
        return _trie(key)
    finally:
        del _LISTS[key]


def mentions(text: Column, names: Names) -> Column:
    """Whether a name occurs in the text or begins at its end and may go on in the next one.

    Of a long dictionary it may be that none does.
    """
    parts, filtered = names.parts, names.filtered

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        walker = NameFilter(dict(parts)) if filtered else _part_trie(parts[0])
        found, _, _, unfinished = walker.walk(texts.tolist())
        unfinished[found] = True
        return pd.Series(unfinished)
    return test(text)


def name_places(text: Column, names: Names) -> Column:
    """Array of (at, name_key): where names begin, counted from 0.

    Of a long dictionary these are candidates; a join with the names by name_key leaves the names.
    """
    parts, filtered = names.parts, names.filtered

    @F.pandas_udf("array<struct<at:int,name_key:string>>")
    def find(texts: pd.Series) -> pd.Series:
        hits: list[list[dict]] = [[] for _ in range(len(texts))]
        walker = NameFilter(dict(parts)) if filtered else _part_trie(parts[0])
        text_of, at, name, _ = walker.walk(texts.tolist())
        keys = name if filtered else [parts[0][1][n] for n in name.tolist()]
        for t, a, key in zip(text_of.tolist(), at.tolist(), keys):
            hits[t].append({"at": a, "name_key": key})
        return pd.Series(hits)
    return find(text)


def occurrences(docs: DataFrame, names: Names) -> DataFrame:
    """Every occurrence of a name that starts inside an article.

    `docs` has event_id, article_id, doc_text, before_text and after_text.  A row keeps the
    text that the widest window reaches (`around`), the place of the name in it and its
    offset in the article.
    """
    c = F.col
    reach = max(A.PHRASE_WINDOW, A.STATUS_WINDOW, A.SHORT_ALIAS_WINDOW, A.HISTORY_WINDOW)
    padded = docs.withColumns({
        "padded_text": F.concat_ws(" ", "before_text", "doc_text", "after_text"),
        "own_start": F.coalesce(F.length("before_text") + 1, F.lit(0)),
        "own_chars": F.length("doc_text"),
    }).drop("before_text", "after_text", "doc_text")
    hits = padded.withColumn("hit", F.explode(name_places(c("padded_text"), names)))
    own = hits.filter((c("hit.at") >= c("own_start")) & (c("hit.at") < c("own_start") + c("own_chars")))
    start = F.greatest(c("hit.at") - reach, F.lit(0))
    cut = own.withColumns({
        "around": F.substr(c("padded_text"), start + 1, c("hit.at") + reach - start), "place": c("hit.at") - start,
        "offset": c("hit.at") - c("own_start"), "name_key": c("hit.name_key"),
    }).drop("padded_text", "own_start", "own_chars", "hit")
    return cut.join(names.table, "name_key").drop("name_key")


def window_text(before: int, after: int) -> Column:
    """Text from `before` characters in front of an occurrence to `after` behind its start."""
    start = F.greatest(F.col("place") - before, F.lit(0))
    return F.substr(F.col("around"), start + 1, F.col("place") + after - start)


def guards(found: DataFrame) -> DataFrame:
    """Adds the verdict of each guard to occurrences that know their victim words."""
    c = F.col
    near = F.lower(window_text(A.PHRASE_WINDOW, A.PHRASE_WINDOW))
    found = found.withColumn("near_text", near)
    many = F.size("victim_words") > 1
    return found.withColumns({
        "has_phrase": any_substring(c("near_text"), A.CLAIMED + A.CONFIRMED + A.SUSPECTED),
        "has_class": ~alias_needs_context(c("alias")) | matches(
            window_text(A.SHORT_ALIAS_WINDOW, A.SHORT_ALIAS_WINDOW), A.ACTOR_CLASS_CONTEXT),
        "near_victim": ~F.coalesce(many, F.lit(False)) | F.arrays_overlap(word_set(c("near_text")), "victim_words"),
        "historical": matches(window_text(A.HISTORY_WINDOW, 0), A.HISTORICAL_MARKER),
    })


def attribution_status(near: Column) -> Column:
    return (F.when(any_substring(near, A.CLAIMED), F.lit("claimed"))
            .when(any_substring(near, A.CONFIRMED), F.lit("confirmed")).otherwise(F.lit("suspected")))


def is_generic_actor(name: Column) -> Column:
    return name.isNull() | F.lower(F.trim(name)).isin("", *A.GENERIC_ACTORS)


def eligible_events(events: DataFrame) -> DataFrame:
    """Incidents to attribute: with a victim and no real actor, or with neither."""
    c = F.col
    incident = c("event_signal_type") == "incident"
    with_victim = incident & c("victim_org_name").isNotNull() & is_generic_actor(c("actor_name"))
    without = incident & c("victim_org_name").isNull() & c("actor_name").isNull()
    return events.filter(with_victim | without).select(
        "event_id",
        F.when(c("victim_org_name").isNotNull(), F.array_distinct(word_set(c("victim_org_name")))).alias("victim_words"))


def scanned_occurrences(events: DataFrame, linked: DataFrame, names: Names,
                        parts: int | None = None, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Occurrences with guard verdicts, and the articles that were looked at."""
    texts = linked.select(
        "event_id", "article_id",
        article_text(F.col("title"), F.col("summary"), F.col("content")).alias("doc_text"))
    # Written, because the counts and the join both read it and a text should be walked once.
    texts = staged(texts.withColumn("has_name", mentions(F.col("doc_text"), names)), "named")
    # Only eligible events that mention some name are looked at.
    mentioned = texts.groupBy("event_id").agg(
        F.count("*").alias("n_docs"), F.bool_or("has_name").alias("mentioned")).filter("mentioned")
    targets = mentioned.join(eligible_events(events), "event_id").select("event_id", "n_docs", "victim_words", "mentioned")
    docs = join_unique(texts, targets, "event_id", "n_docs", "article_id", hot_rows).filter("mentioned").drop("mentioned", "n_docs")
    # Written, because range partitioning looks at the rows twice and several steps read them.
    docs = staged(docs, "mentioning")
    reach = A.PHRASE_WINDOW + names.longest + 1
    padded = neighbour_text(docs, "event_id", "article_id", "doc_text", reach, parts)
    # Dealt, because an event with many articles leaves its range with most of the texts to walk.
    named = dealt(padded.filter("has_name").drop("has_name"), "article_id", docs.filter("has_name").count())
    found = occurrences(named, names)
    return guards(found), docs


def find_actors(events: DataFrame, linked: DataFrame, names: Names,
                parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """event_id with the actor found in its text: first passing occurrence, longest name."""
    c = F.col
    found, docs = scanned_occurrences(events, linked, names, parts, hot_rows)
    passing = found.filter("has_phrase and has_class and near_victim and not historical").withColumn(
        "status", attribution_status(F.lower(window_text(A.STATUS_WINDOW, A.STATUS_WINDOW))))
    order = F.struct((-c("article_id")).alias("a"), c("offset").alias("o"),
                     (-c("alias_chars")).alias("l"), c("ord"))
    best = passing.groupBy("event_id").agg(
        F.min_by(F.struct("canonical", "actor_type", "status", "victim_words"), order).alias("hit"))
    # A victim of one word only has to occur somewhere in the event's text.
    word = F.get("victim_words", F.lit(0))
    single = docs.filter(F.size("victim_words") == 1).groupBy("event_id").agg(
        F.bool_or(F.array_contains(word_set(c("doc_text")), word)).alias("victim_seen"))
    checked = best.join(single, "event_id", "left").filter(
        (F.coalesce(F.size("hit.victim_words"), F.lit(0)) != 1) | c("victim_seen"))
    return checked.select("event_id", c("hit.canonical").alias("found_actor"),
                          c("hit.actor_type").alias("found_type"), c("hit.status").alias("found_status"))


def attribute_events(events: DataFrame, linked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Events with actor fields filled in and high impact recomputed.

    Adds considered (eligible with a victim) and changed.
    """
    c = F.col
    hits = find_actors(events, linked, prepare_names(dictionary))
    incident = c("event_signal_type") == "incident"
    considered = incident & c("victim_org_name").isNotNull() & is_generic_actor(c("actor_name"))
    found = c("found_actor").isNotNull()
    joined = events.join(hits, "event_id", "left")
    changed = found & (~c("actor_name").eqNullSafe(c("found_actor")) | ~c("actor_type").eqNullSafe(c("found_type"))
                       | ~c("attribution_status").eqNullSafe(c("found_status")))
    joined = joined.withColumns({
        "considered": F.coalesce(considered, F.lit(False)), "changed": changed,
    }).withColumns({
        "actor_name": F.when(found, c("found_actor")).otherwise(c("actor_name")),
        "actor_type": F.when(found, c("found_type")).otherwise(c("actor_type")),
        "attribution_status": F.when(found, c("found_status")).otherwise(c("attribution_status")),
    }).select(*events.columns, "considered", "changed")
    return final_high_impact(joined)


def attribution_stats(attributed: DataFrame) -> DataFrame:
    return attributed.agg(F.count_if("considered").alias("events_considered"),
                          F.count_if("changed").alias("events_changed"))


def blocked_report(events: DataFrame, linked: DataFrame, dictionary: DataFrame, limit: int | None = 20) -> DataFrame:
    """Why events with a victim have no actor: first occurrence of each name and what blocks it."""
    c = F.col
    open_events = events.filter(
        (c("event_signal_type") == "incident") & c("victim_org_name").isNotNull() & c("actor_name").isNull())
    if limit is not None:
        open_events = open_events.orderBy(F.desc("confidence_score"), "event_id").limit(limit)
    found, _ = scanned_occurrences(open_events, linked, prepare_names(dictionary))
    order = F.struct((-c("article_id")).alias("a"), c("offset").alias("o"))
    first = found.withColumn("marked", matches(window_text(A.PHRASE_WINDOW, 0), A.HISTORICAL_MARKER)).groupBy(
        "event_id", "canonical", "alias").agg(F.min_by(F.struct("has_phrase", "marked"), order).alias("f"))
    reason = (F.when(~c("f.has_phrase"), F.lit("no attribution phrase"))
              .when(c("f.marked"), F.lit("historical marker")).otherwise(F.lit("passed guards but not best")))
    return first.select("event_id", "canonical", "alias", reason.alias("reason"))
