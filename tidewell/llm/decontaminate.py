"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The index holds postings (term, document, position) of the training texts, for the terms that the test items ask for
first. Every test window is reached through its rarest terms, rarest by their counts over all training texts: their
lists, moved by the term's offset in the item, meet on (document, item, start). What meets is compared word by word.

Index terms are lower-cased in every script; matches are compared with A-Z lower-cased only, which is never wider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, free_name, json_bytes, small, written

#: Everything that ends a word, before lower-casing.
BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: What met, as JSON text, is broadcast up to so many bytes; names of documents (16 bytes each) up to four times as many.
BROADCAST_BYTES = 32_000_000


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def documents_with_key(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text: with the id it names a text), text."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def tokens(docs: DataFrame) -> DataFrame:
    """One row per word: doc_id, h, pos from 0, term."""
    exploded = documents_with_key(docs).select("doc_id", "h", F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    return exploded.select("doc_id", "h", "pos", F.lower("word").alias("term"))


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms (column ``term``, distinct): term, doc_id, h, pos; written to the shared folder."""
    return written(tokens(docs).join(small(terms), "term").select("term", "doc_id", "h", "pos"), "postings")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences over all texts of each of the given terms; 0 for those that never occur."""
    seen = tokens(docs).select("term").join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct test texts with words: item (a number), words, n, width (words of a window), ids (their item_ids)."""
    words = F.transform(raw_words(F.col("text")), ascii_lower)
    rows = benchmark.select("item_id", words.alias("words")).filter(F.size("words") > 0)
    grouped = rows.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    return grouped.select(F.xxhash64("words").alias("item"), "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(window)).alias("width"), "ids")


def anchors_of(items: DataFrame, counts: DataFrame, lists: int) -> DataFrame:
    """For every window (item, start) its ``lists`` rarest terms: item, start, at (their positions in the item)."""
    places = items.select("item", F.posexplode("words").alias("p", "word")).withColumn("term", F.lower("word"))
    known = places.join(counts, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("places"))
    starts = items.join(known, "item").select("item", "places", "width", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("start"))
    window = F.slice("places", F.col("start") + 1, F.col("width"))
    ranked = F.array_sort(F.transform(window, lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p"))))
    return starts.select("item", "start", F.transform(F.slice(ranked, 1, lists), lambda x: x["p"]).alias("at"))


def _met(docs: DataFrame, items: DataFrame, lists: int) -> DataFrame:
    """Where the rarest lists of a window meet: doc_id, h, item, shift (of item words to document words), starts."""
    vocabulary = written(items.select(F.explode("words").alias("word")).select(F.lower("word").alias("term")).distinct(), "terms")
    counts = written(term_counts(docs, vocabulary), "counts")
    anchors = written(anchors_of(items, counts, lists), "anchors")
    places = items.select("item", F.posexplode("words").alias("p", "word")).select("item", "p", F.lower("word").alias("term"))
    wanted = written(anchors.select("item", F.explode("at").alias("p")).distinct().join(places, ["item", "p"]), "wanted")
    index = positional_index(docs, wanted.select("term").distinct())
    shifted = index.join(small(wanted), "term").select("doc_id", "h", "item", (F.col("pos") - F.col("p")).alias("shift"), "p")
    met = shifted.groupBy("doc_id", "h", "item", "shift").agg(F.collect_set("p").alias("ps"))
    windows = anchors.groupBy("item").agg(F.collect_list(F.struct("start", "at")).alias("windows"))
    here = F.filter("windows", lambda w: F.forall(w["at"], lambda p: F.array_contains(F.col("ps"), p)))
    # Windows before the document's first word go one by one; the others of the alignment stay.
    inside = F.filter(F.transform(here, lambda w: w["start"]), lambda s: s + F.col("shift") >= 0)
    met = met.join(small(windows), "item").withColumn("starts", inside)
    return met.filter(F.size("starts") > 0).select("doc_id", "h", "item", "shift", "starts")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, lists: int = 2) -> DataFrame:
    """Every row of ``docs`` with its exact matches: doc_id, h, n_words, matches.

    ``matches`` holds (ids, start, width, at): the window of ``width`` words from the item's word ``start`` stands at
    the document's word ``at``. Items of fewer words than a window are one window; items without words match nothing.
    Rows that repeat an id and a text each keep a row.
    """
    items = written(items_of(benchmark, window), "items")
    met = _met(docs, items, lists).join(small(items.select("item", "words", "width", "ids")), "item")
    found = met.groupBy("doc_id", "h").agg(F.collect_list(F.struct("ids", "shift", "starts", "words", "width")).alias("met"))
    found = written(found.select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), "met"), "met")
    rows, same = documents_with_key(docs), lambda other: F.col("doc_id").eqNullSafe(other["m_id"]) & (F.col("h") == other["m_h"])
    kind = found.schema["met"].dataType
    if json_bytes(found) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), same(found), "left")
    else:  # what met is too wide to be broadcast: its documents are picked by their keys, and only their texts shuffle
        names = found.select("m_id", "m_h")
        names = F.broadcast(names) if names.count() * 16 <= 4 * BROADCAST_BYTES else names
        chosen = rows.join(names, same(names), "left_semi")
        joined = chosen.join(found, same(found)).unionByName(rows.join(names, same(names), "left_anti").withColumn("met", F.lit(None).cast(kind)), allowMissingColumns=True)
    joined = joined.withColumn("raw", raw_words(F.col("text")))

    def verified(c: Column) -> Column:
        first = c["shift"] + c["starts"][0]
        return F.struct(
            c["ids"].alias("ids"), c["shift"].alias("shift"), c["starts"].alias("starts"), c["words"].alias("words"), c["width"].alias("width"),
            F.greatest(c["shift"], F.lit(0)).alias("from_"), F.transform(F.slice(F.col("raw"), F.greatest(c["shift"], F.lit(0)) + 1, F.size(c["words"])), ascii_lower).alias("text"), first.alias("first"),
        )

    def matches(c: Column) -> Column:
        same = F.filter(c["starts"], lambda s: F.when(s + c["shift"] >= 0, F.slice(c["text"], s + c["shift"] - c["from_"] + 1, c["width"]) == F.slice(c["words"], s + 1, c["width"])).otherwise(False))
        return F.transform(same, lambda s: F.struct(c["ids"].alias("ids"), s.alias("start"), c["width"].alias("width"), (s + c["shift"]).alias("at")))

    met_here = F.coalesce(F.col("met"), F.expr("cast(array() as array<struct<ids:array<string>,shift:int,starts:array<int>,words:array<string>,width:int>>)"))
    all_matches = F.flatten(F.transform(F.transform(met_here, verified), matches))
    return joined.select("doc_id", "h", F.size("raw").cast("long").alias("n_words"), all_matches.alias("matches"))


def hit_words(matches: Column) -> Column:
    """Number of document words inside any match: the length of the union of their spans."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["at"].alias("a"), (m["at"] + m["width"]).alias("z"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans, start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["z"] - F.greatest(acc["end"], s["a"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["z"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, h, n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    Null and empty texts have no words and no hits. A text is contaminated when hit words are at least 1 / ``share``
    of its words. Items with equal words count one by one; items without an id are found but have no name.
    """
    found = phrase_matches(docs, benchmark, window)
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["ids"]))))
    out = found.select("doc_id", "h", "n_words", hit_words(F.col("matches")).alias("n_hit"), ids.alias("item_ids"))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return out.select("doc_id", "h", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", dirty.alias("contaminated"))


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int = 20, id_column: str = "item_id") -> DataFrame:
    """Places where all words of a query stand within ``within`` document words, in any order.

    ``queries``: (id_column, text). Returns id_column, doc_id, h, first_pos, last_pos: for every end of such a place, the
    shortest one. Repeated words of a query count once; queries without words match nothing. A window over the
    query's postings inside one document carries each term's last position, so no pairs are made.
    """
    words = queries.select(F.col(id_column).alias("q"), F.array_distinct(F.transform(raw_words(F.col("text")), F.lower)).alias("ws")).filter(F.size("ws") > 0).distinct()
    terms = words.select("q", F.size("ws").alias("k"), F.posexplode("ws").alias("t", "term"))
    index = positional_index(docs, terms.select("term").distinct())
    hits = index.join(small(terms), "term").distinct()
    near = Window.partitionBy("q", "doc_id", "h").orderBy("pos").rangeBetween(-(within - 1), 0)
    return (
        hits.withColumn("n", F.size(F.collect_set("t").over(near))).withColumn("recent", F.collect_list(F.struct("t", "pos")).over(near))
        .filter(F.col("n") == F.col("k"))
        .withColumn("first_pos", F.array_min(F.transform(F.array_distinct(F.col("recent.t")), lambda t: F.array_max(F.transform(F.filter("recent", lambda r: r["t"] == t), lambda r: r["pos"])))))
        .select(F.col("q").alias(id_column), "doc_id", "h", "first_pos", F.col("pos").alias("last_pos"))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they are."""
    dirty = written(contamination(docs, benchmark, window, share).filter("contaminated").select(F.col("doc_id").alias("d"), F.col("h").alias("t")).distinct(), "dirty")
    own = free_name(docs, "_h")
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(small(dirty), rows["doc_id"].eqNullSafe(dirty["d"]) & (rows[own] == dirty["t"]), "left_anti").drop(own)
