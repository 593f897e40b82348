"""Benchmark decontamination over a positional inverted index.

Each benchmark window (13 consecutive words) is looked up by its two rarest words.  The index holds the places of those words alone:
(document, position, term).  The two offset-adjusted lists are intersected by an equality join, and what is left is compared with the
text.  A window with a word that no document has is dropped at once.  All of it is DataFrame expressions without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import documents, lower_ascii

WINDOW = 13
#: Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN, -1), "")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): h tells apart texts that share a doc_id."""
    return documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")


def _same(*names: str) -> Column:
    """Equality of the aliases a and b; a null doc_id equals itself."""
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for name in names:
        on = on & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    return on


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, phrase): all windows of each item; an item of fewer words, but not none, is one window."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return rows.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.array_join(F.slice("w", F.col("s"), F.lit(width)), " ").alias("phrase")).distinct()


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, h, pos, term): postings of the given distinct ``terms``; ``docs`` comes from ``_texts``."""
    places = docs.select("doc_id", "h", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return places.join(terms, "term").select("doc_id", "h", "pos", "term")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of the terms that occur at all."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, first, at, second, step): the two rarest words of each phrase, ``at`` the place of the first, ``step`` words further the second.

    Phrases with a word that never occurs have no row; of a single word, it is both."""
    split = phrases.select("phrase", F.split("phrase", " ").alias("w"))
    places = split.select("phrase", F.size("w").alias("size"), F.posexplode("w").alias("at", "term")).join(counts, "term")
    ordered = F.array_sort(F.collect_list(F.struct("n", "term", "at")))
    rows = places.groupBy("phrase", "size").agg(ordered.alias("o")).filter(F.size("o") == F.col("size"))
    a, b = F.col("o")[0], F.get("o", F.least(F.col("size"), F.lit(2)) - 1)
    return rows.select("phrase", a["term"].alias("first"), a["at"].alias("at"), b["term"].alias("second"), (b["at"] - a["at"]).alias("step"))


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, start, size, phrase, exact) and the windows (item_id, phrase).

    ``exact`` rows are occurrences of the phrase.  With ``slop`` there are proximity matches, too: the phrase's two rarest words
    are within so many words of their distance, though the phrase is not there."""
    texts = _texts(docs, id_col, text_col)
    held = stage(windows(items, item_col, item_text_col, width), "phrase-windows")
    phrases = held.select("phrase").distinct()
    vocabulary = stage(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "phrase-terms")
    counts = stage(frequencies(texts, vocabulary), "phrase-counts")
    anchors = stage(rarest(phrases, counts), "phrase-anchors")
    wanted = stage(anchors.select(F.explode(F.array("first", "second")).alias("term")).distinct(), "phrase-wanted")
    postings = stage(index(texts, wanted).distinct(), "phrase-postings")
    pairs = anchors.select("first", "second", "step").distinct()
    expected = postings.join(pairs, F.col("term") == F.col("first")).select(
        "doc_id", "h", "first", "second", "step", F.col("pos").alias("at"), F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off"))
    expected = expected.select("*", (F.col("at") + F.col("step") + F.col("off")).alias("pos"))
    seconds = postings.select("doc_id", "h", "pos", F.col("term").alias("second"))
    both = expected.alias("a").join(seconds.alias("b"), _same("h", "pos", "second")).groupBy("a.doc_id", "a.h", "first", "a.second", "step", "at").agg(F.min(F.abs("off")).alias("off"))
    both = both.select("doc_id", "h", "first", "second", "step", F.col("at").alias("pos"), "off")
    starts = both.join(anchors, ["first", "second", "step"]).select("doc_id", "h", "phrase", (F.col("pos") - F.col("at")).alias("start"), "off")
    by_text = stage(starts.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "phrase", "off")).alias("starts")), "phrase-starts")
    # The same join at every size: the documents with candidates grow with the corpus, so they are never broadcast.
    found = texts.alias("a").join(by_text.alias("b").hint("merge"), _same("h")).select("a.doc_id", "a.h", words(F.col("a.text")).alias("w"), "b.starts")
    rows = found.select("doc_id", "h", "w", F.explode("starts").alias("s")).select("doc_id", "h", "w", "s.*", F.size(F.split("s.phrase", " ")).alias("size"))
    inside = F.when((F.col("start") >= 0) & (F.col("off") == 0), F.array_join(F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("size")), " ") == F.col("phrase")).otherwise(False)
    rows = rows.select("doc_id", "h", "start", "size", "phrase", inside.alias("exact"))
    return (rows if slop else rows.filter("exact")).distinct(), held


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, share: int = 20) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated if one in ``share`` of its words is.  Null and empty
    texts have no words and no hits; repeated rows get equal results; items without words, and an empty table of items, hit nothing."""
    found, held = occurrences(docs, items, id_col, text_col, item_col, item_text_col, width)
    found = stage(found, "phrase-found")
    ends = found.groupBy("doc_id", "h", "start").agg((F.col("start") + F.max("size")).alias("end"))
    before = Window.partitionBy("doc_id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = ends.withColumn("fresh", fresh).groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"))
    owners = found.select("doc_id", "h", "phrase").distinct().join(held, "phrase").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = stage(hits.alias("a").join(owners.alias("b"), _same("h")).select("a.doc_id", "a.h", "n_hit", "items"), "phrase-hits")
    rows = _texts(docs, id_col, text_col).select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.alias("a").join(both.alias("b"), _same("h"), "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return rows.select(
        "a.doc_id", "a.h", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = contamination(docs, items, id_col, text_col, item_col, item_text_col).filter("contaminated")
    bad = stage(bad.select(F.col("doc_id").alias("__key_id"), F.col("h").alias("__key_h")).distinct(), "phrase-contaminated")
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__key_id")) & (h == F.col("__key_h")), "left_anti")
