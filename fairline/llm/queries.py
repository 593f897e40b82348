"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, table
from . import bpe, chat, ctw, jaccard, merkle, paragraphs, phrases, phrasing, quality, repeats, resampling, secrets, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op10_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return bpe.digests(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


@query("op1_merkle_fingerprints")
def merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_comparison(table(spark, sf_dir, "documents"))


_CHAT_SQL = """
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lsqb;'))
        + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lsqb;')) + 11 AS size FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op8_chat_format", _CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema))
    done = stage(chat.conversations(stage(chat.chain(rows), "chat-nodes")), "chat-formatted")
    read = done.select("conv_id", "formatted", chat.turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op7_secret_ownership")
def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


_PHRASE_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), s AS (
    SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0
), g AS (
    SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 13], ' ') AS phrase, least(len(w), 13) AS size FROM s
), sizes AS (SELECT DISTINCT size FROM g), p AS (
    SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size
), q AS (
    SELECT doc_id, s, size, array_to_string(w[s + 1 : s + size], ' ') AS phrase FROM p
), o AS (
    SELECT doc_id, s, q.size, item_id FROM q JOIN g USING (phrase)
), hit AS (
    SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS x FROM o) GROUP BY 1
), own AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query("op4_benchmark_contamination", _PHRASE_SQL)
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


@query("op6_quality_scores")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_context_tree_scores")
def context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


@query("op9_paragraph_dedup")
def paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.report(table(spark, sf_dir, "documents"))


@query("op5_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


@query("op12_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_COLLOCATION_SQL = r"""
WITH t AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM t
), total AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1
), g AS (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM p, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size
), f AS (
    SELECT lang, array_to_string(w[s : s + size - 1], ' ') AS phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
    SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2
), cut AS (
    SELECT *, unnest(range(1, size)) AS k FROM c
), s AS (
    SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a) // (x.a + y.a) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1 : k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[k + 1 :], ' ')
), best AS (
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), part AS (
    SELECT lang, w, a, size, short, unnest(range(1, size - short + 2)) AS s FROM c, (SELECT unnest([2, 3]) AS short) WHERE short < size
), cover AS (
    SELECT lang, array_to_string(w[s : s + short - 1], ' ') AS phrase, max(a) AS most FROM part GROUP BY 1, 2
), kept AS (
    SELECT best.* FROM best LEFT JOIN cover USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op11_phrase_collocations", _COLLOCATION_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrasing.collocations(table(spark, sf_dir, "documents")).drop("doc_id", "start")


@query("op13_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
