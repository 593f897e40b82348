"""Exact Jaccard join of word shingle sets over a token-group matrix.

Equal sets are one node.  Tokens have one global order, rare ones first; two sets at the threshold always share a token among their first
ones.  Sets with equal min-hashes are compared with two leaders each, and what links forms the groups, so a group is connected without pairs
inside it; any other set is a group of its own.  The matrix holds, for each token, the groups whose sets have it among their first tokens.  A set
is a query against the groups of at least its own group's size: shared and missing tokens bound its overlap with every set of a group, groups below the bound
stay closed.  Of an opened group the leader is compared first, then, where that does not link, every set within the same bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import hashing
from .common import documents, map_batches, star_components

WIDTH = 5
PERCENT = 80
#: Min-hashes by which sets meet their leaders.
LEADERS = 4
#: Bytes of text taken apart at a time; a longer text is taken alone.
PIECE = 1 << 20
#: Tokens are counted by their first 16 bits; the counts make the order, nothing else depends on them.
SLOTS = 1 << 16
SALTS = 64
BITS = 24
_GAPS = np.zeros(256, bool)
_GAPS[list(b" \t\n\x0b\x0c\r")] = True


def _sets(data: np.ndarray, offsets: np.ndarray, width: int, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, set of each token): the distinct shingles of each text, ascending; a text of fewer words is one shingle."""
    starts, ends = hashing.spans(~_GAPS[data], offsets)
    first_word = np.searchsorted(starts, offsets)
    words = np.diff(first_word)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(words)), shingles)
    first = np.arange(len(owner)) - (np.cumsum(shingles) - shingles - first_word[:-1])[owner]
    tokens = hashing.Runs(hashing.word_values(data, starts, ends)).values(first, np.minimum(words, width)[owner])
    if order is not None:
        tokens = (order[(tokens >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (tokens & np.uint64((1 << 48) - 1))
    by = np.lexsort((tokens, owner))
    tokens, owner = tokens[by], owner[by]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[fresh], owner[fresh]


def _signed(tokens: np.ndarray) -> np.ndarray:
    """The same order in signed numbers."""
    return (tokens ^ np.uint64(1 << 63)).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int64()))


def token_order(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> tuple[np.ndarray, int]:
    """(rank of each slot, rarest first, first rank whose slot holds twice the mean or more), from all sets of all texts.

    No token below that rank is in more than one of SLOTS / 2 of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in hashing.chunks(batch.column(0), PIECE):
                total += np.bincount((_sets(data, offsets, width, None)[0] >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
        held = np.flatnonzero(total)
        yield {"slot": held, "n": total[held]}

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in map_batches(texts, run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[slot] = n
    by = np.argsort(counts, kind="stable")
    rank = np.empty(SLOTS, np.uint64)
    rank[by] = np.arange(SLOTS, dtype=np.uint64)
    return rank, int(np.searchsorted(counts[by], max(2 * counts.mean(), 1)))


def _first_size(n: Column, percent: int) -> Column:
    """How many first tokens of a set of ``n`` must be looked at."""
    return n - F.ceil(n * percent / 100).cast("long") + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(docs, id_col, text_col).select("text", "doc_id", F.xxhash64("text").alias("h"))


def signatures(texts: DataFrame, order: Broadcast, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, key, n, mins, firsts): a row for each text; ``key`` stands for the set, ``firsts`` are its first tokens, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, _, data, offsets in hashing.chunks(batch.column(0), PIECE):
                tokens, owner = _sets(data, offsets, width, order.value)
                n = np.bincount(owner, minlength=len(offsets) - 1)
                held, begins = np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]
                key, mins = np.zeros(len(n), np.uint64), np.zeros((len(n), LEADERS), np.uint64)
                if len(held):
                    key[held] = hashing.mix(np.add.reduceat(hashing.mix(tokens), begins) + n[held].astype(np.uint64))
                    for k in range(LEADERS):
                        mins[held, k] = np.minimum.reduceat(hashing.mix(tokens ^ np.uint64(0xC2B2AE3D27D4EB4F * (k + 1) % (1 << 64))), begins)
                sizes = np.where(n > 0, n + (-n * percent // 100) + 1, 0)
                near = np.arange(len(tokens)) - (np.cumsum(n) - n)[owner] < sizes[owner]
                rows = batch.slice(row, len(n))
                yield {
                    "doc_id": rows.column(1), "h": rows.column(2), "key": key.view(np.int64), "n": n,
                    "mins": _lists(mins.view(np.int64).ravel(), np.full(len(n), LEADERS)), "firsts": _lists(_signed(tokens[near]), sizes)}

    return map_batches(texts, run, "doc_id long, h long, key long, n long, mins array<long>, firsts array<long>")


def _whole_sets(texts: DataFrame, wanted: DataFrame, order: Broadcast, width: int) -> DataFrame:
    """(key, tokens) of the nodes ``wanted`` (key, first_id, h): only their documents are taken apart, found by a bitmap of fixed size."""
    place = F.xxhash64("doc_id", "h")
    bits = hashing.bitmap(wanted.select(F.xxhash64(F.col("first_id"), F.col("h")).alias("v")), "v", BITS)
    bits = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            may = hashing.in_bitmap(bits.value, batch.column(1).to_numpy().view(np.uint64))
            for _, _, data, offsets in hashing.chunks(batch.column(0).filter(pa.array(may)), PIECE):
                tokens, owner = _sets(data, offsets, width, order.value)
                n = np.bincount(owner, minlength=len(offsets) - 1)
                key = np.zeros(len(n), np.uint64)
                if len(tokens):
                    key[n > 0] = hashing.mix(np.add.reduceat(hashing.mix(tokens), (np.cumsum(n) - n)[n > 0]) + n[n > 0].astype(np.uint64))
                yield {"key": key.view(np.int64), "tokens": _lists(_signed(tokens), n)}

    rows = map_batches(texts.select("text", place.alias("v")), run, "key long, tokens array<long>")
    return stage(rows.join(wanted.select("key"), "key").groupBy("key").agg(F.any_value("tokens").alias("tokens")), "jaccard-sets")


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, order: Broadcast, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = _whole_sets(texts, stage(nodes.join(ends, "key").select("key", "first_id", "h"), "jaccard-wanted"), order, width)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return stage(both.filter(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b"), "jaccard-links")


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The overlap that sets of these sizes need."""
    return F.ceil((a + b) * percent / (100 + percent))


def _central() -> Column:
    """Orders sets by how common their tokens are: of near copies the one without edits comes last."""
    return F.struct("mid", "rare", "key", "n")


def leader_pairs(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): each set with two leaders among those that share a min-hash: the one whose tokens are the most common, and the one whose
    rarest token is the most common.  Edits bring rare tokens, so an original leads its near copies."""
    rows = nodes.select("key", "n", "rare", "mid", F.posexplode("mins").alias("k", "m"))
    ends = rows.groupBy("k", "m").agg(F.max(_central()).alias("lo"), F.max(F.struct("rare", "mid", "key", "n")).alias("hi"), F.min("key").alias("first"), F.max("key").alias("last"))
    ends = ends.filter("first < last").select("k", "m", F.struct("lo.key", "lo.n").alias("lo"), F.struct("hi.key", "hi.n").alias("hi"))
    rows = rows.join(ends, ["k", "m"]).select("key", "n", F.explode(F.array("lo", "hi")).alias("b"))
    return rows.filter((F.col("key") != F.col("b.key")) & _near_size(F.col("n"), F.col("b.n"), percent)).select(F.least("key", "b.key").alias("a"), F.greatest("key", "b.key").alias("b")).distinct()


def shared_tokens(firsts: DataFrame, hot: int) -> DataFrame:
    """(o, key, g, pos): the first tokens that sets of two groups or more have, from (key, g, firsts).

    Tokens of rank ``hot`` or more may be in many sets: they are dealt out by salt, too, and their groups are summed up in a second step."""
    rows = firsts.select("key", "g", F.posexplode("firsts").alias("pos", "o"))
    rows = rows.withColumn("salt", F.when(F.shiftright("o", 48) >= hot - SLOTS // 2, F.pmod("key", F.lit(SALTS))).otherwise(-1))
    by = Window.partitionBy("o", "salt")
    rows = rows.withColumns({"lo": F.min("g").over(by), "hi": F.max("g").over(by)}).filter("lo < hi or salt >= 0").drop("lo", "hi")
    rows = stage(rows, "jaccard-tokens")
    often = rows.filter("salt >= 0")
    several = often.groupBy("o").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("o")
    return rows.filter("salt < 0").unionByName(often.join(several, "o").select(*rows.columns)).drop("salt")


def open_groups(tokens: DataFrame, nodes: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(q, g, members, leader): the groups that a set may link into; ``groups`` has (g, members, n_min, n_max, end_min, leader)."""
    facts = groups.withColumnRenamed("g", "own").select("own", F.col("members").alias("own_members"))
    asks = tokens.join(nodes.select("key", "n", "end"), "key").withColumnRenamed("g", "own").join(facts, "own")
    matrix = tokens.select("o", "g").distinct().join(groups, "g")
    size = (F.col("n_max") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("n_min") * percent)
    later = F.struct("own_members", "own") < F.struct("members", "g")
    inside = F.col("o") <= F.col("end_min")
    rows = asks.join(matrix, "o").filter(size & later).groupBy("key", "g", "n", "end", "members", "n_min", "end_min", "leader").agg(
        F.count("*").alias("c"), F.count_if(inside).alias("c_in"), F.coalesce(F.max(F.when(inside, F.col("pos"))), F.lit(-1)).alias("last"))
    n, first = F.col("n"), _first_size(F.col("n"), percent)
    seen = F.when(F.col("end_min") >= F.col("end"), first).otherwise(F.col("last") + 1)
    alone = F.when((F.col("members") == 1) & (F.col("end") >= F.col("end_min")), F.col("n_min") - _first_size(F.col("n_min"), percent) + F.col("c")).otherwise(n)
    least = _least_overlap(n, F.greatest(F.col("n_min"), F.ceil(n * percent / 100)), percent)
    return rows.filter(F.least(n - seen + F.col("c_in"), alone) >= least).select(F.col("key").alias("q"), "g", "members", "leader")


def open_sets(opened: DataFrame, tokens: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the sets of opened groups that may link with the query, by the tokens that both have."""
    asks = opened.join(tokens.select(F.col("key").alias("q"), "o", F.col("pos").alias("q_pos")), "q")
    rows = asks.join(tokens.select("o", "g", "key", "pos"), ["o", "g"]).groupBy("q", "key").agg(F.count("*").alias("c"), F.max("q_pos").alias("q_last"), F.max("pos").alias("last"))
    size = nodes.select("key", "n", "end")
    rows = rows.join(size, "key").join(size.select(F.col("key").alias("q"), F.col("n").alias("m"), F.col("end").alias("q_end")), "q")
    n, m = F.col("n"), F.col("m")
    seen = F.when(F.col("end") <= F.col("q_end"), _first_size(n, percent)).otherwise(F.col("last") + 1)
    q_seen = F.when(F.col("q_end") <= F.col("end"), _first_size(m, percent)).otherwise(F.col("q_last") + 1)
    most = F.least(n - seen, m - q_seen) + F.col("c")
    return rows.filter(_near_size(n, m, percent) & (most >= _least_overlap(n, m, percent))).select(F.col("q").alias("a"), F.col("key").alias("b"))


def _between(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the groups of linked keys."""
    for end in ("a", "b"):
        links = links.join(nodes.select(F.col("key").alias(end), F.col("g").alias(f"g{end}")), end)
    return links.select(F.col("ga").alias("a"), F.col("gb").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, n_shingles, key, component_id): a row for each row of ``docs``.

    Texts link when their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` in a hundred or more; ``component_id`` is the
    smallest doc_id reachable, its own for a null, empty or blank text, which links with nothing.  A text of fewer words is one shingle.
    Rows without a doc_id take part, but name a component only if all of it has none; repeated rows give repeated results.  Words,
    shingles and sets are told apart by 64-bit values."""
    spark, texts = docs.sparkSession, _texts(docs, id_col, text_col)
    rank, hot = token_order(docs, text_col, width)
    order = spark.sparkContext.broadcast(rank)
    rows = stage(signatures(texts, order, width, percent), "jaccard-signatures")
    full = rows.filter("n > 0")
    first = F.min(F.struct("doc_id", "h")).alias("first")
    nodes = full.groupBy("key").agg(
        first, F.min("doc_id").alias("least_id"), F.any_value("n").alias("n"), F.any_value("mins").alias("mins"),
        F.max(F.element_at("firsts", -1)).alias("end"), F.max(F.element_at("firsts", 1)).alias("rare"), F.max(F.expr("firsts[size(firsts) div 2]")).alias("mid"))
    nodes = stage(nodes.select("key", F.col("first.doc_id").alias("first_id"), "first.h", "least_id", "n", "mins", "end", "rare", "mid"), "jaccard-nodes")
    led = star_components(_linked(leader_pairs(nodes, percent), nodes, texts, order, width, percent), "jaccard-led").select(F.col("node").alias("key"), F.col("component").alias("g"))
    grouped = stage(nodes.drop("mins").join(led, "key", "left").withColumn("g", F.coalesce("g", "key")), "jaccard-grouped")
    groups = stage(grouped.groupBy("g").agg(F.count("*").alias("members"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("end").alias("end_min"), F.max(_central())["key"].alias("leader")), "jaccard-groups")
    firsts = full.groupBy("key").agg(F.any_value("firsts").alias("firsts")).join(grouped.select("key", "g"), "key")
    tokens = stage(shared_tokens(firsts, hot), "jaccard-matrix")
    opened = stage(open_groups(tokens, grouped, groups, percent), "jaccard-opened")
    # A group's leader first: who links with it needs no other set of the group, and a group of one is done.
    found = _between(_linked(opened.select(F.col("q").alias("a"), F.col("leader").alias("b")).distinct(), grouped, texts, order, width, percent), grouped)
    whole = stage(star_components(found, "jaccard-components").select(F.col("node").alias("g"), "component"), "jaccard-merged")
    rest = opened.filter("members > 1").join(grouped.select(F.col("key").alias("q"), F.col("g").alias("own")), "q")
    for side in ("own", "g"):
        rest = rest.join(whole.select(F.col("g").alias(side), F.col("component").alias(f"{side}_component")), side, "left")
    apart = F.coalesce("own_component", "own") != F.coalesce("g_component", "g")
    pairs = stage(open_sets(stage(rest.filter(apart).select("q", "g"), "jaccard-rest"), tokens, grouped, percent), "jaccard-pairs")
    found = found.unionByName(_between(_linked(pairs, grouped, texts, order, width, percent), grouped))
    whole = star_components(found, "jaccard-components").select(F.col("node").alias("g"), "component")
    named = grouped.join(whole, "g", "left").withColumn("component", F.coalesce("component", "g"))
    owner = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = stage(named.join(owner, "component").select("key", "component_id"), "jaccard-named")
    out = full.join(named, "key").unionByName(rows.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "key", "component_id")
