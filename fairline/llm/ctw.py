"""Language-model scores by context-tree weighting.

Bytes are coded as eight binary decisions, each in the context of the bytes before it.  Every node of the context tree has a
Krichevsky-Trofimov estimate, and a decision's probability mixes the estimates of all depths with the weights that the tree has learned.

Both the probability of a byte in its context and a word's count depend on one key alone: the last bytes or the word.  So texts never
meet the whole model.  Tasks cut their rows into blocks and write the text of each block once, with the block's distinct keys and their counts
in training rows.  Keys are dealt out by the last two context bytes (words by hash), counts are merged there, the trees below depth one
are built there, and every block gets back the values of its own keys.  What is gathered grows with the corpus, nothing is
capped; the driver sees the two top levels of the tree only, at most 65 280 nodes."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import documents, map_batches

DEPTH = 6
#: Stands before and after every text; UTF-8 never has it.
EDGE = 0xFF
BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 2 << 20
#: Key partitions, and the blocks whose requests meet in one task.
PARTS, BLOCKS_TOGETHER = 128, 64
TEXT, GRAMS, WORDS, NODES = 0, 1, 2, 3
HELD_OUT = 7, 2


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array of 8-byte numbers; ascending keys become differences."""
    raw = np.ascontiguousarray(values).view(np.uint64)
    return zstandard.compress(np.diff(raw, prepend=raw[:1] * 0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, "<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_values(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<f4").ravel()


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every place of the texts, packed, and the number of places of each; a text ends with an edge."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join([edge * depth + t + edge for t in texts]), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    packed = np.zeros(max(len(data) - depth, 0), np.uint64)
    for k in range(depth + 1):
        packed = (packed << np.uint64(8)) | data[k : len(data) - depth + k]
    inside = np.ones(len(packed), bool)
    ends = np.cumsum(sizes + depth)[:-1] - depth
    inside[(ends[:, None] + np.arange(depth)).ravel()] = False
    return packed[inside], sizes


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1) - np.log(np.pi)


def share(lead: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate from the log ratio of its own to its children's probability."""
    return 1 / (1 + np.exp(np.clip(-lead, -700, 700)))


class Tree:
    """Nodes from ``DEPTH`` up to ``top`` for some distinct grams; node: context << 8 | bits of the byte so far with a leading one."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 1):
        byte = (keys & np.uint64(255)).astype(np.int64)
        context = keys >> np.uint64(8) << np.uint64(8)
        node = np.concatenate([context | ((1 << k) | (byte >> (8 - k))).astype(np.uint64) for k in range(8)])
        self.bit = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
        n = np.tile(counts.astype(float), 8)
        node, self.leaf = np.unique(node, return_inverse=True)
        total = lambda inverse, x, size: np.bincount(inverse, x, size)
        n1, n0 = total(self.leaf, n * self.bit, len(node)), total(self.leaf, n * (1 - self.bit), len(node))
        own = estimate(n0, n1)
        below, lead = own, np.full(len(node), np.inf)
        #: From the deepest level up: ones' share, weight ratio, and each node's parent.
        self.levels = []
        for d in range(depth, top, -1):
            mask = np.uint64((1 << (8 * (d - 1))) - 1)
            up = ((node >> np.uint64(8)) & mask) << np.uint64(8) | (node & np.uint64(255))
            above, parent = np.unique(up, return_inverse=True)
            self.levels.append(((n1 + 0.5) / (n0 + n1 + 1), lead, parent))
            n0, n1, below = (total(parent, x, len(above)) for x in (n0, n1, below))
            node, own = above, estimate(n0, n1)
            lead = own - below
            if d - 1 > top:
                below = np.logaddexp(own, below) - np.log(2)
        self.node, self.n0, self.n1, self.below = node, n0, n1, below

    def log10(self, mixed: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log probability of each gram's byte; mixed, weight: of the top nodes, what is mixed above and what weight is left."""
        for one, lead, parent in reversed(self.levels):
            mixed, weight = mixed[parent], weight[parent]
            part = share(lead)
            mixed, weight = mixed + weight * part * one, weight * (1 - part)
        p = mixed[self.leaf]
        return np.log10(np.where(self.bit == 1, p, 1 - p)).reshape(8, -1).sum(axis=0)


def upper(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Mixed probability and weight left below depth one for each of its nodes, from the sums of their children."""
    size = 1 << 16
    n0, n1, below = np.zeros(size), np.zeros(size), np.zeros(size)
    at = rows["node"].to_numpy()
    n0[at], n1[at], below[at] = (rows[c].to_numpy() for c in ("n0", "n1", "below"))
    own = estimate(n0, n1)
    whole = np.logaddexp(own, below) - np.log(2)
    r0, r1, rest = (x.reshape(256, 256).sum(axis=0) for x in (n0, n1, whole))
    part = share(estimate(r0, r1) - rest)
    mixed, weight = np.tile(part * (r1 + 0.5) / (r0 + r1 + 1), 256), np.tile(1 - part, 256)
    part = share(own - below)
    return mixed + weight * part * (n1 + 0.5) / (n0 + n1 + 1), weight * (1 - part)


def _part(keys: np.ndarray, kind: int) -> np.ndarray:
    """Key partition: by the last two context bytes, so that a tree below depth one is in one place."""
    two = (keys >> np.uint64(8)) & np.uint64(0xFFFF) if kind == GRAMS else keys
    return ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(PARTS)


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``CHUNK_BYTES`` or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_BLOCK = "kind int, block long, part int, keys binary, counts binary, n_train long, text binary"


def _block_rows(block: int, ids: list[int | None], texts: list[bytes]) -> Iterator[dict]:
    """A block's text row and its requests."""
    row = lambda kind, part, keys, counts, n, text: {"kind": [kind], "block": [block], "part": [part], "keys": [keys], "counts": [counts], "n_train": [n], "text": [text]}
    train = np.array([not held_out(i) for i in ids])
    known = np.array([i is not None for i in ids])
    numbers = np.array([i or 0 for i in ids], np.int64)
    packed = zstandard.compress(b"".join([len(t).to_bytes(8, "little") + t for t in texts]), 3)
    yield row(TEXT, 0, numbers.tobytes(), np.packbits(known).tobytes(), int(train.sum()), packed)
    for kind, count in ((WORDS, _count_words), (GRAMS, _count_grams)):  # one after the other, to hold the counts of one kind only
        keys, counts = count(texts, train)
        part = _part(keys, kind)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(PARTS + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[p] : ends[p + 1]]
            yield row(kind, p, pack(keys[own]), pack(counts[own]), None, None)


def _count_words(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words and their counts in training texts."""
    words: Counter = Counter()
    for t, real in zip(texts, train, strict=True):
        if real:
            words.update(t.split())
        else:
            words.update(dict.fromkeys(t.split(), 0))
    return merged([word_keys([*words])], [np.fromiter(words.values(), np.int64, len(words))])


def _count_grams(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All contexts with their byte and their counts in training texts."""
    keys, counts = [], []
    for a, b in _chunks(texts):
        found, sizes = grams(texts[a:b])
        learned = np.repeat(train[a:b], sizes)
        for rows, real in ((found[learned], 1), (found[~learned], 0)):
            u, n = np.unique(rows, return_counts=True)
            keys.append(u)
            counts.append(n * real)
        if sum(map(len, keys[1:])) > len(keys[0]) + (1 << 20):
            keys, counts = ([x] for x in merged(keys, counts))
    return merged(keys, counts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    ids, texts, size, n = [], [], 0, 0
    first = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = t.as_py().encode("utf-8", "surrogatepass").lower()
            if texts and size + len(text) > BLOCK_BYTES:
                yield from _block_rows(first + n, ids, texts)
                ids, texts, size, n = [], [], 0, n + 1
            ids.append(i)
            texts.append(text)
            size += len(text)
    if texts:
        yield from _block_rows(first + n, ids, texts)


class Lookup:
    """Positions of keys in a table of distinct ones by open addressing; keys that it lacks must not be asked for."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 1))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.slots = keys, np.full(self.mask + 1, -1, np.int64)
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.slots[at]
        open_rows = np.flatnonzero(self.keys[found] != keys)
        at = at[open_rows]
        while len(open_rows):
            at = (at + 1) & self.mask
            found[open_rows] = self.slots[at]
            wrong = self.keys[found[open_rows]] != keys[open_rows]
            open_rows, at = open_rows[wrong], at[wrong]
        return found


_MODEL = "kind int, part int, keys binary, counts binary, node long, n0 double, n1 double, below double"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _table(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema})


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(text))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Learned from rows that are not held out; a row without a doc_id counts as one of these.  ``score`` is the log10 probability of the
    text and its end, A-Z in lower case.  Null and empty texts consist of their end; without training rows every bit has probability a
    half.  Repeated rows count as often as they are there."""
    held = stage(map_batches(documents(docs, id_col, text_col), _blocks, _BLOCK), "ctw-blocks")
    texts, asked = held.filter(F.col("kind") == TEXT), held.filter(F.col("kind") != TEXT).select("kind", "block", "part", "keys", "counts")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train")).first()
    salts = max(1, -(-size.n // BLOCKS_TOGETHER))
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
    asked = asked.select("*", salt)

    part_schema = _schema("kind int, part int, keys binary, counts binary")

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = merged([unpack(k.as_py()) for k in table["keys"]], [unpack(c.as_py()).view(np.int64) for c in table["counts"]])
        return _table(part_schema, [{"kind": table["kind"][0].as_py(), "part": table["part"][0].as_py(), "keys": pack(keys), "counts": pack(counts)}])

    model_schema = _schema(_MODEL)

    def build(table: pa.Table) -> pa.Table:
        whole = merge(table)
        rows = whole.to_pylist()
        if rows[0]["kind"] == GRAMS:
            tree = Tree(unpack(rows[0]["keys"]), unpack(rows[0]["counts"]).view(np.int64))
            rows += [{"kind": NODES, "node": int(a), "n0": b, "n1": c, "below": d} for a, b, c, d in zip(tree.node, tree.n0, tree.n1, tree.below, strict=True)]
        else:
            counts = unpack(rows[0]["counts"]).view(np.int64)
            rows.append({"kind": NODES, "node": -1, "n0": float(counts.sum()), "n1": float(np.count_nonzero(counts)), "below": 0.0})
        return _table(model_schema, rows)

    counted = asked.select("kind", "part", "salt", "keys", "counts")
    if salts > 1:  # sums of some blocks first, so that no task gets the requests of all
        counted = counted.groupBy("kind", "part", "salt").applyInArrow(merge, "kind int, part int, keys binary, counts binary")
    model = stage(counted.select("kind", "part", "keys", "counts").groupBy("kind", "part").applyInArrow(build, _MODEL), "ctw-model")
    tops = model.filter(F.col("kind") == NODES).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    # At most 256 contexts of one byte times 255 nodes, and one row for the words.
    top = tops.toArrow()
    is_word = np.array(top["node"].to_pylist(), np.int64) == -1
    words = top.filter(pa.array(is_word)).to_pylist()
    n_train = int(size.train) + int(words[0]["n0"] if words else 0)
    distinct = int(words[0]["n1"] if words else 0) + (size.train > 0)
    mixed, weight = upper(top.filter(pa.array(~is_word)))
    shared = docs.sparkSession.sparkContext.broadcast((mixed, weight))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = unpack(r["keys"]), unpack(r["counts"]).view(np.int64)
                if r["kind"] == GRAMS:
                    tree = Tree(keys, counts)
                    values = pack_values(tree.log10(shared.value[0][tree.node.astype(np.int64)], shared.value[1][tree.node.astype(np.int64)]))
                else:
                    values = pack(counts)
                yield {"kind": [r["kind"]], "part": [r["part"]], "keys": [r["keys"]], "vals": [values]}

    values = map_batches(model.filter(F.col("kind") != NODES).select("kind", "part", "keys", "counts"), valued, "kind int, part int, keys binary, vals binary")
    values = values.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    reply_schema = _schema("kind int, block long, keys binary, vals binary")

    def reply(have: pa.Table, want: pa.Table) -> pa.Table:
        if not have.num_rows or not want.num_rows:
            return _table(reply_schema, [])
        keys, kind = unpack(have["keys"][0].as_py()), want["kind"][0].as_py()
        mine = unpack_values(have["vals"][0].as_py()) if kind == GRAMS else unpack(have["vals"][0].as_py()).view(np.int64)
        rows = []
        for w in want.select(["block", "keys"]).to_pylist():
            at = mine[np.searchsorted(keys, unpack(w["keys"]))]
            rows.append({"kind": kind, "block": w["block"], "keys": w["keys"], "vals": pack_values(at) if kind == GRAMS else pack(at)})
        return _table(reply_schema, rows)

    replies = values.groupBy("kind", "part", "salt").cogroup(asked.select("kind", "block", "part", "salt", "keys").groupBy("kind", "part", "salt")).applyInArrow(reply, "kind int, block long, keys binary, vals binary")
    score_schema = _schema(_SCORES)
    floor = np.log10(n_train + distinct + 1)

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["kind"] == TEXT)
        body, at, texts = zstandard.decompress(head["text"]), 0, []
        while at < len(body):
            n = int.from_bytes(body[at : at + 8], "little")
            texts.append(body[at + 8 : at + 8 + n])
            at += 8 + n
        del body
        known = np.unpackbits(np.frombuffer(head["vals"], np.uint8), count=len(texts))
        ids = [int(i) if k else None for i, k in zip(np.frombuffer(head["keys"], np.int64), known, strict=True)]
        ours = [r for r in rows if r["kind"] == GRAMS]
        find = Lookup(np.concatenate([unpack(r["keys"]) for r in ours]))
        logs = np.concatenate([unpack_values(r["vals"]) for r in ours])
        model_scores = []
        for a, b in _chunks(texts):
            keys, sizes = grams(texts[a:b])
            model_scores += np.add.reduceat(logs[find(keys)], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.float64).tolist()
        del find, logs
        asked_words = [r for r in rows if r["kind"] == WORDS]
        spelled = list({w for t in texts for w in t.split()})
        seen: dict[bytes, int] = {}
        if spelled:
            where = Lookup(np.concatenate([unpack(r["keys"]) for r in asked_words]))(word_keys(spelled))
            seen = dict(zip(spelled, np.concatenate([unpack(r["vals"]).view(np.int64) for r in asked_words])[where].tolist(), strict=True))
        end, out = int(size.train), []
        for i, t, s in zip(ids, texts, model_scores, strict=True):
            c = np.array([*[seen[w] for w in t.split()], end], float)
            out.append({
                "doc_id": i, "held_out": held_out(i), "n_tokens": len(c), "n_known": int(np.count_nonzero(c)), "train_tokens": n_train,
                "base_score": float((np.log10(c + 1) - floor).sum()), "score": s})
        return _table(score_schema, out)

    blocks = texts.select("kind", "block", "keys", F.col("counts").alias("vals"), "text").unionByName(replies.select("kind", "block", "keys", "vals", F.lit(None).cast("binary").alias("text")))
    return blocks.groupBy("block").applyInArrow(finish, _SCORES)
