"""The Jaccard join against all pairs."""

import os
import random

import pyarrow.parquet as pq
from test_llm import DATA, frame, have_data, odd_texts, united

from fairline.llm import jaccard
from fairline.llm.queries import QUERIES


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root = united(len(sets), links)
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


def found(spark, texts, **more):
    rows = jaccard.near_duplicates(frame(spark, texts).repartition(6), **more).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def families(seed, n=40, long=60):
    """Chains of edits: neighbours are similar, ends are not; some just above and some just below the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(1, long))]
        if rng.random() < 0.4:
            words[rng.randrange(len(words)) :] = passage
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words.append(word())
    rng.shuffle(texts)
    return texts


def test_join_equals_all_pairs(spark):
    texts = [*odd_texts(1), *families(1), *families(2)]
    got = found(spark, texts)
    assert got == brute(texts)
    assert 1 < len({r[2] for r in got}) < len(texts) - 40


def test_join_without_leaders_and_with_salt(spark, monkeypatch):
    """All links through the matrix alone, every token dealt out by salt, texts taken one at a time."""
    texts = families(3, 30)
    monkeypatch.setattr(jaccard, "leader_pairs", lambda nodes, percent: nodes.select(nodes.key.alias("a"), nodes.key.alias("b")).limit(0))
    monkeypatch.setattr(jaccard, "PIECE", 10)
    order = jaccard.token_order
    monkeypatch.setattr(jaccard, "token_order", lambda *a: (order(*a)[0], 0))
    assert found(spark, texts) == brute(texts)


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(94)]  # 90 shingles
    texts = [" ".join(base), " ".join(["x"] * 5 + base[5:]), " ".join(base[:-10]), " ".join(base[:-18]), " ".join(base[:-19])]
    assert found(spark, texts) == brute(texts)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(150):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 100
    got = found(spark, texts)
    assert got == brute(texts) and {r[2] for r in got} == {0}


def test_few_and_repeated_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [None, "", " \n", "a", "A", "a b"]) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5)]
    rows = jaccard.near_duplicates(frame(spark, ["a b", "a b", "a b", "", "c"], [7, 7, None, None, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 1, -1), (-1, 1, 7), (7, 1, 7), (7, 1, 7)]


@have_data
def test_join_on_documents(spark):
    rows = pq.read_table(os.path.join(DATA, "documents.parquet"), columns=["doc_id", "text"]).to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == list(range(len(rows)))
    got = QUERIES["op13_ngram_jaccard_join"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == brute([r["text"] for r in rows])
