"""Collocations against their definition, with and without colliding fingerprints."""

import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import compare, connect
from test_llm import DATA, have_data, odd_texts

from fairline.llm import hashing, phrasing
from fairline.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, width=4):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, width + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and b >= least and inside(q) for q, b in count.items()):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcéß日") for _ in range(rng.randint(1, 3))) for _ in range(25)]
    fixed = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(fixed), rng.choice(words).upper(), "Old  rule\tX"]) + rng.choice([" ", " ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 30))]
        rows.append((i, "".join(parts), rng.choice(["en", "de", None, "und"]), "x", 0, "y"))
    return rows + [(None, t, "en", "x", 0, "y") for t in odd_texts()]


def found(spark, rows, least, top, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = phrasing.collocations(docs, least=least, top=top, **more)
    return sorted(tuple(r)[:8] for r in got.collect())


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 0x1F])
def test_collocations_equal_definition(spark, mask):
    rows = corpus(1)
    got = found(spark, rows, 6, 40, mask=mask)
    assert got == brute(rows, 6, 40) and len(got) > 60


def test_collocations_in_small_parts(spark, monkeypatch):
    for name, size in (("PIECE", 64), ("HELD", 100), ("TEXT", 70)):
        monkeypatch.setattr(phrasing, name, size)
    rows = corpus(2)
    assert found(spark, rows, 5, 2000) == brute(rows, 5, 2000)


def test_collocations_point_to_the_phrase(spark):
    rows = corpus(3)
    texts = {i: t for i, t, *_ in rows}
    for r in phrasing.collocations(spark.createDataFrame(rows, SCHEMA), least=6).filter("doc_id is not null").collect():
        tail = texts[r.doc_id].encode()[r.start :].decode().translate(LOWER)
        assert re.sub(r"[\x20\x09]+", " ", tail).startswith(r.phrase)


def test_collocations_of_nothing(spark):
    assert found(spark, [], 1, 5) == []
    assert found(spark, [(1, None, None, "", 0, ""), (2, "a b", None, "", 0, "")], 2, 5) == []
    assert found(spark, [(1, "a b", None, "", 0, "")] * 2, 2, 5) == [("und", 1, "a b", 2, 2, 2, 4, 1000000)]


def test_bitmap_holds_all(spark):
    values = [(random.Random(k).getrandbits(64) - (1 << 63),) for k in range(3000)] + [(0,), (-1,)]
    import numpy as np

    held = hashing.bitmap(spark.createDataFrame(values, "v long"), "v", 20)
    assert len(held) == 1 << 17 and hashing.in_bitmap(held, np.array([v[0] for v in values], np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert hashing.in_bitmap(held, others).mean() < 0.001


@have_data
def test_collocations_equal_sql(spark):
    assert compare(QUERIES["op11_phrase_collocations"](spark, DATA), connect(DATA), ORACLES["op11_phrase_collocations"])[0] is None
