"""Importance resampling against its definition, run by run."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import frame, odd_texts

from fairline.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text):
    words = WORD.findall((text or "").encode().lower())
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r) % 10_000 for r in runs]


def brute(ids, texts, target):
    s, t = (Counter(b for x in rows for b in buckets_of(x)[1]) for rows in (texts, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, x in zip(ids, texts):
        words, held = buckets_of(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in held)
        rows.append([i, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted(repr(r[:5]) for r in rows)


def found(docs, target):
    rows = resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(repr(list(r)) for r in rows)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcéd1") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "ab cd ab"), (2, None), (3, ""), (4, "É1 ab-cd")], "item_id int, text string")


def test_resampling_equals_definition(spark, target):
    texts = [*odd_texts(), *corpus(3, 200), "x" * 300 + " a " + "y" * 256 + " b " + "z" * 255 + " c", "a\x00b\x7fc日本", "﻿A 9"]
    held = ["ab cd ab", None, "", "É1 ab-cd"]
    ids = list(range(len(texts)))
    assert found(frame(spark, texts).repartition(7), target) == brute(ids, texts, held)


def test_resampling_pieces(spark, target, monkeypatch):
    texts = corpus(5, 90)
    assert [x.tolist() for x in resampling.features([t.encode() for t in texts])[:1]] == [[len(buckets_of(t)[0]) for t in texts]]
    monkeypatch.setattr(resampling, "PIECE", 50)
    assert found(frame(spark, texts), target) == brute(list(range(90)), texts, ["ab cd ab", None, "", "É1 ab-cd"])


def test_resampling_ties_and_empty(spark, target):
    assert resampling.resample(frame(spark, []), target).count() == 0
    text = " ".join("abcdefghijklmnopqrstu")
    drawn = resampling.resample(frame(spark, [text] * 40, [3] * 20 + [None] * 20), target).collect()
    assert sorted(r.rank for r in drawn if r.rank) == [1, 2] and len(drawn) == 40
    nothing = spark.createDataFrame([], "item_id int, text string")
    texts = corpus(6, 45)
    assert found(frame(spark, texts), nothing) == brute(list(range(45)), texts, [])


def test_ranges_rank_like_one_sort(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 50) for i in range(500)], "place long, score long")
    got = resampling.ranked(rows, 123, F.desc("score"), F.asc("place")).collect()
    want = sorted(((-((i * 7919) % 50), i) for i in range(500)))[:123]
    assert {r.place: r["rank"] for r in got} == {i: k for k, (_, i) in enumerate(want, 1)}
