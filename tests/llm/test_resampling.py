"""Importance resampling against plain Python, on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sparsonde.llm import resampling

from .conftest import table, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, lengths):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    return w, [" ".join(w[i : i + n]) for n in range(lengths[0], lengths[1] + 1) for i in range(len(w) - n + 1)]


def _plain(docs, target, lengths, buckets, share, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, _features(text, lengths)[1]))
    for text in target:
        t.update(map(bucket, _features(text, lengths)[1]))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        w, f = _features(text, lengths)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(may[: share * len(may) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("lengths", "hot"), [((1, 1), 1 << 17), ((1, 1), 40), ((1, 3), 300), ((2, 2), 1)])
def test_equals_plain(spark, odd_rows, monkeypatch, lengths, hot):
    monkeypatch.setattr(resampling, "HOT", hot)
    monkeypatch.setattr(resampling, "AT_ONCE", 3000)
    rng = random.Random(8)
    more = [(100 + i, words(rng, rng.randrange(10, 60), 80) + ", É-one A1! b\x00c\x7fd", "a", "en") for i in range(60)]
    rows = [*odd_rows, *more, (200, "same words " * 900, "a", "en"), (201, "same words " * 900, "a", "en")]
    target = ["w1 w2 w3 w4 w5", None, "", "same WORDS w7", "only here"]
    got = resampling.resample(table(spark, rows).repartition(3), spark.createDataFrame([(x, 1) for x in target], "text string, n long"), lengths, 97, 30, 20, 5)
    assert sorted(map(tuple, got.collect()), key=str) == _plain([(r[0], r[1]) for r in rows], target, lengths, 97, 30, 20, 5)


def test_nothing_on_either_side(spark):
    rows = [(1, None, "a", "en"), (2, "one two", "a", "en")]
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(table(spark, rows), none)
    assert sorted(map(tuple, got.collect()), key=str) == _plain([(r[0], r[1]) for r in rows], [], (1, 1), 10000, 10, 20, 2024)
    assert resampling.resample(table(spark, rows).limit(0), none).count() == 0


def test_drawn_documents_look_like_the_target(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 50, 100) if i % 2 else " ".join(f"v{rng.randrange(100)}" for _ in range(50)), "a", "en") for i in range(300)]
    target = spark.createDataFrame([(" ".join(f"v{rng.randrange(100)}" for _ in range(50)),) for _ in range(40)], "text string")
    got = resampling.drawn(table(spark, rows), target, share=10).collect()
    assert len(got) == 30 and sorted(r["rank"] for r in got) == list(range(1, 31)) and sum(r["doc_id"] % 2 == 0 for r in got) >= 29
