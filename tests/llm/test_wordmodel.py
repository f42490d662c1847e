"""The language model of word pairs against plain Python, and what it grows with."""

import collections
import math
import random

import numpy as np
import pytest

from sparsonde.llm import perplexity, wordmodel

from .conftest import table, words


def plain(texts):
    """Log-probability of each text by the pairs of all others."""
    pairs = [collections.Counter(zip(["<s>", *t.split()], t.split(), strict=False)) for t in texts]
    every = sum(pairs, collections.Counter())
    before = collections.Counter(w for _, w in every)
    n = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    high, low, base, out = wordmodel.discounts(n(every)), wordmodel.discounts(n(before)), 1 / (len(before) + 1), []
    for own in pairs:
        left = +(every - own)
        single = collections.Counter(w for _, w in left)
        held = sum(low[min(c, 3)] for c in single.values())
        lp = 0.0
        for (v, w), times in own.items():
            p = (single[w] - low[min(single[w], 3)] + held * base) / len(left) if left else base
            of = [c for (x, _), c in left.items() if x == v]
            if of:
                c = left[v, w]
                p = (c - high[min(c, 3)] + sum(high[min(x, 3)] for x in of) * p) / sum(of)
            lp += times * math.log(p)
        out.append(lp)
    return out


def test_word_scores(spark, monkeypatch):
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(1, 60), 25) + (" own" + str(i)) * (i % 3) for i in range(30)] + ["a b a b a b", "lone"]
    texts += [texts[0]]
    expected = plain(texts)
    rows = [(i, t, "a", "en") for i, t in enumerate(texts)] + [(100 + i, t, "a", "de") for i, t in enumerate(texts)] + [(200, "", "a", "en"), (201, "only one", "a", "xx")]
    for piece, part in ((1 << 23, 1 << 24), (300, 500)):
        monkeypatch.setattr(wordmodel, "PIECE", piece)
        monkeypatch.setattr(wordmodel, "PART", part)
        got = {x.doc_id: x.word_lp for x in wordmodel.word_scores(perplexity._language(table(spark, rows))).collect()}
        assert len(got) == len(rows) and got[200] == 0 and got[201] == pytest.approx(2 * math.log(1 / 3))
        assert [got[i] for i in range(len(texts))] == pytest.approx(expected) and [got[100 + i] for i in range(len(texts))] == pytest.approx(expected)


def test_words_in_random_order(spark):
    rng = random.Random(6)
    after = {f"w{i}": [f"w{rng.randrange(300)}" for _ in range(4)] for i in range(300)}

    def prose(n):
        out = [f"w{rng.randrange(300)}"]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    rows = [(i, " ".join(prose(300)), "a", "en") for i in range(120)]
    for i in range(3):
        mixed = prose(300)
        rng.shuffle(mixed)
        rows.append((1000 + i, " ".join(mixed), "a", "en"))
    rows += [(2000 + i, rows[0][1] + f" w{i}", "a", "en") for i in range(50)]  # copies are far below the others and must not widen the band
    out = {x.doc_id: x for x in perplexity.quality(table(spark, rows)).collect()}
    assert all(x.kept for i, x in out.items() if not 1000 <= i < 2000)
    for x in (out[1000 + i] for i in range(3)):  # rejected by the language model alone: the spelling is that of the others
        assert not x.kept and x.word_perplexity > x.high_word
        assert x.low_spelling <= x.spelling_perplexity <= x.high_spelling and x.low_byte <= x.byte_perplexity <= x.high_byte


def test_model_grows_with_the_corpus(spark):
    rng = random.Random(3)
    sizes = []
    for n in (20, 200):
        df = perplexity._language(table(spark, [(i, words(rng, 100, 10**6), "a", "en") for i in range(n)]))
        state = wordmodel._pieces(df, "bigint")
        counted = wordmodel._counted(state, 40, 2)
        sizes.append(sum(x.stats[4] for x in wordmodel._continued(state, counted, 40, 2).filter("kind = 2").collect()))
    assert sizes[1] > 9 * sizes[0]


def test_numbers_as_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        x = np.sort(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        assert np.array_equal(wordmodel._of_rising(wordmodel._rising(x)), x)
        y = rng.integers(0, 1 << 40, n)
        assert np.array_equal(wordmodel._of_small(wordmodel._small(y)), y)
