"""Leaks that the latent space alone doesn't find."""

import random

import pyarrow as pa

from sparsonde.llm import decontaminate

from .conftest import table, words


def test_frequent_and_short_leaks(spark):
    rng = random.Random(31)
    items = [(i, words(rng, [5, 15, 38, 56][i % 4], 600)) for i in range(40)]
    rows, expected = [], {}
    for k in range(900):
        text = words(rng, 70, 600)
        leak = k % 4 if k % 3 else (k // 3) % 40  # four items, of each size, in two thirds of the texts
        rows.append((k, text + " " + items[leak][1] + " " + words(rng, 60, 600), "a", "en"))
        expected[k] = leak
    rows += [(5000 + k, words(rng, 150, 600), "b", "en") for k in range(100)]
    out = decontaminate.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id for x in out if x.contaminated and x.doc_id < 5000} == set(expected)
    assert all(x.lcs == 1 for x in out if x.doc_id < 5000)


def test_recall_of_paraphrases(spark):
    """Passages with a part of an item's words changed, against the longest common subsequences of all passages and items."""
    rng = random.Random(41)
    items = [(i, words(rng, rng.randrange(20, 60), 900)) for i in range(40)]
    rows = []
    for k in range(240):
        w = items[k % 40][1].split()
        kept = [x if rng.random() > rng.choice([0.1, 0.25, 0.35, 0.5]) else f"w{rng.randrange(900)}" for x in w]
        rows.append((k, words(rng, rng.randrange(10, 200), 900) + " " + " ".join(kept) + " " + words(rng, rng.randrange(10, 120), 900), "a", "en"))
    out = {x.doc_id: x.contaminated for x in decontaminate.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    pieces = decontaminate.pieces_of(items)
    leaked = set()
    for k, t, *_ in rows:
        h = decontaminate.bare_hashes(next(decontaminate.blocks(pa.array([t])))).tolist()
        for at in range(0, len(h), decontaminate.BLOCK_WORDS):
            passage = h[at : at + 2 * decontaminate.BLOCK_WORDS]
            for p in pieces:
                share = decontaminate.common(p.masks, len(p.words), passage) / len(p.words)
                answer = decontaminate.common(p.answer_masks, len(p.answer), passage) / len(p.answer)
                if share >= decontaminate.LCS or (share >= decontaminate.PARAPHRASE and answer >= decontaminate.ANSWER):
                    leaked.add(k)
    found = {k for k, x in out.items() if x}
    print(f"recall {len(found & leaked)} of {len(leaked)}")
    assert found <= leaked and len(leaked) > 100 and len(found) >= 0.95 * len(leaked)


def test_short_items(spark):
    rows = [(1, "yes", "a", "en"), (2, "well yes indeed", "a", "en"), (3, "Forty two!", "a", "en"), (4, "he said forty two of them", "a", "en")]
    out = decontaminate.contamination(table(spark, rows), spark.createDataFrame([(1, "yes"), (2, "forty two")], "item_id long, text string")).collect()
    assert {x.doc_id for x in out if x.contaminated} == {1, 3}
