"""The stages of the corpus pipeline on odd rows, against the operators they apply."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from sparsonde.llm import decontaminate, mixing, neardup, perplexity

from .conftest import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, copies and near copies, a benchmark passage, junk, nulls, an empty and a long text, as the tables of a folder."""
    rng = random.Random(11)
    passage = words(rng, 40, 900)
    texts = [words(rng, rng.randrange(60, 200), 900) for _ in range(60)]
    near = texts[0].split()
    near[5] = "other"
    texts += [texts[0], " ".join(near), words(rng, 60, 900) + " " + passage + " " + words(rng, 60, 900), "short", "", None, "#### $$$$ " * 40, words(rng, 9000, 900)]
    rows = [(i, t, "en" if i % 7 else None, ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, words(rng, 80, 900), "en", "a", 7), (3, texts[3], "en", "a", 7)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, len(texts)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage_applies_its_operator_to_what_is_left(spark, corpus):
    folder, n = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.store.written(stage(spark, docs, folder), f"test-{name}")
        assert after.columns == columns
        if name == "quality_rules":
            good = {(r["doc_id"]) for r in perplexity.quality(docs).filter("kept").collect()}
            assert {r["doc_id"] for r in after.collect()} == good and n - 4 not in good and n - 2 not in good  # the short one, the symbols
        if name == "near_dedup":
            classes = neardup.near_duplicates(docs, shingle_words=5, percent=80).collect()
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in classes}
            assert not {60, 61} & {r["doc_id"] for r in after.collect()}
        if name == "decontamination":
            found = {r["doc_id"] for r in decontaminate.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).filter("contaminated").collect()}
            assert 62 in found and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()} - found
        if name == "source_mixing":
            copies = Counter()
            for r in mixing.mix_plan(docs).collect():
                copies[r["doc_id"], r["source"]] += r["copies"]
            assert _rows(after.groupBy("doc_id", "source").count()) == sorted(((*k, c) for k, c in copies.items() if c), key=str)
        docs = after
        kept.append(docs.count())
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    slots = [r["slot"] for r in last.collect()]
    assert sorted(slots) == list(range(len(slots))) and len(slots) >= kept[-1] > 0
    assert kept[0] > kept[1] > kept[2]


def test_no_documents_give_no_rows(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
