"""Each operator on odd rows, on an empty table, and on rows with clashing columns."""

import math

import pytest

from pyspark.sql import functions as F

from sparsonde.llm import decontaminate, html_text, licenses, line_dedup, mixing, neardup, perplexity, shards, substring_dedup, unigram
from sparsonde.llm.queries import TOKENIZERS

from .conftest import table

MODEL, BPE = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def bench(spark, rows=((1, "the quick brown fox jumps over the lazy dog again and again"),)):
    return spark.createDataFrame(list(rows), "item_id long, text string")


RUNS = {
    "quality": lambda s, d: perplexity.quality(d),
    "kept": lambda s, d: perplexity.kept_documents(d),
    "tokens": lambda s, d: unigram.token_counts(d, MODEL),
    "substrings": lambda s, d: substring_dedup.deduplicate(d),
    "mix_plan": lambda s, d: mixing.mix_plan(d),
    "mix": lambda s, d: mixing.mix(d),
    "near": lambda s, d: neardup.near_duplicates(d),
    "near_kept": lambda s, d: neardup.deduplicated(d),
    "leaks": lambda s, d: decontaminate.contamination(d, bench(s)),
    "clean": lambda s, d: decontaminate.clean_documents(d, bench(s)),
    "lines": lambda s, d: line_dedup.deduplicated(d),
    "licenses": lambda s, d: licenses.scan(d),
    "shards": lambda s, d: shards.write_temporary(d, BPE, length=64),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](spark, table(spark, [])).collect() == []


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).repartition(3).cache()


def test_quality(spark, odd, odd_rows):
    out = perplexity.quality(odd).collect()
    assert len(out) == len(odd_rows)
    by = {x.doc_id: x for x in out if x.doc_id is not None}
    for i in (1, 2, 3):
        assert by[i].n_words == 0 and by[i].base_failed and not by[i].kept and by[i].word_perplexity is None
    assert by[12].n_dup_lines == 2 and by[11].n_repeat_words == 80 and by[9].n_words == 30_000
    kept = perplexity.kept_documents(odd)
    assert kept.columns == odd.columns
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in out if x.kept} | {None}


def test_tokens(spark, odd, odd_rows):
    out = unigram.token_counts(odd, MODEL).collect()
    assert len(out) == len(odd_rows)
    assert {x.doc_id: x.n_tokens for x in out if x.doc_id in (1, 2)} == {1: 0, 2: 0}


def test_substrings(spark, odd, odd_rows):
    out = substring_dedup.deduplicate(odd).collect()
    assert len(out) == len(odd_rows)
    by = {x.doc_id: x for x in out if x.doc_id is not None}
    assert by[6].n_removed == by[7].n_removed == 120 and by[10].n_removed == 240
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0
    assert by[9].n_removed == 0 and by[4].n_removed == 0 and by[11].n_removed == 80


def test_mixing(spark, odd, odd_rows):
    out = mixing.mix_plan(odd).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= x.taken <= 2 * x.size for x in out)
    assert {x.source_size for x in out if x.source == "d"} == {sum(x.size for x in out if x.source == "d")}
    total = sum(x.size for x in out)
    assert math.isclose(sum({x.source: x.target for x in out}.values()), 1.5 * total, rel_tol=1e-9)
    made = mixing.mix(odd)
    assert made.columns == odd.columns
    copies = {}
    for x in out:
        copies[x.doc_id, x.size] = copies.get((x.doc_id, x.size), 0) + x.copies
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD))
    assert {(x.doc_id, x.n_): x["count"] for x in made.withColumn("n_", size).groupBy("doc_id", "n_").count().collect()} == {k: v for k, v in copies.items() if v}


def test_near(spark, odd, odd_rows):
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    by = {x.doc_id: x for x in out if x.doc_id is not None}
    assert by[7].component_id == by[8].component_id == by[6].component_id == 6
    assert all(by[i].kept and by[i].component_id == i for i in (1, 2, 3, 4, 5, 9, 13))
    assert all(x.kept and x.component_id is None for x in out if x.doc_id is None)
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [1, 2, 3, 4, 5, 6, 6, 9, 11, 12, 13, 14]


def test_leaks(spark, odd, odd_rows):
    item = odd_rows[8][1].split()[500:540]
    b = bench(spark, [(5, " ".join(item)), (6, None), (7, ""), (None, "a b c"), (8, "not in any of the texts at all, at least not in this order of words")])
    out = decontaminate.contamination(odd, b).collect()
    assert len(out) == len(odd_rows)
    assert {x.doc_id: x.item_id for x in out if x.contaminated} == {9: 5}
    clean = decontaminate.clean_documents(odd, b)
    assert clean.columns == odd.columns and clean.count() == len(odd_rows) - 1
    assert decontaminate.contamination(odd, bench(spark, [])).filter("contaminated").count() == 0


def test_lines(spark, odd, odd_rows):
    out = line_dedup.deduplicated(odd)
    assert set(odd.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    by = {x.doc_id: x for x in rows if x.doc_id is not None}
    assert by[12].n_lines == 3 and by[12].n_dropped == 2 and by[12].kept_text == "Same line here, of some length."
    assert by[6].n_dropped == 0 and by[7].n_dropped == 1 and by[7].kept_text == ""
    assert by[10].n_dropped == 2 and by[1].kept_text == "" and by[3].n_lines == 0


def test_licenses(spark, odd, odd_rows):
    rows = [*odd_rows, (20, "Intro. " * 40 + "\nReleased under the MIT License.\n" + "outro " * 30, "a", "en")]
    out = licenses.scan(table(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {x.doc_id: x.licenses for x in out if x.n_licenses} == {20: ["MIT"]}


def test_shards(spark, odd, odd_rows):
    out = shards.write_temporary(odd, BPE, length=64).collect()
    assert sorted(x.slot for x in out) == list(range(len(out)))
    assert {x.doc_id for x in out} == {x[0] for x in odd_rows}
    assert [x.n_tokens for x in out if x.doc_id == 2] == [1]


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "   "), (4, "u", "<p>a"), (5, "u", "no tags &amp; all"), (5, "u", "<script>x</script>"), (None, "u", "<body><p>" + "long text " * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(df).collect()
    assert [(x.page_id, x.text) for x in sorted(out[:6], key=lambda x: (x.page_id, x.text))] == [(1, ""), (2, ""), (3, ""), (4, "a"), (5, ""), (5, "no tags & all")]
    assert out[6].n_chars == len(("long text " * 40_000).strip()) and html_text.extract(df.limit(0)).collect() == []
