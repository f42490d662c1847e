"""Operators against plain Python on small texts."""

import collections
import hashlib
import random
import time
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparsonde.llm import decontaminate, licenses, line_dedup, mixing, neardup, perplexity, shards, substring_dedup, textblock, unigram
from sparsonde.llm.components import components
from sparsonde.llm.queries import TOKENIZERS

from .conftest import table, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, RANKS, MODEL = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/piece_bpe_32k.model"
texts = st.lists(st.text(alphabet="ab c\n\té　.Z", max_size=60), max_size=8)


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with exact and near copies of several grades, shared passages and repeated lines."""
    rng = random.Random(9)
    rows, passage, line = [], words(rng, 60, 5000), "A line that many of the texts have in common."
    for g in range(14):
        base = words(rng, rng.choice([30, 80, 150]), 3000).split()
        for _ in range(rng.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            t = " ".join(w)
            if rng.random() < 0.2:
                t += " " + passage
            if rng.random() < 0.4:
                t = t[: len(t) // 2] + "\n" + line[: -rng.choice([1, 1, 2])] + "\n" + t[len(t) // 2 :]
            rows.append((len(rows), t, f"s{g % 3}", "en"))
    rows.append((len(rows), passage, "s0", "en"))
    return rows, table(spark, rows).repartition(4).cache()


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words_and_features(batch):
    for limit in (8, 1 << 20):
        got, sizes = [], []
        for w in textblock.blocks(pa.array(batch, pa.string()), limit=limit):
            raw = w.data.tobytes()
            got += [[raw[a:b].decode() for a, b in zip(w.start[w.at[r] : w.at[r + 1]], w.end[w.at[r] : w.at[r + 1]], strict=True)] for r in range(w.rows)]
            sizes += list(zip(*perplexity.features(w).values(), strict=True))
        assert got == [WORD.findall(t) for t in batch]
        for t, size in zip(batch, sizes, strict=True):
            ws, seen, dup = WORD.findall(t), set(), 0
            for x in t.split("\n"):
                if WORD.search(x):
                    dup += x in seen
                    seen.add(x)
            grams = list(zip(ws, ws[1:], ws[2:], strict=False))
            again = collections.Counter(grams)
            cover = {k for i, g in enumerate(grams) if again[g] > 1 for k in (i, i + 1, i + 2)}
            assert tuple(map(int, size)) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    data = "".join(rng.choice(list("abcd ."), 5000)).encode()
    w = textblock.words(np.frombuffer(data, np.uint8), np.array([0, 2000, len(data)]))
    code, _ = perplexity.grams(w)
    model = perplexity.train(*np.unique(code, return_counts=True))
    for ctx in [*np.unique(code >> 6)[:20], (1 << 18) - 2]:  # seen contexts and one that never was
        every = (np.uint32(ctx) << np.uint32(6)) | np.arange(64, dtype=np.uint32)
        assert np.exp(perplexity.look_up(model, every)).sum() == pytest.approx(1, abs=1e-6)


def test_quality_bands(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 150, 900), "a", "en") for i in range(60)] + [(100 + i, " ".join(rng.choice("QXZ") * 3 + "!#" for _ in range(150)), "a", "en") for i in range(3)]
    rows += [(200, " ".join("Ж" + chr(0x430 + rng.randrange(30)) * rng.randrange(1, 9) for _ in range(150)), "a", "en")]
    out = {x.doc_id: x for x in perplexity.quality(table(spark, rows)).collect()}
    assert all(out[i].kept for i in range(60))
    assert not out[200].kept and not any(out[100 + i].kept for i in range(3))
    assert out[200].byte_perplexity < out[200].low_byte or out[200].byte_perplexity > out[200].high_byte or not out[200].low_word <= out[200].word_perplexity <= out[200].high_word


def test_substrings(corpus):
    rows, df = corpus
    seen = collections.Counter(tuple(w[i : i + 35]) for _, t, *_ in rows for w in [WORD.findall(t)] for i in range(len(w) - 34))
    got = {x.doc_id: x for x in substring_dedup.deduplicate(df).collect()}
    removed = 0
    for i, t, *_ in rows:
        w = WORD.findall(t)
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        removed += len(gone)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert removed


def test_large_index_entries_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 3)
    rng = random.Random(2)
    common = words(rng, 50, 9000)
    rows = [(i, words(rng, rng.randrange(1, 9), 9000) + " " + common + " " + words(rng, 5, 9000), "a", "en") for i in range(40)]
    out = substring_dedup.deduplicate(table(spark, rows)).collect()
    assert {x.n_removed for x in out} == {50}


def test_index_runs(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 60, 9000), "a", "en") for i in range(6)]
    index = substring_dedup.FingerprintIndex(spark)
    for part in (rows[:3], rows[3:]):
        index.add(table(spark, part))
    assert len(index.runs) == 2
    before = {tuple(x) for x in index.read().collect()}
    hits = index.lookup(table(spark, rows[:1])).count()
    index.compact()
    assert len(index.runs) == 1 and {tuple(x) for x in index.read().collect()} == before
    assert index.lookup(table(spark, rows[:1])).count() == hits > 0
    assert index.lookup(table(spark, [(9, words(rng, 60, 9000), "a", "en")])).count() == 0


def test_later_batches_meet_earlier_ones(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 2)
    rng = random.Random(5)
    old = [(i, words(rng, 80, 9000), "a", "en") for i in range(6)]
    index = substring_dedup.FingerprintIndex(spark)
    assert all(x.n_removed == 0 for x in substring_dedup.deduplicate(table(spark, old), index).collect())
    part = " ".join(old[2][1].split()[20:65])
    new = [(10, words(rng, 50, 9000), "a", "en"), (11, words(rng, 9, 9000) + " " + part + " " + words(rng, 9, 9000), "a", "en"), (12, old[0][1], "a", "en"), (13, " ".join(old[1][1].split()[:34]), "a", "en")]
    assert {x.doc_id: x.n_removed for x in substring_dedup.deduplicate(table(spark, new), index).collect()} == {10: 0, 11: 45, 12: 80, 13: 0}
    assert len(index.runs) == 1 and len(index.window_runs) == 4
    plain = substring_dedup.FingerprintIndex(spark, keep_windows=False)
    plain.add(table(spark, old))
    assert all(x.n_removed == 0 for x in substring_dedup.deduplicate(table(spark, new), plain).collect())


def test_index_is_reopened_and_survives_a_crash(spark, monkeypatch):
    rng = random.Random(15)
    old, lost = [(i, words(rng, 80, 9000), "a", "en") for i in range(4)], [(9, words(rng, 80, 9000), "a", "en")]
    index = substring_dedup.FingerprintIndex(spark)
    index.add(table(spark, old[:2]))
    with monkeypatch.context() as m:
        m.setattr(substring_dedup.store, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            index.add(table(spark, lost))  # its run is written, but not part of the index
    again = substring_dedup.FingerprintIndex(spark, index.path)
    assert len(again.runs) == 1 and again.buckets == index.buckets
    again.add(table(spark, old[2:]))
    again.compact()
    third = substring_dedup.FingerprintIndex(spark, index.path)
    assert third.lookup(table(spark, old)).count() > 0 and third.lookup(table(spark, lost)).count() == 0
    new = [(i + 20, t, s, lang) for i, t, s, lang in [*old, *lost]]
    assert [x.n_removed for x in sorted(substring_dedup.deduplicate(table(spark, new), third).collect())] == [80] * 4 + [0]
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, index.path, window=20)


@pytest.mark.parametrize("group", [1, 4, 1024])
def test_windows_alone_in_their_groups(spark, monkeypatch, group):
    """A frequent 18-gram in many contexts: some windows repeat, and their copies are in other groups."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rng = random.Random(31)
    gram = words(rng, 18, 9000)
    contexts = [(words(rng, 30, 9000), words(rng, 30, 9000)) for _ in range(12)]
    rows = []
    for i in range(40):
        left, right = contexts[rng.randrange(12)] if rng.random() < 0.5 else (words(rng, 30, 9000), words(rng, 30, 9000))
        rows.append((i, f"x{i} {left} {gram} {right} y{i}", "a", "en"))
    seen = collections.Counter(tuple(w[j : j + 35]) for _, t, *_ in rows for w in [t.split()] for j in range(len(w) - 34))
    got = {x.doc_id: x.n_removed for x in substring_dedup.deduplicate(table(spark, rows)).collect()}
    for i, t, *_ in rows:
        w = t.split()
        assert got[i] == len({k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)})


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(corpus, n):
    rows, df = corpus
    sets = {i: frozenset(zip(*[w[k:] for k in range(n)], strict=False)) for i, t, *_ in rows for w in [WORD.findall(t.lower())]}
    comp = {i: i for i in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(df, n, 80).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_similar_pairs_share_a_key():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (80, 10, 10))
        x, y = (neardup.signature(np.concatenate([common, s])) for s in (a, b))
        keys = neardup.bucket_keys(np.array([x, y]))
        met += bool((keys[0] == keys[1]).any()) and (x != y).sum() <= neardup.MOST
        far = (x[:64] != y[:64]).sum()
        assert far > 29 or (keys[0] == keys[1]).any()  # the pigeonhole guarantee
    assert met == 300


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng = random.Random(8)
    base = words(rng, 100, 9000).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 4, 8])):
            w[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "a", "en"))
    test_near_duplicates((rows, table(spark, rows)), 4)


def classes_of(sets, percent=80):
    """The smallest id that each set reaches over links of similar sets; pairs are found by common members."""
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            comp[x] = x = comp[comp[x]]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = collections.Counter((i, j) for ids in holders.values() if len(ids) < 300 for a, j in enumerate(ids) for i in ids[:a])
    shared = sum(len(ids) >= 300 for ids in holders.values())  # of members in nearly all sets each pair has at most so many more
    for (i, j), n in both.items():
        if 100 * (n + shared) >= percent * (len(sets[i]) + len(sets[j]) - n - shared):
            n = len(sets[i] & sets[j])
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_texts_of_one_template(spark):
    """Texts that share three quarters of their words, some of which are near copies: candidates are linear in rows, no link is lost."""
    rng = random.Random(4)
    template = words(rng, 430, 9000)
    rows = []
    for i in range(1500):
        if i % 10 == 9:  # a near copy of the text before, with two of its own words changed
            w = rows[-1][1].split()
            for _ in range(2):
                w[rng.randrange(len(w))] = f"e{i}"
            rows.append((i, " ".join(w), "a", "en"))
        else:
            rows.append((i, template + " " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(68)), "a", "en"))
    sets = {i: frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t, *_ in rows}
    want = classes_of(sets)
    assert sum(i != c for i, c in want.items()) == 150
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(table(spark, rows), 5, 80).collect()}
    assert got == want
    texts = spark.createDataFrame([(i, t) for i, t, *_ in rows], "node long, text string")
    rare = neardup.rare_shingles.rare_first(neardup._shingles(texts, 5), 80).cache()
    assert neardup.rare_shingles.all_pairs(rare, spark.createDataFrame([], "node long, comp long"), 80).count() < 300


def test_rare_shingles_lose_no_pair(spark, monkeypatch):
    """All pairs of random sets of many sizes, in blocks of few rows and with components of all kinds."""
    monkeypatch.setattr(neardup.rare_shingles, "BLOCK", 3)
    rng = random.Random(12)
    sets = {}
    for g in range(12):
        base = [rng.randrange(400) for _ in range(rng.choice([3, 12, 40]))] + [rng.randrange(10**9) for _ in range(rng.choice([1, 10, 30]))]
        for _ in range(10):
            kept = {x if rng.random() < 0.93 else rng.randrange(10**9) for x in base if rng.random() < 0.97}
            sets[len(sets)] = kept or {g}
    members = spark.createDataFrame([(i, len(s), x) for i, s in sets.items() for x in s], "node long, size long, key long")
    comp = {i: i - i % rng.choice([1, 1, 2, 10]) for i in sets}
    labels = spark.createDataFrame(list(comp.items()), "node long, comp long")
    rare = neardup.rare_shingles.rare_first(members, 80).cache()
    like = {(i, j) for j in sets for i in range(j) if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    found = {tuple(x) for x in neardup.rare_shingles.all_pairs(rare, labels, 80).collect()}
    assert len(like) > 50 and like <= found and all(comp[i] != comp[j] for i, j in found)
    assert {tuple(x) for x in neardup.rare_shingles.star_pairs(rare, labels, 80).collect()} <= found


def test_crowded_buckets_equal_brute_force(corpus, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 0)
    monkeypatch.setattr(neardup.rare_shingles, "BLOCK", 2)
    test_near_duplicates(corpus, 4)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
@settings(max_examples=3, deadline=None)
def test_components(spark, pairs):
    comp = {x: x for p in pairs for x in p}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_lines(spark, corpus):
    rng = random.Random(12)
    short = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    rows = [*corpus[0], (9_000, "The cat sat on\nThe cat sat om\nThe cat sat", "a", "en"), *[(9_001 + i, "\n".join(short[i::6]), "a", "en") for i in range(6)]]
    df = table(spark, rows)
    first, order = {}, {}
    for i, t, *_ in rows:
        for k, x in enumerate(t.split("\n")):
            if WORD.search(x):
                first.setdefault(x, (i, k))

    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    lines = list(first)
    assert sum(len(x) < 16 for x in lines) > 20
    for a in lines:
        order[a] = any(first[b] < first[a] and close(a, b) for b in lines if b != a)
    assert any(order.values())
    got = {x.doc_id: x for x in line_dedup.deduplicated(df).collect()}
    for i, t, *_ in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if not WORD.search(x) or (first[x] == (i, k) and not order[x])]
        assert got[i].kept_text == "\n".join(kept)


def test_a_document_of_many_equal_lines(spark):
    df = table(spark, [(1, "\n".join(["the same line again"] * 300_000 + ["another"]), "a", "en"), (2, "the same line again", "a", "en")])
    began = time.perf_counter()
    got = {x.doc_id: x for x in line_dedup.deduplicated(df).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n_dropped == 299_999 and got[1].kept_text == "the same line again\nanother" and got[2].kept_text == ""


@given(st.lists(st.text(alphabet="abcdeñé .\n中🙂▁", max_size=40), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_unigram_counts(batch):
    import sentencepiece.sentencepiece_model_pb2 as pb
    from tokenizers import Tokenizer, models, pre_tokenizers

    global _exact
    if "_exact" not in globals():
        m = pb.ModelProto()
        m.ParseFromString(open(MODEL, "rb").read())
        _exact = Tokenizer(models.Unigram([(p.piece, float(p.score)) for p in m.pieces], 0, True))
        _exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    model = unigram.Unigram.load(MODEL)
    for t in batch:
        pieces = [p for p in re.split("(?= )", t.replace("▁", " ")) if p]
        assert sum(model.count("▁" + p.removeprefix(" ")) for p in pieces) == len(_exact.encode(t, add_special_tokens=False).ids)


def test_unigram_ties():
    # equal scores: the path whose last piece is the longest stays
    model = unigram.Unigram({"a": -1.0, "b": -1.0, "ab": -2.0, "c": -3.0, "abc": -5.0})
    assert model.count("ab") == 1 and model.count("abc") == 1
    assert unigram.Unigram({"a": -1.0, "b": -1.0, "ab": -2.5}).count("ab") == 2
    assert unigram.Unigram({"a": -1.0}).count("aéa") == 4  # an unknown character counts its bytes


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4096, 4097, 50_001])
def test_feistel(n):
    slots = shards.feistel(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 90:
        assert (slots != shards.feistel(np.arange(n), n, 8)).any() and (slots != np.arange(n)).any()


def test_shards_round_trip(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    rows, df = corpus
    path = str(tmp_path / "out")
    place = shards.write_shards(df, RANKS, path, length=32, shard=16).collect()
    seqs = list(shards.read_slots(path, 0, 10**9))
    assert len(seqs) == len(place) == shards.read_manifest(path).sequences
    t = Tokenizer.from_file(BPE)
    for i, text, *_ in rows:
        mine = sorted((x for x in place if x.doc_id == i), key=lambda x: x.part)
        assert [y for x in mine for y in seqs[x.slot][: x.n_tokens].tolist()] == [*t.encode(text).ids, shards.EOS]
    resumed = list(shards.read_slots(path, 21, 9))
    assert all((a == b).all() for a, b in zip(resumed, seqs[21:30], strict=True))
    assert all((a == b).all() for a, b in zip(shards.read_slots(f"file:{path}", 21, 9, spark), seqs[21:30], strict=True))
    order = shards.feistel(np.arange(len(place)), len(place), 20240611)  # of the sequences by doc_id and part
    assert [x.slot for x in sorted(place, key=lambda x: (x.doc_id, x.part))] == order.tolist()


@pytest.mark.parametrize("ways", [1, 5])
def test_slots_do_not_depend_on_the_split(spark, tmp_path, ways):
    rng = random.Random(8)
    rows = [(None if i % 9 == 0 else i % 40, None if i % 31 == 0 else words(rng, rng.randrange(0, 90)), "s", "en") for i in range(200)]
    rows += [(3, "again and again", "s", "en")] * 50  # repeated rows and ids
    paths = [str(tmp_path / n) for n in "ab"]
    shards.write_shards(table(spark, rows).coalesce(1), RANKS, paths[0], length=16, shard=64)
    rng.shuffle(rows)
    shards.write_shards(table(spark, rows).repartition(ways), RANKS, paths[1], length=16, shard=64)
    first, second = (np.array(list(shards.read_slots(x, 0, 10**9))) for x in paths)
    assert first.shape == second.shape and (first == second).all()


def test_shards_of_many_bytes_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="larger"):
        shards.write_shards(table(spark, [(1, "a", "s", "en")]), RANKS, str(tmp_path / "x"), length=1 << 20, shard=4096)


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(1, 80)) + (" # # # #" if i % 5 == 0 else ""), f"s{min(i % 9, 5)}", "en") for i in range(3000)]
    out = mixing.mix_plan(table(spark, rows)).collect()
    by = collections.defaultdict(list)
    for x in out:
        by[x.source].append(x)
    total = sum(x.size for x in out)
    sizes = {s: sum(x.size for x in v) for s, v in by.items()}
    weights = dict(zip(sorted(sizes), [3, 1, 2, 3, 1, 2], strict=True))
    target, free = {}, set(sizes)
    while True:  # deal, cap, deal the excess again
        left = 1.5 * total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[k] for k in free) for s in free}
        if not (full := {s for s in free if share[s] > 2 * sizes[s] + 1e-9}):
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    target |= share
    for s, v in by.items():
        assert v[0].target == pytest.approx(target[s]) and v[0].source_size == sizes[s]
        assert abs(sum(x.taken for x in v) - target[s]) <= 90
        assert {x.copies for x in v} <= {int(target[s] // sizes[s]), int(target[s] // sizes[s]) + 1}
    again = mixing.mix_plan(table(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "word " * 40 + ("# " * 60 if i % 2 else ""), "a", "en") for i in range(2000)] + [(5000, "word " * 10, "b", "en")]
    out = mixing.mix_plan(table(spark, rows), share=0.5).collect()
    good, bad = (sum(x.copies for x in out if x.source == "a" and x.doc_id % 2 == k) for k in (0, 1))
    assert good > 2 * bad > 0


def test_leaks_and_paraphrases(spark):
    rng = random.Random(12)
    items = [(i, words(rng, 40, 4000)) for i in range(30)]
    clean = [(i, words(rng, rng.choice([5, 60, 300]), 4000), "a", "en") for i in range(200)]
    planted = []
    for i, t in items[:12]:
        w = t.split()
        if i % 3 == 1:
            w = [x if k % 5 else "other" for k, x in enumerate(w)]  # 32 of 40 words are left
        if i % 3 == 2:
            w = [x for k, x in enumerate(w) if k >= 32 or k % 2]  # half of the words, and the whole answer
        planted.append((1000 + i, words(rng, 90, 4000) + " " + " ".join(w) + ". " + words(rng, 70, 4000), "a", "en"))
    out = decontaminate.contamination(table(spark, clean + planted), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: x.item_id for x in out if x.contaminated} == {1000 + i: i for i, _ in items[:12]}


@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    piece = decontaminate.Piece(0, np.array(b, np.uint64), np.array(b[-2:], np.uint64))
    assert decontaminate.common(piece.masks, len(b), a) == best[-1][-1]


def test_latent_basis_spans_the_strongest_directions():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 6)) @ (rng.standard_normal((6, 50)) * np.array([9, 7, 5, 4, 3, 2])[:, None])
    random_ = rng.standard_normal((50, 14))
    u = decontaminate.latent_basis(a.T @ a @ random_, random_, 6)
    v = np.linalg.svd(a)[2][:6].T
    assert np.linalg.norm(u @ u.T - v @ v.T) < 1e-3


def test_license_windows(spark):
    rng = random.Random(15)
    grant = licenses.TEMPLATES["MIT"].split()
    cut = grant[:10] + ["inserted"] + grant[10:]
    far = [x if k % 4 else "x" for k, x in enumerate(grant)]
    rows = []
    for i in range(60):
        body = {0: grant, 1: cut, 2: far, 3: grant[:60]}[i % 4]
        rows.append((i, words(rng, rng.randrange(0, 90)) + " " + " ".join(body).upper() + " " + words(rng, rng.randrange(0, 90)), "a", "en"))
    out = licenses.scan(table(spark, rows)).collect()
    assert {x.doc_id for x in out if x.licenses == ["MIT"]} == {i for i in range(60) if i % 4 in (0, 1)}
    assert all(x.n_licenses == 0 for x in out if x.doc_id % 4 in (2, 3))
    x = next(x for x in out if x.doc_id == 0)
    start = len(rows[0][1].split()[: x.spans[0]["first"]])
    assert rows[0][1].split()[start : x.spans[0]["last"]] == " ".join(grant).upper().split()


def test_licenses_against_every_window(spark):
    """Containment in every stretch of a text as long as a template's window, by plain sets."""
    rng = random.Random(19)
    names = [n for n in licenses.TEMPLATES if n.endswith("notice") or n in ("ISC", "MPL-2.0", "EPL-2.0", "GPL-3.0-or-later", "LGPL-3.0-or-later")]
    bare = lambda t: [re.sub(r"^[.,;:!?()\\[\\]{}\"'`*]{1,4}(?=.)|(?<=.)[.,;:!?()\\[\\]{}\"'`*]{1,4}$", "", x.lower()) for x in WORD.findall(t)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    text_of = {n.replace("/", " "): licenses.TEMPLATES[n] for n in names}
    names = list(text_of)
    templates = {n: (len(bare(text_of[n])), grams(bare(text_of[n]))) for n in names}
    rows = []
    for i in range(80):
        w = text_of[names[i % len(names)]].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join([words(rng, rng.randrange(60)), *w, words(rng, rng.randrange(60))]), "a", "en"))
    out = {x.doc_id: set(x.licenses) for x in licenses.scan(table(spark, rows), text_of).collect()}
    sure, found = 0, 0
    for i, t, *_ in rows:
        w = bare(t)
        for n, (size, held) in templates.items():
            inside = max((len(held & grams(w[k : k + size])) for k in range(max(1, len(w) - size + 1))), default=0) / len(held)
            sure += inside >= 0.8
            found += inside >= 0.8 and n in out[i]
            loose = max((len(held & grams(w[k : k + 2 * size + 40])) for k in range(max(1, len(w) - size + 1))), default=0) / len(held)
            assert n not in out[i] or loose >= 0.8
    assert sure > 40 and found == sure


def test_languages_in_several_passes(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, words(rng, 80, 300) if i % 7 else None, "a", ["en", "de", None][i % 3]) for i in range(40)] + [(99, "", "a", "xx")]
    df = table(spark, rows)
    once = sorted(map(tuple, perplexity.quality(df).collect()))
    monkeypatch.setattr(perplexity, "GRAMS_AT_ONCE", 1)
    assert sorted(map(tuple, perplexity.quality(df).collect())) == once and len(once) == 41
