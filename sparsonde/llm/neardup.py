"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 128 symbols of 16 bits. The first 64 are cut into 15 chunks; by the pigeonhole principle two signatures
that differ in at most APART = 29 of these 64 symbols have a chunk with at most one difference. Each chunk therefore gives one
key for each symbol that may be wrong (the others hashed), 64 keys in all, and every such pair shares a key: APART is the
distance below which no pair is missed. A pair of similarity 0.8 has 12.8 +- 3.2 differences there. Pairs that share a key and
differ in at most APART of the 64, 47 of all 128 symbols (25.6 +- 4.5 at 0.8) and 384 of 2048 more symbols of 2 bits (307 +- 16)
are compared on their full shingle sets.

Equal sets become one class first. Groups of similar texts are never spelt out as pairs: (1) each member of a bucket is
compared with the bucket's smallest member; (2) what is then in another component than most of the bucket is compared
with the three nearest signatures of each other component in it; (3) what is still apart is compared with all that it
shares a bucket with. Links inside one component are not needed any more, so the components are those of all links.
The texts of a bucket with more than SPLIT of them outside its largest component meet by their rarest shingles instead
(`rare_shingles`), which loses no pair either: many texts of one template share buckets, but not what is their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rare_shingles, store
from .components import components
from .textblock import U, blocks, mix, window_hashes

SYMBOLS, KEYED, LONGER = 128, 64, 128 + 2048
CHUNKS = 15
MOST, MOST_LONGER = 47, 384
APART = 2 * CHUNKS - 1
SMALL, SPLIT = 32, 512
NEAREST = 3
BLOCK_ROWS = 1024
_rng = np.random.default_rng(20240611)
_MUL = (_rng.integers(1, 1 << 32, LONGER, dtype=np.uint64) | U(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, LONGER, dtype=np.uint64).astype(np.uint32)
#: (chunk, symbol left out, symbols used) of each key.
KEYS = [(c, out, [i for i in chunk if i != out]) for c, chunk in enumerate(np.array_split(np.arange(KEYED), CHUNKS)) for out in chunk]


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the ``n``-word shingles of each text; of all words if there are fewer; empty without words."""
    for w in blocks(texts, lower=True):
        h = w.hashes()
        grams = window_hashes(h, n)
        for r in range(w.rows):
            a, b = w.at[r], w.at[r + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield window_hashes(h[a:b], int(b - a), base=0xA0761D6478BD642F) ^ U(b - a)
            else:
                yield np.zeros(0, U)


def signature(shingles: np.ndarray, first: int = 0, last: int = SYMBOLS) -> np.ndarray:
    """The 16-bit symbols ``first`` to ``last`` of a set."""
    low = np.full(last - first, 0xFFFFFFFF, np.uint32)
    x = (shingles >> U(32)).astype(np.uint32)
    for f in range(0, last - first, 128):  # so many functions and shingles at once as fit the cache
        xor, mul = _XOR[first + f : min(first + f + 128, last), None], _MUL[first + f : min(first + f + 128, last), None]
        for at in range(0, len(x), 1024):
            np.minimum(low[f : f + 128], ((x[None, at : at + 1024] ^ xor) * mul).min(axis=1), out=low[f : f + 128])
    return (mix(low.astype(U)) & U(0xFFFF)).astype(np.uint16)


def packed(symbols: np.ndarray) -> bytes:
    """The low 2 bits of each symbol, four to a byte."""
    two = (symbols & 3).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """The 64 keys of each signature (rows), by its first 64 symbols."""
    out = np.empty((len(sigs), len(KEYS)), U)
    s = sigs.astype(U)
    for k, (_, _, used) in enumerate(KEYS):
        h = np.full(len(sigs), k + 1, U)
        for i in used:
            h = h * U(0x9E3779B97F4A7C15) + s[:, i]
        out[:, k] = mix(h)
    return out


def _sign(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, h1, h2, sigs = [], [], [], []
            for s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                h1.append(int(mix(s).sum(dtype=U).view(np.int64)) if len(s) else 0)
                h2.append(int(mix(s * U(0xE7037ED1A0B428DB)).sum(dtype=U).view(np.int64)) if len(s) else 0)
                sigs.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = bucket_keys(sigs)
                node = np.repeat(part.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _lengthened(texts: DataFrame, n: int) -> DataFrame:
    """(node, more): the symbols beyond the first 128, 2 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [packed(signature(s, SYMBOLS, LONGER)) for s in shingle_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(more, pa.binary())], ["node", "more"])

    return texts.select("node", "text").mapInArrow(run, "node long, more binary")


_USED = np.zeros((KEYED, len(KEYS)), np.float32)
for _k, (_, _, _u) in enumerate(KEYS):
    _USED[_u, _k] = 1
_NEED = _USED.sum(axis=0)


class _Rows:
    """Bucket rows as arrays, and the test of pairs of them."""

    def __init__(self, table: pa.Table) -> None:
        self.key, self.block, self.node, self.comp = (table[c].to_numpy() for c in ("key", "block", "node", "comp"))
        self.main = table["main"].to_numpy()
        self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        self.more = np.frombuffer(b"".join(table["more"].to_pylist()), U).reshape(-1, (LONGER - SYMBOLS) // 32)

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs (i, j) of one bucket that pass both thresholds and have no earlier key in common, and their differences."""
        ins, outs, aparts = [], [], []
        for at in range(0, len(i), 8192):
            x, y = i[at : at + 8192], j[at : at + 8192]
            equal = self.sig[x] == self.sig[y]
            apart = SYMBOLS - equal.sum(axis=1)
            ok = np.flatnonzero((apart <= MOST) & (KEYED - equal[:, :KEYED].sum(axis=1) <= APART))
            bits = self.more[x[ok]] ^ self.more[y[ok]]
            apart = np.bitwise_count((bits | bits >> U(1)) & U(0x5555555555555555)).sum(axis=1, dtype=np.int64)
            near = apart <= MOST_LONGER
            ok, apart = ok[near], apart[near]
            if len(ok):
                first = np.argmax(equal[ok, :KEYED].astype(np.float32) @ _USED == _NEED, axis=1)
                own = bucket_keys(self.sig[x[ok]])[np.arange(len(ok)), first]
                keep = own.view(np.int64) == self.key[x[ok]]
                ok, apart = ok[keep], apart[keep]
            ins.append(x[ok])
            outs.append(y[ok])
            aparts.append(apart)
        return np.concatenate(ins), np.concatenate(outs), np.concatenate(aparts)

    def pairs(self, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.r_[True, (self.key[1:] != self.key[:-1]) | (self.block[1:] != self.block[:-1]), True])
        size = np.diff(cut)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        whole = size <= SMALL
        for m in range(2, SMALL + 1):
            begin = cut[:-1][whole & (size == m)]
            if len(begin):
                x, y = np.triu_indices(m, 1)
                left.append((begin[:, None] + x[None, :]).ravel())
                right.append((begin[:, None] + y[None, :]).ravel())
        i, j = np.concatenate(left), np.concatenate(right)
        apart = (self.comp[i] != self.comp[j]) & (self.main[i] | self.main[j] | (self.block[i] == 0))
        i, j = i[apart], j[apart]
        found = [self.close(i, j)[:2]] if len(i) else []
        for s, e in zip(cut[:-1][~whole], cut[1:][~whole], strict=True):
            at = np.arange(s, e)
            for u in at[~self.main[s:e]]:
                other = at[(self.comp[s:e] != self.comp[u]) & (self.main[s:e] | ((self.node[s:e] < self.node[u]) & (self.block[s] == 0)))]
                if not len(other):
                    continue
                i, j, apart = self.close(np.full(len(other), u), other)
                if nearest is not None and len(j) > nearest:
                    order = np.lexsort((apart, self.comp[j]))
                    c = self.comp[j][order]
                    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                    rank = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
                    i, j = i[order[rank < nearest]], j[order[rank < nearest]]
                found.append((i, j))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (self.node[np.concatenate(x)] for x in zip(*found, strict=True))
        return np.minimum(a, b), np.maximum(a, b)


def _bucket_pairs(rows: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs of different components within (key, block) that pass the signature thresholds, each from the first key that it shares.

    ``rows``: key, block, node, comp, main (whether comp is the bucket's most common), sig, more. Rows that aren't main stand in
    each block of their bucket and are compared with its main rows there, and in block 0 with each other. ``nearest``: in
    buckets of over SMALL rows only so many of each other component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b = _Rows(table).pairs(nearest)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, bl = batch.column("key").to_numpy(), batch.column("block").to_numpy()
            split = int(np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (bl[1:] != bl[:-1])])[-1])
            if split == 0 and held and held[-1].column("key")[-1].as_py() == k[-1] and held[-1].column("block")[-1].as_py() == bl[-1]:
                held.append(batch)
                continue
            if held or split:
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, split)]))
            held = [batch.slice(split)]
        if held:
            yield from flush(pa.Table.from_batches(held))

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "node").select("key", "block", "node", "comp", "main", "sig", "more")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, U)
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ok = np.zeros(len(a), bool)
            at = 0
            for s in shingle_sets(batch.column("text_b"), n):
                if a[at] != last:
                    last, seen = a[at], next(shingle_sets(pa.array([batch.column("text_a")[at].as_py()], pa.string()), n))
                if min(len(s), len(seen)) * 100 >= percent * max(len(s), len(seen)):
                    both = len(np.intersect1d(s, seen, assume_unique=True))
                    ok[at] = 100 * both >= percent * (len(s) + len(seen) - both)
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def _close(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures differ in at most MOST symbols; the count stays in the JVM as bit operations on 8 bits a symbol."""
    side = lambda s: sigs.select(F.col("node").alias(s), *[F.col(f"s{i}").alias(f"{s}{i}") for i in range(16)])
    apart = F.lit(0)
    for i in range(16):
        x = F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.filter(apart <= MOST).select("a", "b")


def _low_bytes(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint8)
            longs = np.ascontiguousarray(sigs).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(16)]], ["node", *[f"s{i}" for i in range(16)]])

    return classes.select("node", "sig").mapInArrow(run, "node long, " + ", ".join(f"s{i} long" for i in range(16)))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    A-Z are lower-cased; words are runs without ASCII white space; a text's set holds its distinct ``shingle_words``-word
    shingles, or all its words as one if it has fewer. Texts are linked if 100 * intersection >= percent * union. Null,
    empty and blank texts have an empty set, are linked with nothing and kept. component_id is the smallest doc_id that can
    be reached; kept is doc_id = component_id. A null doc_id has a null component_id and is kept. doc_id is taken as a key;
    rows that share one share its component, and of different texts under one id the smallest is compared.
    """
    signed = store.written(_sign(docs, shingle_words), "neardup-signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = store.written(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "neardup-classes")
    of_doc = full.select("doc_id", "h1", "h2", "n_shingles").join(classes.drop("sig"), ["h1", "h2", "n_shingles"]).select("doc_id", "node")
    keys_at = store.new_path(docs.sparkSession, "neardup-keys")
    keys = store.written(_keys(classes), "neardup-keys", keys_at)
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    buckets = store.written(keys.join(shared, "key"), "neardup-buckets")
    store.delete(docs.sparkSession, keys_at)

    involved = buckets.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(involved, "node")
    texts = store.written(texts.groupBy("node").agg(F.min("text").alias("text")), "neardup-texts")
    sigs = store.written(classes.join(_lengthened(texts, shingle_words), "node").select("node", "sig", "more"), "neardup-sigs")

    first = _close(buckets.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), _low_bytes(sigs))
    links = store.written(_confirmed(first, texts, shingle_words, percent), "neardup-links")
    rare = None
    for nearest in (NEAREST, None):
        comp = components(links, "neardup-comp")
        mixed = store.written(_mixed(buckets, comp), "neardup-mixed")
        pairs = _bucket_pairs(_apart(mixed.filter(F.col("others") <= SPLIT), sigs), nearest)
        crowd = store.written(mixed.filter(F.col("others") > SPLIT).select("node").distinct(), "neardup-crowd")
        if crowd.limit(1).count():
            if rare is None:  # buckets only lose components, so the first round's crowd holds the second's
                crowded = texts.join(crowd, "node", "left_semi")
                rare = store.written(rare_shingles.rare_first(_shingles(crowded, shingle_words), percent), "neardup-rare")
                met = rare_shingles.star_pairs(rare, comp, percent)
            else:
                met = rare_shingles.all_pairs(rare.join(crowd, "node", "left_semi"), comp, percent)
            pairs = pairs.union(_close(met, _low_bytes(sigs))).distinct()
        pairs = store.written(pairs, "neardup-pairs")
        links = store.written(links.union(_confirmed(pairs, texts, shingle_words, percent)), "neardup-links")
    comp = components(links, "neardup-comp")

    found = of_doc.join(comp, "node").groupBy(F.col("doc_id").alias("d_")).agg(F.min("comp").alias("comp"))
    alone = of_doc.groupBy(F.col("doc_id").alias("d_")).agg(F.min("node").alias("node"))
    place = alone.join(found, "d_", "left").select("d_", F.coalesce("comp", "node").alias("c_"))
    out = signed.select("doc_id", "n_shingles").join(place, F.col("doc_id") == F.col("d_"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("c_")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _mixed(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets that still hold more than one component: key, node, comp, main, rows and others (those outside the largest component)."""
    labelled = buckets.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    split = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("rows"), (F.sum("n") - F.max("n")).alias("others"), F.max_by("comp", F.struct("n", "comp")).alias("most")).filter("comps > 1")
    return labelled.join(split, "key").withColumn("main", F.col("comp") == F.col("most"))


def _shingles(texts: DataFrame, n: int) -> DataFrame:
    """(node, size, key): a row for each shingle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, s in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                for at in range(0, len(s), 1 << 16):
                    part = s[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), len(s))), pa.array(part.view(np.int64))], ["node", "size", "key"])

    return texts.select("node", "text").mapInArrow(run, "node long, size long, key long")


def _apart(mixed: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows of ``_mixed`` with their signatures, in blocks of bounded size."""
    count = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    block = F.explode(F.when(F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), count - 1)))
    return mixed.select("key", "node", "comp", "main", block.alias("block")).join(sigs, "node")


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id (all rows of that doc_id)."""
    kept = near_duplicates(docs, shingle_words, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias("k_")).distinct()
    cols = [docs[c] for c in docs.columns]
    some = docs.join(kept, docs["doc_id"] == kept["k_"], "left_semi").select(*cols)
    return some.union(docs.filter(docs["doc_id"].isNull()).select(*cols))
