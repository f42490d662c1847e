"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of two blocks of BLOCK_WORDS words, a block apart. Passages and benchmark pieces are TF-IDF vectors
over the benchmark's words; a randomised singular value decomposition, one distributed pass over all passages, gives the
latent space: with M the passages' cross products and W random, Z = M W is summed over the tasks and the Nystroem formula makes
singular vectors of it. Passages whose cosine with a piece is COSINE or more are its candidates, and so are those that share
a run of RUN words with it: words of frequent leaks weigh little, and short pieces are little of a passage. A candidate is a leak if the
longest common subsequence of words holds a share LCS of the piece, or a share PARAPHRASE and the piece's answer (its last
words) as well.

The benchmark is a query set: its words are counted in one pass, then it is read in blocks of ITEMS items with two passes each
(latent space, search), which bounds what is broadcast. Ordinary texts hold any few words: an item of fewer than SHORT words is
leaked only by a text of just these words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .licenses import bare_hashes
from .textblock import Words, blocks, same_doc, window_hashes

BLOCK_WORDS, ITEMS, RANK, SPARE, SHORT = 64, 2048, 256, 8, 5
COSINE, LCS, PARAPHRASE = 0.3, 0.7, 0.5
ANSWER_WORDS, ANSWER = 8, 0.75
#: Words in more than this share of blocks aren't features, but each piece keeps its rarest LEAST.
MAX_DF, LEAST = 0.05, 8
#: Passages that share a run of so many words with a piece (the whole piece, if it is shorter) are its candidates whatever their cosine.
RUN = 6
#: Words summed up at a time, so that their vectors stay in the cache.
AT_ONCE = 4096
#: Different words of a benchmark, which are broadcast.
MOST_WORDS = 10_000_000


@dataclass
class Piece:
    item: int
    words: np.ndarray
    answer: np.ndarray
    short: bool = False
    masks: dict[int, int] = field(default_factory=dict)
    answer_masks: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for masks, words in ((self.masks, self.words), (self.answer_masks, self.answer)):
            for k, h in enumerate(words.tolist()):
                masks[h] = masks.get(h, 0) | 1 << k


def common(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` and the ``n`` words behind ``masks``; bits of an integer are the table's columns."""
    s = (1 << n) - 1
    full = s
    for h in words:
        m = masks.get(h)
        if m is not None:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def pieces_of(items: list[tuple[int, str]]) -> list[Piece]:
    """The items' texts in pieces of at most BLOCK_WORDS words; texts without words have none."""
    out = []
    for item, text in items:
        w = next(iter(blocks(pa.array([text or ""]))), None)
        h = bare_hashes(w) if w is not None else np.zeros(0, np.uint64)
        parts = -(-len(h) // BLOCK_WORDS)
        for p in np.array_split(h, parts) if parts else []:
            out.append(Piece(item, p, p[-ANSWER_WORDS:], len(h) < SHORT))
    return out


def _layout(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The block of each word, and the first block of each text (and the number of blocks)."""
    per = -(-w.counts() // BLOCK_WORDS)
    base = np.r_[0, np.cumsum(per)]
    return base[w.doc] + (np.arange(len(w.doc)) - w.at[w.doc]) // BLOCK_WORDS, base


class Vocabulary:
    """Sorted word hashes with a table by their low bits; slots that two of them share are looked up by bisection."""

    BITS = 20

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.table = np.full(1 << self.BITS, -1, np.int32)
        slot = (known & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
        self.table[slot] = np.arange(len(known))
        self.table[np.flatnonzero(np.bincount(slot, minlength=1 << self.BITS) > 1)] = -2

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't known."""
        at = self.table[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)]
        some = np.flatnonzero(at != -1)
        place = at[some].astype(np.int64)
        shared = place == -2
        if shared.any():
            place[shared] = np.minimum(np.searchsorted(self.known, h[some[shared]]), len(self.known) - 1)
        out = np.full(len(h), -1, np.int64)
        right = self.known[place] == h[some]
        out[some[right]] = place[right]
        return out


def block_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many blocks of all texts each word of ``vocabulary`` is, and the number of blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        total, seen, size = 0, np.zeros(len(shared.value), np.int64), len(shared.value)
        for batch in batches:
            for w in blocks(batch.column("text")):
                f = known(bare_hashes(w))
                block, base = _layout(w)
                total += int(base[-1])
                hit = f >= 0
                pairs = np.sort(block[hit] * size + f[hit])
                seen += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] % size if len(pairs) else pairs, minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[seen[some], total])], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # a row per word of the benchmark block
    out, total = np.zeros(len(vocabulary), np.int64), 0
    for f, n in zip(rows["feature"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if f < 0:
            total = n
        else:
            out[f] = n
    return out, total


def _projected(f: np.ndarray, block: np.ndarray, base: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each passage's vector of word counts times ``basis`` (whose rows are weighted already); passage b is blocks b and b + 1 of one text. Also whether b has a next block."""
    n = int(base[-1])
    out = np.zeros((n, basis.shape[1]), np.float32)
    hit = np.flatnonzero(f >= 0)
    if len(hit):
        b = block[hit]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        size = np.diff(np.r_[start, len(hit)])
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        sums = basis[f[hit[start]]]
        for k in range(1, int(size[0])):  # the k-th word of all blocks that have one: short enough for the cache
            m = int(np.searchsorted(-size, -k))
            sums[:m] += basis[f[hit[start[:m] + k]]]
        out[b[start]] = sums
    more = np.ones(n, bool)
    more[base[1:][base[1:] > base[:-1]] - 1] = False
    both = out.copy()
    both[:-1][more[:-1]] += out[1:][more[:-1]]
    return both, more


def _cross_products(docs: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Z = M W: the sum over all passages a of a (a . W). Tasks sum their own; Spark adds those by runs of features."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, idf, random))
    run_of = 256
    k = random.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight, basis = shared.value
        known, weighted = Vocabulary(words), basis * weight[:, None]
        z = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for w in blocks(batch.column("text")):
                f = known(bare_hashes(w))
                block, base = _layout(w)
                y, more = _projected(f, block, base, weighted)
                y[1:][more[:-1]] += y[:-1][more[:-1]].copy()  # a block is in its own passage and in the one before
                every = np.flatnonzero(f >= 0)
                every = every[np.argsort(f[every], kind="stable")]
                for at in range(0, len(every), AT_ONCE):
                    hit = every[at : at + AT_ONCE]
                    start = np.flatnonzero(np.r_[True, np.diff(f[hit]) != 0])
                    z[f[hit][start]] += np.add.reduceat(y[block[hit]], start, axis=0) * weight[f[hit][start], None]
        parts = range(0, len(z), run_of)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([z[i : i + run_of].tobytes() for i in parts], pa.binary())], ["part", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("z").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[p] = sums[p] + x if p in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "z"])

    parts = docs.select("text").mapInArrow(run, "part long, z binary").repartition("part").mapInArrow(add, "part long, z binary").toArrow()
    out = np.zeros(random.shape)
    for p, raw in zip(parts["part"].to_pylist(), parts["z"].to_pylist(), strict=True):
        x = np.frombuffer(raw, np.float64).reshape(-1, k)
        out[p * run_of : p * run_of + len(x)] = x
    return out


def latent_basis(z: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """Singular vectors (columns) of the matrix behind Z = M W, by the Nystroem formula."""
    shift = 1e-6 * max(np.linalg.norm(z), 1e-12)
    z = z + shift * random
    small = random.T @ z
    value, vector = np.linalg.eigh((small + small.T) / 2)
    good = value > 1e-9 * max(value.max(), 1e-300)
    u, s, _ = np.linalg.svd(z @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return u[:, :rank][:, s[:rank] > 0]


class Runs:
    """The runs of RUN words of the pieces, and which pieces hold each."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.known: dict[int, tuple[Vocabulary, list[list[int]]]] = {}
        of: dict[int, dict[int, list[int]]] = {}
        for i, p in enumerate(pieces):
            n = min(RUN, len(p.words))
            for g in np.unique(window_hashes(p.words, n)).tolist():
                of.setdefault(n, {}).setdefault(g, []).append(i)
        for n, found in of.items():
            keys = sorted(found)
            self.known[n] = Vocabulary(np.array(keys, np.uint64)), [found[g] for g in keys]

    def find(self, w: Words, h: np.ndarray, block: np.ndarray, base: np.ndarray) -> set[tuple[int, int]]:
        """(passage, piece) of all passages in which such a run begins."""
        out = set()
        for n, (known, pieces) in self.known.items():
            place = known(window_hashes(h, n))
            for k in np.flatnonzero((place >= 0) & same_doc(w, n)).tolist():
                b = int(block[k])
                for i in pieces[place[k]]:
                    out.add((b, i))
                    if b > base[w.doc[k]]:
                        out.add((b - 1, i))
        return out


def _leaks_of(docs: DataFrame, items: list[tuple[int, str]], words: np.ndarray, counts: np.ndarray, total: int, cosine: float, lcs: float, paraphrase: float, seed: int) -> DataFrame:
    """(doc_id, text hash th, item_id, lcs): the best leak of one benchmark block in each row that has one; ``counts``: of the sorted ``words``, in ``total`` blocks of text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = pieces_of(items)
    everything = np.unique(np.concatenate([p.words for p in pieces])) if pieces else np.zeros(0, np.uint64)
    schema = f"doc_id {kind}, th long, item_id long, lcs double"
    if not len(everything):
        return docs.sparkSession.createDataFrame([], schema)
    seen = counts[np.searchsorted(words, everything)]
    chosen = seen <= MAX_DF * total
    for p in pieces:
        own = np.unique(np.searchsorted(everything, p.words))
        chosen[own[np.argsort(seen[own], kind="stable")][:LEAST]] = True
    vocabulary = everything[chosen]
    idf = np.log((total + 1) / (seen[chosen] + 1)).astype(np.float32) + 1e-3
    rank = min(RANK, len(pieces), len(vocabulary))
    random = np.random.default_rng(seed).standard_normal((len(vocabulary), min(rank + SPARE, len(vocabulary)))).astype(np.float32)
    z = _cross_products(docs, vocabulary, idf, random)
    own, place = np.zeros((len(pieces), len(vocabulary)), np.float32), Vocabulary(vocabulary)
    for i, p in enumerate(pieces):
        f = place(p.words)
        np.add.at(own[i], f[f >= 0], idf[f[f >= 0]])
    # The benchmark's passages count as much as the corpus's, so that the latent space tells its items apart.
    mine = own.T @ (own @ random)
    z = z / max(np.linalg.norm(z), 1e-12) + mine / max(np.linalg.norm(mine), 1e-12)
    basis = latent_basis(z, random, rank).astype(np.float32)
    latent = own @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, idf, basis, latent, pieces, Runs(pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, basis, latent, pieces, runs = shared.value
        known, weighted = Vocabulary(vocabulary), basis * weight[:, None]
        least = [int(np.ceil(paraphrase * len(p.words))) for p in pieces]
        for batch in batches:
            rows, best = [], []
            for w in blocks(batch.column("text")):
                h = bare_hashes(w)
                block, base = _layout(w)
                x, more = _projected(known(h), block, base, weighted)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                near = x @ latent.T >= cosine
                if same := runs.find(w, h, block, base):
                    near[tuple(np.array(list(same)).T)] = True
                at, piece = np.nonzero(near)
                if not len(at):
                    continue
                row = np.searchsorted(base, at, "right") - 1
                found: dict[int, tuple[float, int]] = {}
                held, words, have = -1, [], set()
                for b, i, r in zip(at.tolist(), piece.tolist(), row.tolist(), strict=True):
                    if b != held:
                        a = int(w.at[r] + (b - base[r]) * BLOCK_WORDS)
                        words = h[a : min(a + 2 * BLOCK_WORDS, int(w.at[r + 1]))].tolist()
                        have, held = set(words), b
                    p = pieces[i]
                    if p.short and w.counts()[r] != len(p.words):
                        continue
                    if sum(m.bit_count() for k, m in p.masks.items() if k in have) < least[i]:
                        continue  # the longest common subsequence can't be longer
                    n = len(p.words)
                    share = common(p.masks, n, words) / n
                    if share >= lcs or (share >= paraphrase and common(p.answer_masks, len(p.answer), words) >= ANSWER * len(p.answer)):
                        found[r] = max(found.get(r, (0.0, 0)), (share, -p.item))
                for r, (share, item) in found.items():
                    rows.append(w.first + r)
                    best.append((-item, share))
            if rows:
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), batch.column("th").take(pick), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.float64())], ["doc_id", "th", "item_id", "lcs"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


def _benchmark_words(items: DataFrame) -> np.ndarray:
    """The sorted hashes of all words of the benchmark: 8 bytes each, MOST_WORDS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bare_hashes(w)).view(np.int64))], ["h"])

    found = items.select("text").mapInArrow(run, "h long").distinct().limit(MOST_WORDS + 1).toArrow()
    if found.num_rows > MOST_WORDS:
        raise ValueError(f"a benchmark of more than {MOST_WORDS} different words: look for some of its items at a time")
    return np.sort(found["h"].to_numpy().view(np.uint64))


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, paraphrase: float = PARAPHRASE, seed: int = 5) -> DataFrame:
    """(doc_id, th, item_id, lcs): each row of ``docs`` with a leaked benchmark item, its longest one (of equal ones the smallest id); th is the text's hash.

    Items without words, null texts and empty tables leak nothing; items that share an id are one; an item of fewer than SHORT words is leaked by texts of just these words.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    numbered = store.written(items.withColumn("block", F.floor((F.row_number().over(Window.orderBy("item_id", "text")) - 1) / ITEMS)), "benchmark")
    found = None
    words = _benchmark_words(numbered)
    counts, total = block_counts(rows, words)
    for b in range((numbered.agg(F.max("block")).first()[0] or 0) + 1):
        block = [(r.item_id, r.text) for r in numbered.filter(F.col("block") == b).orderBy("item_id", "text").collect()]  # ITEMS rows
        part = _leaks_of(rows, block, words, counts, total, cosine, lcs, paraphrase, seed)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("lcs", (-F.col("item_id")).alias("item")))
    return store.written(found.groupBy("doc_id", "th").agg(best.alias("b")).select("doc_id", "th", (-F.col("b.item")).alias("item_id"), F.col("b.lcs").alias("lcs")), "leaks")


def contamination(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """doc_id, contaminated, item_id and lcs (null where nothing leaked) of every row of ``docs``."""
    found = leaks(docs, benchmark, **more).withColumnRenamed("doc_id", "d_").withColumnRenamed("th", "t_")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("th"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")), "left")
    return out.select("doc_id", F.col("t_").isNotNull().alias("contaminated"), "item_id", "lcs")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows alike in doc_id and text go together."""
    found = leaks(docs, benchmark, **more).select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"))
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["d_"]) & (th == found["t_"]), "left_anti").select(*[docs[c] for c in docs.columns])
