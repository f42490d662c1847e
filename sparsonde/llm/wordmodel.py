"""An interpolated modified Kneser-Ney model of word pairs, as distributed hash arrays, and each text's log-probability under it.

All pairs of a word and the word before it are counted per language, so the model grows with the corpus; no task holds it whole
and none of it comes to the driver but two rows of totals per language. One pass over the texts makes pieces of about PIECE bytes:
a piece is its sorted word hashes and each word's place among them, which is all that is needed of the texts from there on. Pieces
are a bucketed table, so they are never shuffled. A piece sends its sorted pair hashes with their counts to parts, by ranges
of the hash; a part adds them up and answers in the same order, so an answer is numbers alone. It also says which piece
owns a pair: owners send how many pairs begin and end with each of their words, and the words' parts answer in the same way.

A word's hash has 48 bits, a pair's log2(words of the corpus) + SPARE bits, so at any size of the corpus one pair in 2**SPARE
is expected to take another's count for its own. Sorted hashes travel as differences, counts as compressed bytes.

A text is scored by what the other texts hold: its own counts are taken out of the pairs, of their contexts, and of the
continuation counts where no other text has the pair. Texts that are copies of each other therefore seem likely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .textblock import U, blocks, mix

PIECE, PART = 14 << 20, 1 << 24
WORD_BITS, SPARE = 48, 12
#: Words of which the log-probabilities are worked out at a time.
AT_ONCE = 300_000
MOST_BUCKETS = 50_000
#: Context of a text's first word.
BEGIN = U(0x5851F42D4C957F2D)
ANSWER = "part int, piece long, kind int, data binary, langs array<string>, stats array<long>"
_STATE = ("piece", "langs", "data")


# numbers as bytes


def _zipped(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


def _joined(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _parted(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:8], "little")
    edges = np.cumsum(np.r_[8 * (n + 1), np.frombuffer(raw[8 : 8 * (n + 1)], np.int64)])
    return [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, most of them small: their lowest bytes and the rest apart."""
    x = np.asarray(x).astype(np.int64)
    return _joined(_zipped((x & 0xFF).astype(np.uint8)), _zipped(x >> 8))


def _of_small(raw: bytes) -> np.ndarray:
    low, rest = _parted(raw)
    return (_unzipped(rest, np.int64) << 8) + _unzipped(low, np.uint8)


def _rising(x: np.ndarray) -> bytes:
    """Sorted hashes: the low 16 bits as they are, of the rest the differences."""
    high = (x >> U(16)).astype(np.int64)
    return _joined((x & U(0xFFFF)).astype(np.uint16).tobytes(), _small(np.diff(high, prepend=0)))


def _of_rising(raw: bytes) -> np.ndarray:
    low, steps = _parted(raw)
    return (np.cumsum(_of_small(steps)).astype(U) << U(16)) | np.frombuffer(low, np.uint16).astype(U)


def _slices(x: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, last + 1) of the sorted hashes ``x``, of parts that have any."""
    part = ((x >> U(bits - 32)) * U(parts) >> U(32)).astype(np.int64)
    edges = np.searchsorted(part, np.arange(parts + 1))
    yield from ((p, int(edges[p]), int(edges[p + 1])) for p in np.flatnonzero(np.diff(edges)).tolist())


def _of_language(name: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def _word(h: np.ndarray, language: np.ndarray) -> np.ndarray:
    return mix(h ^ language) >> U(64 - WORD_BITS)


# pieces


def _encoded(words: np.ndarray, n: np.ndarray, langs: list[str]) -> tuple[list[str], bytes]:
    """The distinct languages, and the piece of texts with ``n`` words each."""
    names = list(dict.fromkeys(langs))
    place = {x: i for i, x in enumerate(names)}
    code = np.array([place[x] for x in langs], np.int64)
    starts = _word(np.full(len(names), BEGIN), np.array([_of_language(x) for x in names], U))
    known, back = np.unique(np.r_[words, starts], return_inverse=True)
    ids = back[: len(words)]
    times = np.bincount(ids, minlength=len(known))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    return names, _joined(_rising(known), _small(times), _small(rank[ids]), _small(n), _small(code))


class Piece:
    """Texts as words by their place among the piece's sorted word hashes (which are those of a language), and their distinct pairs."""

    def __init__(self, langs: list[str], data: bytes) -> None:
        known, times, rank, n, code = _parted(data)
        self.langs, self.known, self.n, self.lang = langs, _of_rising(known), _of_small(n), _of_small(code)
        ids = np.argsort(-_of_small(times), kind="stable")[_of_small(rank)]
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        starts = np.searchsorted(self.known, _word(np.full(len(langs), BEGIN), np.array([_of_language(x) for x in langs], U)))
        before = np.r_[0, ids[:-1]][: len(ids)]
        some = self.n > 0
        before[(np.cumsum(self.n) - self.n)[some]] = starts[self.lang[some]]
        size = len(self.known)
        self.pairs, self.pair, self.times = np.unique(before * size + ids, return_inverse=True, return_counts=True)
        self.context_of, self.word_of = self.pairs // size, self.pairs % size
        self.lang_of = np.zeros(size, np.int64)
        self.lang_of[ids] = self.lang[self.row]
        self.lang_of[starts] = np.arange(len(langs))

    def hashes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of the pairs, and the pair of each."""
        h = mix(self.known[self.context_of] * U(0x9E3779B97F4A7C15) + self.known[self.word_of]) >> U(64 - bits)
        order = np.argsort(h)
        return h[order], order

    def counts(self, bits: int, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair its count in all texts, and whether it is this piece's own; ``answers`` in the parts' order."""
        got = np.concatenate([_of_small(a) for a in answers]) if answers else np.zeros(0, np.int64)
        mine = np.empty(len(got), np.int64)
        mine[self.hashes(bits)[1]] = got
        return mine >> 1, (mine & 1).astype(bool)


def _pieces(docs: DataFrame, kind: str) -> DataFrame:
    """The pieces of ``docs`` (doc_id, th, lang, text), with the doc_id and text hash of each of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            words, n, ids, ths, langs = zip(*held, strict=True)
            names, data = _encoded(np.concatenate(words), np.concatenate(n), [x for y in langs for x in y])
            lists = [pa.concat_arrays(x) for x in (ids, ths)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | made], pa.int64()), *lists, pa.array([names], pa.list_(pa.string())), pa.array([data], pa.binary())], ["piece", "ids", "ths", "langs", "data"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            salt = {x: _of_language(x) for x in dict.fromkeys(langs)}
            of_row = np.array([salt[x] for x in langs], U)
            for w in blocks(batch.column("text")):
                rows = slice(w.first, w.first + w.rows)
                held.append((_word(w.hashes(), of_row[rows][w.doc]), w.counts(), batch.column("doc_id").slice(w.first, w.rows), batch.column("th").slice(w.first, w.rows), langs[rows]))
                size += len(w.data)
                if size >= PIECE:
                    yield emit()
                    held, size, made = [], 0, made + 1
        if held:
            yield emit()

    return docs.select("doc_id", "th", "lang", "text").mapInArrow(run, f"piece long, ids array<{kind}>, ths array<long>, langs array<string>, data binary")


def _answers(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "piece", "kind", "data", "langs", "stats"])


def _of_counts(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, how many there are, and their sum."""
    return [*np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist(), len(c), int(c.sum())]


def _data(table: pa.Table, kind: int) -> list[bytes]:
    """The answers of a kind, in the parts' order."""
    rows = table.filter(pc.equal(table["kind"], kind)).sort_by("part")
    return rows["data"].to_pylist()


# exchanges


def _counted(state: DataFrame, bits: int, parts: int) -> DataFrame:
    """Kind 0: twice the count of each of a piece's pairs, and 1 more for one piece of those that have it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, langs, data in zip(*[batch.column(c).to_pylist() for c in _STATE], strict=True):
                p = Piece(langs, data)
                h, order = p.hashes(bits)
                for part, x, y in _slices(h, bits, parts):
                    yield from _answers([(part, piece, 0, _joined(_rising(h[x:y]), _small(p.times[order[x:y]])), None, None)]).to_batches()

    def add(table: pa.Table) -> pa.Table:
        sent = [_parted(x) for x in table["data"].to_pylist()]
        hashes = [_of_rising(a) for a, _ in sent]
        _, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([_of_small(b) for _, b in sent])).astype(np.int64)
        out = total[back] * 2
        out[first] += 1
        edges = np.cumsum([0, *map(len, hashes)])
        return _answers([(part, piece, 0, _small(out[a:b]), None, None) for part, piece, a, b in zip(table["part"].to_pylist(), table["piece"].to_pylist(), edges[:-1], edges[1:], strict=True)])

    return state.select(*_STATE).mapInArrow(send, ANSWER).groupBy("part").applyInArrow(add, ANSWER)


def _continued(state: DataFrame, counted: DataFrame, bits: int, parts: int) -> DataFrame:
    """Kind 3: of each of a piece's words its count as context, the pairs with it in front by their count, and those with it behind.
    Kinds 2 and 4: totals of pairs and of words, by language."""

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for piece, langs, data in zip(*[table[c].to_pylist() for c in _STATE], strict=True):
            p = Piece(langs, data)
            c, own = p.counts(bits, _data(answers, 0))
            size = len(p.known)
            of = lambda x: np.bincount(p.context_of[x], minlength=size)
            counts = [np.bincount(p.context_of, weights=p.times, minlength=size), *[of(own & k) for k in (c == 1, c == 2, c >= 3)], np.bincount(p.word_of[own], minlength=size)]
            for part, x, y in _slices(p.known, WORD_BITS, parts):
                out.append((part, piece, 1, _joined(_rising(p.known[x:y]), *[_small(k[x:y]) for k in counts], _small(p.lang_of[x:y])), langs, None))
            lang = p.lang_of[p.context_of]
            out += [(piece % parts, piece, 2, None, [name], _of_counts(c[own & (lang == i)])) for i, name in enumerate(langs)]
        return _answers(out)

    def add(table: pa.Table) -> pa.Table:
        totals = table.filter(pc.equal(table["kind"], 2))
        table = table.filter(pc.equal(table["kind"], 1))
        sent = [_parted(x) for x in table["data"].to_pylist()]
        if not sent:
            return totals
        hashes = [_of_rising(x[0]) for x in sent]
        _, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        sums = [np.bincount(back, weights=np.concatenate([_of_small(x[k]) for x in sent])).astype(np.int64) for k in range(1, 6)]
        edges = np.cumsum([0, *map(len, hashes)])
        out = [(part, piece, 3, _joined(*[_small(s[back[a:b]]) for s in sums]), None, None) for part, piece, a, b in zip(table["part"].to_pylist(), table["piece"].to_pylist(), edges[:-1], edges[1:], strict=True)]
        names: dict[str, int] = {}
        lang = np.concatenate([np.array([names.setdefault(n, len(names)) for n in langs], np.int64)[_of_small(x[6])] for langs, x in zip(table["langs"].to_pylist(), sent, strict=True)])[first]
        out += [(-1, -1, 4, None, [name], _of_counts(sums[4][(lang == i) & (sums[4] > 0)])) for name, i in names.items()]
        return pa.concat_tables([totals, _answers(out)])

    asked = state.select(*_STATE).groupBy("piece").cogroup(counted.groupBy("piece")).applyInArrow(ask, ANSWER)
    return asked.groupBy("part").applyInArrow(add, ANSWER)


# probabilities


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; ``n``: how many counts are 1, 2, 3 and 4."""
    d = [0.0, 0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1]:
                d[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k))
    return np.array(d)


def _row_sums(row: np.ndarray, of: np.ndarray, size: int, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct (row, of) as row * size + of, the place of each, and the sums of ``weights``."""
    key, back = np.unique(row * size + of, return_inverse=True)
    return key, back, [np.bincount(back, weights=x, minlength=len(key)) for x in weights]


def _log_probabilities(p: Piece, row: np.ndarray, pair: np.ndarray, rows: int, count: np.ndarray, context: np.ndarray, before: np.ndarray, pairs: list[int], continued: list[int]) -> np.ndarray:
    """The log-probability of each of ``rows`` texts of a language with the words (row, pair); ``count`` per pair, ``context`` (sum and counts of 1, 2 and 3 or more) and ``before`` per word."""
    high, low, size = discounts(pairs), discounts(continued), len(p.known)
    cut = lambda d, c: d[np.minimum(c, 3)]
    key, times = np.unique(row * len(p.pairs) + pair, return_counts=True)
    row, pair = key // len(p.pairs), key % len(p.pairs)
    c = count[pair]
    left = c - times
    # words, by the pairs that others have
    alone = (left == 0).astype(np.int64)
    wkey, wback, (gone,) = _row_sums(row, p.word_of[pair], size, alone)
    was = before[wkey % size]
    now = was - gone.astype(np.int64)
    wrow = wkey // size
    n1, n2, n3 = continued[0], continued[1], continued[4] - continued[0] - continued[1]
    total = continued[5] - np.bincount(row, weights=alone, minlength=rows)
    held = low[1] * n1 + low[2] * n2 + low[3] * n3 + np.bincount(wrow, weights=cut(low, now) - cut(low, was), minlength=rows)
    some = total > 0
    base = 1 / (continued[4] + 1)  # every word of the language, and one for all others
    single = np.where(some[wrow], (now - cut(low, now) + np.maximum(held, 0)[wrow] * base) / np.maximum(total, 1)[wrow], base)
    # pairs
    ckey, cback, (own, more) = _row_sums(row, p.context_of[pair], size, times, cut(high, left) - cut(high, c))
    at = context[ckey % size]
    whole = at[:, 0] - own
    kept = np.maximum(at[:, 1:] @ high[1:] + more, 0)
    lower = single[wback]
    seen = whole[cback] > 0
    prob = np.where(seen, (left - cut(high, left) + kept[cback] * lower) / np.maximum(whole, 1)[cback], lower)
    return np.bincount(row, weights=times * np.log(np.maximum(prob, 1e-300)), minlength=rows)


def _scores(p: Piece, count: np.ndarray, context: np.ndarray, before: np.ndarray, totals: dict) -> np.ndarray:
    out = np.zeros(len(p.n))
    for i, name in enumerate(p.langs):
        rows = np.flatnonzero((p.lang == i) & (p.n > 0))
        if not len(rows):
            continue
        at = np.flatnonzero(p.lang[p.row] == i)
        ends = np.cumsum(p.n[rows])
        first = 0
        while first < len(rows):
            begin = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + AT_ONCE, "right")))
            words = at[begin : int(ends[last - 1])]
            local = np.repeat(np.arange(last - first), p.n[rows[first:last]])
            out[rows[first:last]] = _log_probabilities(p, local, p.pair[words], last - first, count, context, before, totals[name, 2], totals[name, 4])
            first = last
    return out


def word_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, th, word_lp): the log-probability of all words of each row of ``docs`` (doc_id, th, lang, text); th is the text's hash. 0 for texts without words."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(32, size.bit_length() + SPARE - 2)  # a word has some 6 bytes
    parts, buckets = -(-size // PART) or 1, min(max(2 * size // PIECE, 1), MOST_BUCKETS)
    name = f"lm_pieces_{store.token()}"
    path = store.new_path(spark, "lm-pieces")
    _pieces(docs, kind).write.format("parquet").option("compression", "uncompressed").option("path", path).bucketBy(buckets, "piece").saveAsTable(name)
    state = spark.table(name)
    counted_at, continued_at = store.new_path(spark, "lm-pairs"), store.new_path(spark, "lm-words")
    counted = store.written(_counted(state, bits, parts), "lm-pairs", counted_at)
    store.release(2.0)
    continued = store.written(_continued(state, counted, bits, parts), "lm-words", continued_at)
    store.release(2.0)
    sums = F.array(*[F.sum(F.col("stats")[k]) for k in range(6)]).alias("stats")
    totals = continued.filter("kind in (2, 4)").groupBy(F.col("langs")[0].alias("lang"), "kind").agg(sums).collect()  # two rows per language
    shared = spark.sparkContext.broadcast({(x.lang, x.kind): list(x.stats) for x in totals})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for langs, data in zip(table["langs"].to_pylist(), table["data"].to_pylist(), strict=True):
            p = Piece(langs, data)
            count, _ = p.counts(bits, _data(answers, 0))
            of_words = [_parted(x) for x in _data(answers, 3)]
            stats = [np.concatenate([_of_small(x[k]) for x in of_words]) if of_words else np.zeros(0, np.int64) for k in range(5)]
            out.append(_scores(p, count, np.stack(stats[:4], axis=1), stats[4], shared.value))
        flat = [pc.list_flatten(table[c].combine_chunks()) for c in ("ids", "ths")]
        return pa.table([*flat, pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "th", "word_lp"])

    answers = counted.union(continued.filter("kind = 3")).select("piece", "part", "kind", "data")
    scored = state.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, f"doc_id {kind}, th long, word_lp double")
    found = store.written(scored, "lm-scores")
    spark.sql(f"DROP TABLE {name}")
    for at in (path, counted_at, continued_at):
        store.delete(spark, at)
    return found
