"""Quality rules by n-gram perplexity.

The language model is one of word pairs (``wordmodel``), which grows with the corpus. Beside it stands a model of spelling:
Spark counts the 4-grams of byte classes of every text, per language; from them comes an interpolated modified
Kneser-Ney model per language, stored as a sorted array of grams with their log-probabilities. A document's
perplexity per word by the language model, and per word and per byte by spelling, are compared with its language's bands:
median +- WIDTH robust deviations over all documents of the language, wider for texts of under LONG words, whose
perplexities scatter more. Only above its band is the language model's a fault: copies of other texts are below it. As they
would widen a band of all deviations, its deviations are those above the median alone, of which the band takes WORD_WIDTH.

A byte class has 6 bits, so a language's model has at most 2**24 grams whatever the size of the corpus: that bounds what
is broadcast. Languages are packed into groups of at most GRAMS_AT_ONCE grams, each with its own broadcast and pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, wordmodel
from .textblock import SPACE, U, Words, blocks, mix, span_hashes, window_hashes

ORDER, BITS = 4, 6
BOS = 63
GRAMS_AT_ONCE = 1 << 24
#: Half the band's width in robust standard deviations of the log-perplexity, and at least in nats.
WIDTH, WORD_WIDTH, LEAST = 6.0, 4.0, 0.02
LONG = 200
BIN = 1e-3
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Rows of a table of bands that is broadcast; a larger one is joined.
BROADCAST_ROWS = 100_000
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """The class of each byte: letters a-z alone; capitals, digits, punctuation, symbols and parts of other characters in groups."""
    c = np.zeros(256, np.uint32)
    for b in range(256):
        if 97 <= b <= 122:
            c[b] = b - 97
        elif 65 <= b <= 90:
            c[b] = 26 + b % 8
        elif 48 <= b <= 57:
            c[b] = 34
        elif b == 0x20:
            c[b] = 35
        elif b == 0x0A:
            c[b] = 36
        elif b == ord("."):
            c[b] = 37
        elif b == ord(","):
            c[b] = 38
        elif b in SYMBOLS:
            c[b] = 39 + b % 4
        elif b in b"!?":
            c[b] = 43
        elif b in b"'\"`":
            c[b] = 44
        elif b in b"()[]{}":
            c[b] = 45
        elif b < 0x20 or b == 0x7F:
            c[b] = 47
        elif b < 0x80:
            c[b] = 46
        elif b < 0xC0:
            c[b] = 48 + b % 8
        else:
            c[b] = 56 + b % 4
    return c


CLASS = _classes()


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each byte of the block (texts begin after three BOS), and the byte's text."""
    n = len(w.data)
    row = np.repeat(np.arange(w.rows), np.diff(w.ends))
    padded = np.full(n + (ORDER - 1) * w.rows, BOS, np.uint32)
    at = np.arange(n) + (ORDER - 1) * (row + 1)
    padded[at] = CLASS[w.data]
    code = padded.copy()
    for k in range(1, ORDER):
        code[k:] |= padded[:-k] << np.uint32(BITS * k)
    return code[at], row


def _run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[start], np.diff(np.r_[start, len(x)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[start], np.add.reduceat(n, start)


def _language(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all texts: summed per task first, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            own = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], U)
            for w in blocks(batch.column("text")):
                code, row = grams(w)
                got = _run_lengths(np.sort(code.astype(U) | own[w.first + row] << U(24)))
                if len(got[0]):
                    parts.append(got)
                    waiting += len(got[0])
                if waiting > 2_000_000:
                    parts = [_merged(parts)]
                    waiting = 0
        if parts:
            code, n = _merged(parts)
            names = np.array(list(langs), object)
            for at in range(0, len(code), 100_000):
                c = code[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(names[(c >> U(24)).astype(np.int64)], pa.string()), pa.array((c & U(0xFFFFFF)).astype(np.int32)), pa.array(n[at : at + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    return _language(docs).select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (index 0 unused)."""
    of = [int((n == k).sum()) for k in range(5)]
    d = [0.0, 0.5, 1.0, 1.5]
    if of[1] and of[2]:
        y = of[1] / (of[1] + 2 * of[2])
        for k in (1, 2, 3):
            if of[k]:
                d[k] = min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.0), float(k))
    return np.array(d)


def train(gram: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of one language's 4-gram counts: per order from 1 to 4 the sorted grams and their log-probabilities, the sorted contexts and their log back-off weights."""
    order = np.argsort(gram)
    keys, counts = [gram[order].astype(np.uint32)], [n[order].astype(np.float64)]
    for k in range(ORDER - 1, 0, -1):
        low, seen = np.unique(keys[0] & np.uint32((1 << BITS * k) - 1), return_counts=True)
        keys.insert(0, low)
        counts.insert(0, seen.astype(np.float64))
    probs: list[np.ndarray] = []
    contexts: list[np.ndarray] = []
    backs: list[np.ndarray] = []
    for k in range(ORDER):
        key, c = keys[k], counts[k]
        cut = _discounts(c)[np.minimum(c, 3).astype(np.int64)]
        ctx = key >> np.uint32(BITS)
        start = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        total, held = np.add.reduceat(c, start), np.add.reduceat(cut, start)
        size = np.diff(np.r_[start, len(key)])
        back = held / total
        if k:
            lower = probs[k - 1][np.searchsorted(keys[k - 1], key & np.uint32((1 << BITS * k) - 1))]
        else:
            lower = np.full(len(key), 1 / (1 << BITS))
        probs.append((c - cut) / np.repeat(total, size) + np.repeat(back, size) * lower)
        contexts.append(ctx[start])
        backs.append(np.log(np.maximum(back, 1e-12)))
    return keys, [np.log(p) for p in probs], contexts, backs


def look_up(model, gram: np.ndarray) -> np.ndarray:
    """Log-probability of each of the sorted distinct 4-grams ``gram``."""
    keys, probs, contexts, backs = model
    out, left, weight = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram))
    for k in range(ORDER - 1, -1, -1):
        g = gram[left] & np.uint32((1 << BITS * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(keys[k], g), len(keys[k]) - 1)
        hit = keys[k][at] == g
        out[left[hit]] = weight[hit] + probs[k][at[hit]]
        left, g, weight = left[~hit], g[~hit], weight[~hit]
        if not len(left):
            return out
        ctx = g >> np.uint32(BITS)
        at = np.minimum(np.searchsorted(contexts[k], ctx), len(contexts[k]) - 1)
        weight = weight + np.where(contexts[k][at] == ctx, backs[k][at], 0.0)
    out[left] = weight - np.log(1 << BITS)
    return out


def features(w: Words) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    per_row = lambda flags: (s := np.r_[0, np.cumsum(flags)])[w.ends[1:]] - s[w.ends[:-1]]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    solid = ~SPACE[w.data]
    out = {"n_words": w.counts(), "word_chars": per_row(solid & ((w.data & 0xC0) != 0x80)), "n_symbols": per_row(symbol[w.data])}
    # lines
    n = len(w.data)
    brk = np.flatnonzero(w.data == 0x0A)
    start = np.unique(np.r_[w.ends[:-1], brk + 1])
    start = start[start < n]
    end = np.empty_like(start)
    if len(start):
        stop = np.unique(np.r_[w.ends[1:], brk])
        end = np.where(w.data[start] == 0x0A, start, stop[np.minimum(np.searchsorted(stop, start, "right"), len(stop) - 1)])
    some = np.r_[0, np.cumsum(solid)]
    full = some[end] > some[start]
    start, end = start[full], end[full]
    row = np.searchsorted(w.ends, start, "right") - 1
    h = span_hashes(w.data, start, end) ^ mix(row.astype(U))
    lines = np.bincount(row, minlength=w.rows)
    kept = np.bincount(row[np.unique(h, return_index=True)[1]], minlength=w.rows)
    out["n_dup_lines"] = lines - kept
    # repeated 3-word windows
    g = window_hashes(w.hashes(), 3)
    same = w.doc[:-2] == w.doc[2:] if len(w.doc) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(same)
    cover = np.zeros(len(w.doc) + 3, bool)
    if len(at):
        _, back, times = np.unique(g[at] ^ mix(w.doc[at].astype(U) + U(1)), return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        for k in range(3):
            cover[again + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[cover[: len(w.doc)]], minlength=w.rows)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UNITS = ("by_word", "by_spelling", "by_byte")
SPELLING = UNITS[1:]


def _scored(docs: DataFrame, models: dict) -> DataFrame:
    """doc_id, th, lang, the counts and the log-perplexities by spelling (null for a text without words) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            own = np.array([names[x] for x in langs], np.int64)
            cols: dict[str, list[np.ndarray]] = {c: [] for c in (*COLUMNS, *SPELLING)}
            for w in blocks(batch.column("text")):
                for c, v in features(w).items():
                    cols[c].append(v)
                code, row = grams(w)
                total = np.zeros(w.rows)
                mine = own[w.first : w.first + w.rows]
                q = np.sort((mine[row].astype(U) << U(44)) | (code.astype(U) << U(20)) | row.astype(U))
                lang_of = (q >> U(44)).astype(np.int64)
                edges = np.searchsorted(lang_of, np.arange(len(names) + 1))
                for name, i in names.items():
                    part = q[edges[i] : edges[i + 1]]
                    if not len(part):
                        continue
                    gram, times = _run_lengths(((part >> U(20)) & U(0xFFFFFF)).astype(np.uint32))
                    lp = look_up(known[name], gram)
                    total += np.bincount((part & U(0xFFFFF)).astype(np.int64), weights=np.repeat(lp, times), minlength=w.rows)
                for c, size in zip(SPELLING, (w.counts(), np.diff(w.ends)), strict=True):
                    cols[c].append(np.where(w.counts() > 0, -total / np.maximum(size, 1), np.nan))
            joined = {c: np.concatenate(v) if v else np.zeros(0) for c, v in cols.items()}
            arrays = [batch.column("doc_id"), batch.column("th"), batch.column("lang"), *[pa.array(joined[c].astype(np.int64)) for c in COLUMNS], *[pa.array(np.round(joined[c], 6), from_pandas=True) for c in SPELLING]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "lang", *COLUMNS, *SPELLING])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th long, lang string, " + ", ".join(f"{c} long" for c in COLUMNS) + "".join(f", {c} double" for c in SPELLING))


def quality(docs: DataFrame, width: float = WIDTH, least: float = LEAST, word_width: float = WORD_WIDTH) -> DataFrame:
    """doc_id, the counts, base_failed, the perplexities, their bands and kept of every row of ``docs``.

    word_perplexity is the language model's per word, spelling_perplexity and byte_perplexity are those of spelling per word and byte.

    A null text counts as empty: no words, base_failed, null perplexity. A null language is a language of its own. kept: not
    base_failed, word_perplexity not above its band and the others within theirs. A band is exp(median -+ max(width * 1.4826 * MAD, least) *
    sqrt(max(1, LONG / n_words))) of the log-perplexities of the language's documents that don't fail the base rules, from a
    histogram of 0.001 nats of all of them; word_perplexity's has word_width for width and the MAD of those at or above the median.
    """
    own = _language(docs)
    words = wordmodel.word_scores(own).filter("word_lp <> 0").groupBy(F.col("doc_id").alias("d_"), F.col("th").alias("t_")).agg(F.max("word_lp").alias("word_lp"))  # rows alike in both score alike
    counts = store.written(count_grams(docs), "lm-counts")
    sizes = counts.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    groups: list[list[str]] = [[]]
    room = GRAMS_AT_ONCE
    for name, size in sizes:
        if size > room and groups[-1]:
            groups.append([])
            room = GRAMS_AT_ONCE
        groups[-1].append(name)
        room -= size
    found = None
    for names in groups:
        rows = counts.filter(F.col("lang").isin(names)) if len(groups) > 1 else counts
        table = rows.toArrow()  # at most GRAMS_AT_ONCE rows, or one language's, which has at most 2**24
        models = {}
        lang = table["lang"].combine_chunks().dictionary_encode() if table.num_rows else None
        for i, name in enumerate(lang.dictionary.to_pylist() if lang is not None else []):
            pick = lang.indices.to_numpy() == i
            models[name] = train(table["gram"].to_numpy()[pick], table["n"].to_numpy()[pick])
        part = _scored(own.filter(F.col("lang").isin(names)) if len(groups) > 1 else own, models)
        found = part if found is None else found.union(part)
    known = [x for g in groups for x in g]
    if len(groups) > 1:  # languages without any text
        found = found.union(_scored(own.filter(~F.col("lang").isin(known)), {}))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    found = found.join(words, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")), "left").drop("d_", "t_", "th")
    found = found.withColumn("by_word", F.when(F.col("n_words") > 0, F.round(-F.col("word_lp") / F.col("n_words"), 6)))
    scored = store.written(found.withColumn("base_failed", failed), "lm-quality")
    good = scored.filter("not base_failed and by_word is not null").select("lang", F.explode(F.map_from_arrays(F.array(*map(F.lit, UNITS)), F.array(*UNITS))).alias("unit", "lp"))
    hist = good.groupBy("lang", "unit", F.round(F.col("lp") / BIN).cast("long").alias("bin")).count()
    mid = hist.groupBy("lang", "unit").agg(F.expr("percentile(bin, 0.5, count)").alias("mid"))
    off = hist.join(mid, ["lang", "unit"]).withColumn("off", F.abs(F.col("bin") - F.col("mid")))
    spread = off.filter("unit <> 'by_word' or bin >= mid").groupBy("lang", "unit", "mid").agg(F.expr("percentile(off, 0.5, count)").alias("mad"))
    half = F.greatest(F.col("mad") * BIN * 1.4826 * F.when(F.col("unit") == "by_word", word_width).otherwise(width), F.lit(least))
    per = F.struct((F.col("mid") * BIN).alias("mid"), half.alias("half"))
    band = store.written(spread.groupBy("lang").agg(*[F.max(F.when(F.col("unit") == u, per)).alias(f"{u}_band") for u in UNITS]), "lm-bands")
    out = scored.join(F.broadcast(band) if band.count() <= BROADCAST_ROWS else band, "lang", "left")  # a row per language
    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(LONG)) / F.greatest("n_words", F.lit(1))))
    off = [F.col(u) - F.col(f"{u}_band.mid") for u in UNITS]
    inside = [F.coalesce((x if u == "by_word" else F.abs(x)) <= F.col(f"{u}_band.half") * wider, F.lit(False)) for u, x in zip(UNITS, off, strict=True)]
    edge = lambda u, s: F.when(F.col("n_words") > 0, F.exp(F.col(f"{u}_band.mid") + s * F.col(f"{u}_band.half") * wider))
    edges = [edge(u, s).alias(f"{n}_{u[3:]}") for u in UNITS for s, n in ((-1, "low"), (1, "high"))]
    return out.select("doc_id", *COLUMNS, "base_failed", *[F.exp(u).alias(f"{u[3:]}_perplexity") for u in UNITS], *edges, (~F.col("base_failed") & inside[0] & inside[1] & inside[2]).alias("kept"))


def kept_documents(docs: DataFrame, width: float = WIDTH, least: float = LEAST, word_width: float = WORD_WIDTH) -> DataFrame:
    """``docs`` without the documents that the rules reject; rows that share a doc_id go if any of them is rejected, a null doc_id stays."""
    bad = quality(docs, width, least, word_width).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("b_")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["b_"], "left_anti").select(*[docs[c] for c in docs.columns])
