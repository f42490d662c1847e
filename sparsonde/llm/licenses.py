"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of t words is looked for in windows of at least t + step words, step words apart, so each place it can stand at
lies whole in a window. A window that holds a share CONTAINED of the template's shingles has a similarity of at least
J = CONTAINED * |T| / (|W| + (1 - CONTAINED) * |T|) with it; with b bands of one minimum each it is retrieved with
probability 1 - (1 - J)**b, and b is chosen for that to be 1 - MISSED or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEMPLATES
from .textblock import LOWER, U, Words, blocks, same_doc, span_hashes, window_hashes

SHINGLE, CONTAINED, MISSED = 5, 0.8, 1e-4
#: Words of all templates together: what is broadcast.
MOST_WORDS = 5_000_000
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?()[]{}\"'`*")] = True
LENGTHS = [8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024]


def bare_hashes(w: Words) -> np.ndarray:
    """64 bits of each word in lower case, without punctuation at its ends (a word of nothing else is kept)."""
    data = LOWER[w.data]
    start, end = w.start.copy(), w.end.copy()
    if len(start):
        for _ in range(4):
            start += _PUNCTUATION[data[start]] & (end - start > 1)
            end -= _PUNCTUATION[data[end - 1]] & (end - start > 1)
    return span_hashes(data, start, end)


def _text_words(text: str) -> np.ndarray:
    w = next(iter(blocks(pa.array([text]))))
    return bare_hashes(w)


class Templates:
    """Shingle sets of the templates and their minima, by window size."""

    def __init__(self, texts: dict[str, str], contained: float = CONTAINED, missed: float = MISSED) -> None:
        self.names, self.contained = [n.split("/")[0] for n in texts], contained
        self.sets = [np.unique(window_hashes(_text_words(t), SHINGLE)) for t in texts.values()]
        self.words = [len(_text_words(t)) for t in texts.values()]
        if short := [n for n, s in zip(self.names, self.sets, strict=True) if not len(s)]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        if sum(self.words) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words in all: scan for some of them at a time")
        rng = np.random.default_rng(7)
        self.classes: dict[tuple[int, int], list[int]] = {}
        bands = {}
        for i, n in enumerate(self.words):
            length = next((x for x in LENGTHS if x >= n), n)
            step = max(4, length // 4)
            wide = -(-(length - SHINGLE + 1 + step) // step)  # a window's size in steps
            t = len(self.sets[i])
            j = contained * t / (wide * step + (1 - contained) * t)
            self.classes.setdefault((step, wide), []).append(i)
            bands[step, wide] = max(bands.get((step, wide), 0), math.ceil(math.log(missed) / math.log(1 - min(j, 0.99))))
        self.bands = bands
        most = max(bands.values(), default=0)
        self.mul = (rng.integers(1, 1 << 32, most, dtype=np.uint64) | U(1)).astype(np.uint32)
        self.xor = rng.integers(0, 1 << 32, most, dtype=np.uint64).astype(np.uint32)
        self.minima = [np.array([self._hash(s, k).min() for k in range(most)], np.uint32) for s in self.sets]

    def _hash(self, shingles: np.ndarray, k: int) -> np.ndarray:
        return ((shingles >> U(32)).astype(np.uint32) ^ self.xor[k]) * self.mul[k]

    def find(self, w: Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, template, first word, last word + 1, containment) of each window that holds a template."""
        grams = window_hashes(bare_hashes(w), SHINGLE)
        ok = same_doc(w, SHINGLE)
        n = np.maximum(w.counts() - SHINGLE + 1, 0)
        high = (grams >> U(32)).astype(np.uint32)
        place = np.arange(len(grams)) - np.repeat(w.at[:-1], np.diff(w.at))[: len(grams)]
        row = w.doc[: len(grams)]
        for (step, wide), members in self.classes.items():
            size = -(-n // step) + np.where(n > 0, wide - 1, 0)  # steps of each text, and room so that no window reaches into the next
            base = np.r_[0, np.cumsum(size)]
            total = int(base[-1])
            if not total:
                continue
            at = (base[row] * step + place)[ok]
            use = high[ok]
            hits: set[tuple[int, int]] = set()
            flat = np.empty(total * step, np.uint32)
            for k in range(self.bands[step, wide]):
                flat.fill(0xFFFFFFFF)
                flat[at] = (use ^ self.xor[k]) * self.mul[k]
                low = flat.reshape(-1, step).min(axis=1)
                win = low.copy()
                for s in range(1, wide):
                    np.minimum(win[: total - s], low[s:], out=win[: total - s])
                for i in members:
                    hits.update((int(x), i) for x in np.flatnonzero(win == self.minima[i][k]))
            for x, i in sorted(hits):
                r = int(np.searchsorted(base, x, "right")) - 1
                a = int((x - base[r]) * step)
                b = int(min(a + wide * step, n[r]))
                if b <= a:
                    continue
                inside = np.isin(grams[w.at[r] + a : w.at[r] + b], self.sets[i])
                share = len(np.unique(grams[w.at[r] + a : w.at[r] + b][inside])) / len(self.sets[i])
                if share >= self.contained:
                    where = np.flatnonzero(inside)
                    yield r, i, a + int(where[0]), a + int(where[-1]) + SHINGLE, share


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_licenses, licenses and spans of every row of ``docs``.

    licenses: names of the templates found, sorted. spans: (name, first word, last word + 1, containment) of each, windows that
    overlap merged, with their best containment. Null, empty and short texts have none. Templates (name -> text of five words or
    more; what follows a / in a name isn't part of the licence's) are broadcast: MOST_WORDS words at most, which is checked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, contained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for w in blocks(batch.column("text")):
                last: dict[tuple[int, int], dict] = {}
                for r, i, a, b, share in sorted(known.find(w)):
                    held = last.get((r, i))
                    if held and a < held["last"]:
                        held["last"], held["containment"] = max(held["last"], b), max(held["containment"], share)
                    else:
                        last[r, i] = {"name": known.names[i], "first": a, "last": b, "containment": share}
                        spans[w.first + r].append(last[r, i])
            names = [sorted({s["name"] for s in x}) for x in spans]
            span = pa.list_(pa.struct([("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, span)], ["doc_id", "n_licenses", "licenses", "spans"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_licenses long, licenses array<string>, spans array<struct<name:string,first:long,last:long,containment:double>>")


