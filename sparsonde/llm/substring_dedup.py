"""Substring deduplication over a log-structured index of window hashes.

Each window of 35 words is represented in the index by its smallest 18-word hash, so about a tenth of all word positions
is indexed and equal windows always have an equal entry. A batch's entries are written as a run: an immutable table, bucketed
and sorted by hash. A new batch's run is merge-joined with each run of the index, which moves no history, and then becomes one
of them; when runs pile up, they are merged into one. The index is a folder: a numbered manifest, committed by a rename, lists
its runs, so what a lost driver had written but not committed is not part of it, and another session can go on with it.

What a lookup finds is verified on hashes of the whole 35-word windows, which are compared only within their index entry. The
index keeps those of its batches as well (32 bits each, within a 64-bit entry), so that later batches are verified against batches
whose texts are gone. An entry with many texts is verified in groups dealt by text: a window that is in a group twice is decided
there, and what is in each group once at most goes on to groups dealt by window. So no group grows with one entry or window.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .textblock import SPACE, U, Words, blocks, same_doc, window_hashes

WINDOW, GRAM = 35, 18
#: An entry with more texts than this is verified in several groups.
GROUP = 1024
#: Runs of an index before they are merged, buckets of a run at least, and the bytes of text of the first batch for each bucket.
RUNS, BUCKETS, BUCKET_BYTES = 4, 16, 1 << 26


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each ``n`` consecutive values."""
    have = 1
    while have * 2 <= n:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def entries(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each window's index hash and whole hash (0 where it isn't of one text), and the positions and hashes of the grams that are some window's smallest."""
    h = w.hashes()
    ok = same_doc(w, window)
    if not ok.any():
        none = np.zeros(0, U)
        return np.zeros(len(ok), U), np.zeros(len(ok), U), np.zeros(0, np.int64), none
    grams = window_hashes(h, gram) | U(1)
    low = np.where(ok, _sliding(grams, window - gram + 1, np.minimum), U(0))
    pad = np.zeros(window - gram, U)
    top = _sliding(np.concatenate([pad, low, pad]), window - gram + 1, np.maximum)
    at = np.flatnonzero(top == grams)
    return low, np.where(ok, window_hashes(h, window, base=0x8EBC6AF09C88C6E3), U(0)), at, grams[at]


def _text_hashes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("h2"))


def _entry_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(fp, h1, h2, n): how often each index hash occurs in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for w in blocks(batch.column("text")):
                _, _, at, fp = entries(w, window, gram)
                if not len(at):
                    continue
                doc = w.doc[at]
                order = np.lexsort((fp, doc))
                fp, doc = fp[order], doc[order]
                cut = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])])
                n = np.diff(np.r_[cut, len(fp)])
                row = doc[cut] + w.first
                yield pa.RecordBatch.from_arrays([pa.array(fp[cut].view(np.int64)), pa.array(h1[row]), pa.array(h2[row]), pa.array(n.astype(np.int32))], ["fp", "h1", "h2", "n"])

    return texts.select("text", "h1", "h2").mapInArrow(run, "fp long, h1 long, h2 long, n int")


class FingerprintIndex:
    """An index in a folder of the shared store. Opened on a folder that holds one, it goes on with it.

    ``runs`` are the paths of its runs of entries (fp, n), oldest first, ``window_runs`` those of whole windows (fp, hashes).
    ``keep_windows=False`` saves those; then only batches of one call are verified against each other.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, keep_windows: bool = True) -> None:
        self.spark, self.keep_windows = spark, keep_windows
        self.path = path or store.new_path(spark, "fingerprints")
        self.state = {"version": 0, "window": window, "gram": gram, "buckets": None, "runs": [], "window_runs": []}
        found = [int(n.removeprefix("manifest-")) for n in store.names(spark, self.path) if n.startswith("manifest-") and not n.endswith(".tmp")]
        if found:
            self.state = json.loads(store.read_bytes(spark, f"{self.path}/manifest-{max(found)}"))
        if (self.window, self.gram) != (window, gram):
            raise ValueError(f"the index in {self.path} has windows of {self.window} and grams of {self.gram} words")

    window, gram, buckets, runs, window_runs = (property(lambda self, k=k: self.state[k]) for k in ("window", "gram", "buckets", "runs", "window_runs"))

    def _commit(self, **changed) -> None:
        """The index as it is from now on."""
        state = {**self.state, **changed, "version": self.state["version"] + 1}
        store.commit(self.spark, f"{self.path}/manifest-{state['version']}", json.dumps(state))
        self.state = state

    def _write(self, rows: DataFrame) -> str:
        """A run, in a folder of its own; it isn't part of the index before it is committed."""
        path = f"{self.path}/run-{store.token()}"
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        rows.repartition(self.buckets, "fp").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        store.release()
        return path

    def _run(self, path: str) -> DataFrame:
        """A run as a bucketed table, whichever session wrote it."""
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _drop(self, paths: list[str]) -> None:
        for path in paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[-1].replace('-', '_')}")
            store.delete(self.spark, path)

    def read(self) -> DataFrame:
        """(fp, n) of all runs."""
        out = self.spark.createDataFrame([], "fp long, n long")
        for path in self.runs:
            out = out.union(self._run(path))
        return out

    def _found(self, run: str) -> DataFrame:
        """(fp, seen): the entries of a run that it holds twice or that the index holds; how often at least, together."""
        own = self._run(run)
        out = own.filter("n > 1").select("fp", F.col("n").alias("seen"))
        for path in self.runs:
            if path != run:
                out = out.union(own.join(self._run(path).withColumnRenamed("n", "before"), "fp").select("fp", (F.col("n") + F.col("before")).alias("seen")))
        return out.groupBy("fp").agg(F.max("seen").alias("seen"))

    def lookup(self, docs: DataFrame) -> DataFrame:
        """(fp, seen): the entries of the batch ``docs`` (doc_id, text) that it or the index holds again. The index stays as it is."""
        self._size_for(docs)
        run = self._write(_entry_rows(_text_hashes(docs), self.window, self.gram).groupBy("fp").agg(F.sum("n").alias("n")))
        found = store.written(self._found(run), "substr-lookup")
        self._drop([run])
        return found

    def add(self, docs: DataFrame) -> DataFrame:
        """Looks the batch ``docs`` (doc_id, text) up and appends its run; returns what lookup() gives, as a written table."""
        self._size_for(docs)
        texts = _text_hashes(docs)
        run = self._write(_entry_rows(texts, self.window, self.gram).groupBy("fp").agg(F.sum("n").alias("n")))
        found = store.written(self._found(run), "substr-lookup")
        windows = list(self.window_runs)
        if self.keep_windows:
            windows.append(f"{self.path}/windows-{store.token()}")
            _all_windows(texts, self.window, self.gram).sortWithinPartitions("fp").write.option("compression", "uncompressed").parquet(windows[-1])
        self._commit(runs=[*self.runs, run], window_runs=windows)
        if len(self.runs) > RUNS:
            self.compact()
        return found

    def _size_for(self, docs: DataFrame) -> None:
        if self.buckets is None:
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            self.state["buckets"] = max(BUCKETS, -(-size // BUCKET_BYTES))

    def compact(self) -> None:
        """Merges the runs into one and deletes them."""
        if len(self.runs) > 1:
            old, merged = self.runs, self._write(self.read().groupBy("fp").agg(F.sum("n").alias("n")))
            self._commit(runs=[merged])
            self._drop(old)

    def windows(self) -> DataFrame | None:
        """(fp, hashes): the windows of all batches, 32 bits each; None if there are none."""
        return self.spark.read.schema("fp long, hashes binary").parquet(*self.window_runs) if self.window_runs else None


def _short(whole: np.ndarray) -> np.ndarray:
    return (whole >> U(32)).astype(np.uint32)


def _all_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(fp, hashes): the whole hashes of each text's windows, by index entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in blocks(batch.column("text")):
                low, whole, _, _ = entries(w, window, gram)
                at = np.flatnonzero(low)
                if len(at):
                    cut = np.flatnonzero(np.r_[True, (low[at][1:] != low[at][:-1]) | (np.diff(at) > 1)])
                    pieces = [_short(whole[at[a:b]]).tobytes() for a, b in zip(cut, [*cut[1:], len(at)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(low[at[cut]].view(np.int64)), pa.array(pieces, pa.binary())], ["fp", "hashes"])

    return texts.select("text").mapInArrow(run, "fp long, hashes binary")


GROUPED = "fp long, part int, parts int, h1 long, h2 long, starts binary, hashes binary"


def _grouped(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in GROUPED.split(", ")])


def _earlier_groups(rows: DataFrame) -> DataFrame:
    """Windows of earlier batches (fp, hashes, seen) as rows for _repeated, without a text of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fp, raw, seen in zip(*[batch.column(c).to_pylist() for c in ("fp", "hashes", "seen")], strict=True):
                groups = max(-(-seen // GROUP), 1)
                out.append((fp, zlib.crc32(raw) % groups, groups, None, None, bytes(len(raw)), raw))
            yield _grouped(out)

    return rows.select("fp", "hashes", "seen").mapInArrow(run, GROUPED)


def _digests(w: Words, gone: np.ndarray) -> list[str]:
    """The SHA-256 of each text's words that aren't ``gone``, joined by one space."""
    kept = np.flatnonzero(~gone)
    n = len(w.data)
    edge = np.zeros(n + 2, np.int8)
    last = np.r_[w.doc[kept][1:] != w.doc[kept][:-1], True] if len(kept) else np.zeros(0, bool)
    edge[w.start[kept]] = 1
    edge[w.end[kept] + ~last] -= 1
    mask = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    out = np.where(SPACE[w.data], np.uint8(0x20), w.data)[mask]
    at = np.r_[0, np.cumsum(mask)][w.ends]
    return [hashlib.sha256(out[at[r] : at[r + 1]]).hexdigest() for r in range(w.rows)]


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:n]) > 0


def _first_pass(rows: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """Finishes the texts that share no index entry and the exact copies; the text goes on only where its windows are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, first, fps = batch.column("copies").to_numpy(), batch.column("first").to_numpy(zero_copy_only=False), batch.column("fps")
            has = fps.is_valid().to_numpy(zero_copy_only=False)
            size, removed, sha = [], [], []
            for w in blocks(batch.column("text")):
                n = w.counts()
                gone = np.repeat((copies[w.first : w.first + w.rows] > 1) & (n >= window), n)
                size.append(n)
                removed.append(np.bincount(w.doc[gone], minlength=w.rows))
                sha += _digests(w, gone)
            size, removed = np.concatenate(size) if size else np.zeros(0, np.int64), np.concatenate(removed) if removed else np.zeros(0, np.int64)
            emit = has & (size >= window) & ((copies == 1) | first)
            done = ~(has & (size >= window)) | (copies > 1)
            blank = pa.array(~emit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(size), pa.array(removed), pa.array(sha, pa.string()), pa.array(done), pa.array(emit), pc.if_else(blank, pa.scalar(None, pa.string()), batch.column("text")), pc.if_else(blank, pa.scalar(None, fps.type), fps)],
                ["doc_id", "h1", "h2", "n_words", "n_removed", "kept_sha256", "done", "emit", "text", "fps"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, n_words long, n_removed long, kept_sha256 string, done boolean, emit boolean, text string, fps array<struct<fp:long,seen:long>>")


def _window_groups(pending: DataFrame, window: int, gram: int) -> DataFrame:
    """(fp, part, parts, h1, h2, starts, hashes): the windows of each text by index entry; those of a large entry are dealt into parts by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, lists = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("fps")
            offs = lists.offsets.to_numpy()
            known, seen = lists.values.field("fp").to_numpy().view(U), lists.values.field("seen").to_numpy()
            for w in blocks(batch.column("text")):
                low, whole, _, _ = entries(w, window, gram)
                out = []
                for r in range(w.rows):
                    a, b = w.at[r], w.at[r + 1] - window + 1
                    if b <= a:
                        continue
                    s = slice(offs[w.first + r], offs[w.first + r + 1])
                    order = np.argsort(known[s])
                    k, many = known[s][order], seen[s][order]
                    at = np.minimum(np.searchsorted(k, low[a:b]), len(k) - 1)
                    pick = np.flatnonzero(k[at] == low[a:b])
                    if not len(pick):
                        continue
                    pick = pick[np.argsort(low[a:b][pick], kind="stable")]
                    fp = low[a:b][pick]
                    cut = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
                    one, two = int(h1[w.first + r]), int(h2[w.first + r])
                    for x, y in zip(cut, [*cut[1:], len(fp)], strict=True):
                        groups = max(-(-int(many[at[pick[x]]]) // GROUP), 1)
                        out.append((int(fp[x : x + 1].view(np.int64)[0]), (one ^ two) % groups, groups, one, two, pick[x:y].astype(np.int32).tobytes(), _short(whole[a:b][pick[x:y]]).tobytes()))
                if out:
                    yield _grouped(out)

    return pending.select("h1", "h2", "text", "fps").mapInArrow(run, GROUPED)


def _by_group(groups: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of each (fp, part) or several of them, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, part = batch.column("fp").to_numpy(), batch.column("part").to_numpy()
            split = int(np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (part[1:] != part[:-1])])[-1])
            if split == 0 and held and held[-1].column("fp")[-1].as_py() == fp[-1] and held[-1].column("part")[-1].as_py() == part[-1]:
                held.append(batch)
                continue
            if held or split:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, split)]).combine_chunks())
            held = [batch.slice(split)]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return groups.repartition("fp", "part").sortWithinPartitions("fp", "part").mapInArrow(run, schema)


def _repeated(groups: DataFrame) -> DataFrame:
    """(h1, h2, starts): the windows whose hash occurs twice or more in their entry.

    First in groups dealt by text; of large entries, windows that are in their group once go on to groups dealt by window.
    """

    def compared(table: pa.Table, go_on: bool) -> Iterator[pa.RecordBatch]:
        lists = table["hashes"].to_pylist()
        size = np.fromiter((len(x) // 4 for x in lists), np.int64, len(lists))
        h = np.frombuffer(b"".join(lists), np.uint32)
        starts = np.frombuffer(b"".join(table["starts"].to_pylist()), np.int32)
        row = np.repeat(np.arange(len(lists)), size)
        fp, part = table["fp"].to_numpy(), table["part"].to_numpy()
        group = np.cumsum(np.r_[False, (fp[1:] != fp[:-1]) | (part[1:] != part[:-1])])
        _, back, times = np.unique(group[row].astype(U) << U(32) | h.astype(U), return_inverse=True, return_counts=True)
        again = times[back] > 1
        groups, h1, h2 = table["parts"].to_numpy()[row], table["h1"].to_pylist(), table["h2"].to_pylist()
        ask = (groups > 1) & go_on
        parts = np.where(ask, h.astype(np.int64) % groups, 0)
        use = np.flatnonzero(again | ask)
        # One window that is repeated goes on for its group, so that it meets those that are alone in theirs.
        if go_on:
            _, first = np.unique(back, return_index=True)
            lead = np.zeros(len(row), bool)
            lead[first] = True
            more = np.flatnonzero(again & ask & lead)
        else:
            more = np.zeros(0, np.int64)
        out = []
        key = np.stack([row, again, np.where(again, 0, parts)])
        use = use[np.lexsort(key[::-1, use])]
        cut = np.flatnonzero(np.r_[True, (key[:, use][:, 1:] != key[:, use][:, :-1]).any(axis=0)]) if len(use) else np.zeros(0, np.int64)
        for x, y in zip(cut, np.r_[cut[1:], len(use)][: len(cut)], strict=True):
            at = use[x:y]
            r = int(row[at[0]])
            if again[at[0]]:
                if h1[r] is not None:
                    out.append((None, None, 1, h1[r], h2[r], starts[at].tobytes(), None))
            else:
                out.append((int(fp[r]), int(parts[at[0]]), 1, h1[r], h2[r], starts[at].tobytes(), h[at].tobytes()))
        out += [(int(fp[row[k]]), int(parts[k]), 1, None, None, bytes(4), h[k : k + 1].tobytes()) for k in more]
        if out:
            yield _grouped(out)

    first = store.written(_by_group(groups, lambda t: compared(t, True), GROUPED), "substr-compared")
    second = _by_group(first.filter("fp is not null"), lambda t: compared(t, False), GROUPED)
    return first.filter("fp is null").union(second).select("h1", "h2", "starts")


def _last_pass(rows: DataFrame, kind: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found").to_pylist()
            for w in blocks(batch.column("text")):
                n = w.counts()
                gone = np.zeros(len(w.doc), bool)
                for r in range(w.rows):
                    if lists[w.first + r]:
                        gone[w.at[r] : w.at[r + 1]] = _covered(int(n[r]), np.frombuffer(b"".join(lists[w.first + r]), np.int32), window)
                ids = batch.column("doc_id").slice(w.first, w.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(np.bincount(w.doc[gone], minlength=w.rows)), pa.array(_digests(w, gone), pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "found").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``: the words covered by a window that also starts elsewhere are removed.

    The rows go through ``index`` (a new one if None) in ``batches`` batches, dealt by their text's hash: each is looked up, then
    appended. What the lookups found is verified, and the runs are merged. Windows of the index's earlier batches count as
    elsewhere if it keeps windows. Null, empty and short texts have no window and stay whole. Rows alike in text are copies
    of each other.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark)
    earlier = index.windows()
    window, gram = index.window, index.gram
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = _text_hashes(docs)
    found = None
    for b in range(batches):
        part = index.add(texts.filter(F.pmod("h1", F.lit(batches)) == b))
        found = part if found is None else found.union(part)
    index.compact()
    shared = store.written(found.groupBy("fp").agg(F.max("seen").alias("seen")), "substr-shared")
    hits = _entry_rows(texts, window, gram).join(shared, "fp").dropDuplicates(["h1", "h2", "fp"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("fp", "seen")).alias("fps"))
    copies = texts.groupBy("h1", "h2").agg(F.count("*").cast("int").alias("copies"), F.min("doc_id").alias("first_id"))
    known = store.written(copies.join(hits, ["h1", "h2"], "left").filter("copies > 1 or fps is not null"), "substr-known")
    rows = texts.join(known, ["h1", "h2"], "left").select("doc_id", "h1", "h2", "text", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("doc_id").eqNullSafe(F.col("first_id")).alias("first"), "fps")
    passed = store.written(_first_pass(rows, kind, window, gram), "substr-first")
    groups = _window_groups(passed.filter("emit"), window, gram)
    if earlier is not None:
        groups = groups.union(_earlier_groups(earlier.join(shared, "fp")))
    repeated = store.written(_repeated(groups), "substr-found")
    open_rows = passed.filter("not done").select("doc_id", "h1", "h2", "text")
    lists = repeated.groupBy("h1", "h2").agg(F.collect_list("starts").alias("found"))
    last = _last_pass(open_rows.join(lists, ["h1", "h2"], "left"), kind, window)
    return passed.filter("done").select("doc_id", "n_words", "n_removed", "kept_sha256").union(last)
