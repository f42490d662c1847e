"""Token ids in training order, as fixed-stride shards.

Documents become sequences of LENGTH token ids (the last one padded). Every sequence has a number from 0 to N - 1, by doc_id,
text and place in the text, however the input is split, and a keyed Feistel permutation of that range, with cycle-walking, gives
its slot. Slots are range-partitioned into shards of SHARD
slots each, sorted, and written as records of one size: slot s is record s % SHARD of shard s // SHARD, at a known offset.
Spark's own writer makes the files, so they can lie in any store and a task that runs twice leaves one copy.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .textblock import BLOCK, U, mix

LENGTH, SHARD, EOS = 512, 4096, 50256
#: Fixed value: the usual splitting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUNDS = 6
#: A shard is one file, written by one task and read in one piece.
SHARD_BYTES = 64 << 20


@dataclass
class Manifest:
    sequences: int
    length: int
    shard: int
    key: int
    eos: int
    bytes_per_id: int = 2

    @property
    def stride(self) -> int:
        """Bytes of a record: the ids, little-endian, and a newline."""
        return self.length * self.bytes_per_id + 1


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1 at ``x``: rounds over the next even power of two, repeated while the result is too large."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = U((1 << half) - 1), U(half)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & low
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + U((key * 1_000_003 + r * 0x9E3779B97F4A7C15) % (1 << 64))) & low)
        return left << shift | right

    out = once(x.astype(U))
    while len(again := np.flatnonzero(out >= U(n))):
        out[again] = once(out[again])
    return out.astype(np.int64)


_loaded: dict[str, tiktoken.Encoding] = {}


def _encoding(name: str, pattern: str) -> tiktoken.Encoding:
    if name not in _loaded:
        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def sequences(docs: DataFrame, ranks_file: str, length: int = LENGTH, eos: int = EOS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, part, n_tokens, ids, task, row): the sequences of each text's tokens and the end mark; ``ids`` are ``length`` 16-bit ids.

    ``ranks_file``: a byte-level BPE vocabulary as ranks, on the driver; its ids must be below 65,536. A null or empty text has
    the end mark alone. Rows are dealt by ranges of doc_id and then of a hash of the text, so ``task`` and ``row`` number the
    sequences in that order; equal rows of one id are alike and may be dealt to several ranges.
    """
    docs.sparkSession.sparkContext.addFile(ranks_file)
    name = ranks_file.rsplit("/", 1)[-1]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, made = _encoding(name, pattern).encode_ordinary, TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[np.ndarray] = []
            texts = batch.column("text")
            first = waiting = 0
            for i in range(batch.num_rows):
                held.append(np.array([*encode(texts[i].as_py() or ""), eos], np.uint16))
                waiting += len(held[-1])
                if waiting * 4 < BLOCK and i + 1 < batch.num_rows:
                    continue
                total = np.array([len(x) for x in held])
                parts = -(-total // length)
                begin = np.r_[0, np.cumsum(parts)[:-1]]
                seqs = int(parts.sum())
                row = np.repeat(np.arange(len(held)), parts)
                part = np.arange(seqs) - begin[row]
                out = np.full((seqs, length), eos, np.uint16)
                for x, at in zip(held, begin * length, strict=True):
                    out.ravel()[at : at + len(x)] = x
                tokens = np.minimum(total[row] - part * length, length)
                raw = pa.Array.from_buffers(pa.binary(), seqs, [None, pa.py_buffer((np.arange(seqs + 1) * (2 * length)).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + first)), pa.array(part), pa.array(tokens), raw, pa.array(np.full(seqs, task)), pa.array(np.arange(made, made + seqs))], ["doc_id", "part", "n_tokens", "ids", "task", "row"])
                made += seqs
                held, first, waiting = [], i + 1, 0

    dealt = docs.select("doc_id", docs["text"].cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "hash", F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return dealt.mapInArrow(run, f"doc_id {kind}, part long, n_tokens long, ids binary, task long, row long")


def write_shards(docs: DataFrame, ranks_file: str, path: str, key: int = 20240611, length: int = LENGTH, shard: int = SHARD, eos: int = EOS) -> DataFrame:
    """Writes the shards and their manifest below ``path``; returns doc_id, part, n_tokens, slot, shard and offset of each sequence.

    Sequences are numbered by doc_id (null first), then by a hash of the text: the same rows get the same slots however they are
    split. Rows may repeat, and null ids are written like others. No rows: no shards, N = 0. A shard of over SHARD_BYTES raises.
    """
    if shard * (2 * length + 1) > SHARD_BYTES:
        raise ValueError(f"a shard of {shard} records of {length} ids is larger than {SHARD_BYTES} bytes")
    spark = docs.sparkSession
    made_at = store.new_path(spark, "sequences")
    made = store.written(sequences(docs, ranks_file, length, eos), "sequences", made_at)
    per_task = made.groupBy("task").agg(F.count("*").alias("n"))  # a row per task
    first = store.written(per_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("all")), "sequence-offsets")
    total = first.agg(F.max("all")).first()[0] or 0
    about = Manifest(total, length, shard, key, eos)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), total, key))

    placed = made.join(F.broadcast(first) if first.count() <= 100_000 else first, "task").withColumn("slot", slot(F.col("first") + F.col("row")))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard))
    place = store.written(placed.select("doc_id", "part", "n_tokens", "slot", "shard", ((F.col("slot") % shard) * about.stride).alias("offset")), "slots")
    ordered_at = _ordered(placed, total, shard)
    del placed, made
    store.release(wait=2.0)
    store.delete(spark, made_at)
    ordered = spark.read.schema("slot long, ids binary, shard long").parquet(ordered_at) if total else spark.createDataFrame([], "slot long, ids binary, shard long")
    records = ordered.sortWithinPartitions("shard", "slot").select(F.col("ids").cast("string").alias("value"), "shard")  # a shard is one small file, so one task has it whole
    records.write.partitionBy("shard").mode("overwrite").text(f"{path}/shards")
    store.delete(spark, ordered_at)
    spark.createDataFrame([(json.dumps(asdict(about)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return place


def _ordered(placed: DataFrame, total: int, shard: int) -> str:
    """Range-partitions the sequences by slot into a compressed table, a file per shard: so the unsorted sequences and the shuffle's files can go before the records are written at their full size."""
    spark = placed.sparkSession
    shards = -(-total // shard)
    ways = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = placed.select("slot", "ids", "shard").repartitionById(ways, F.floor(F.col("shard") * ways / max(shards, 1)).cast("int")).sortWithinPartitions("shard", "slot")
    path = store.new_path(spark, "ordered")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path


def read_manifest(path: str, spark: SparkSession | None = None) -> Manifest:
    if spark is None:
        return Manifest(**json.loads(next(Path(path, "manifest").glob("part-*")).read_text()))
    folder = f"{path}/manifest"
    return Manifest(**json.loads(store.read_bytes(spark, f"{folder}/{_part(store.names(spark, folder))}")))


def _part(names: list[str]) -> str:
    return next(x for x in names if x.startswith("part-"))


def read_slots(path: str, start: int, count: int, spark: SparkSession | None = None) -> Iterator[np.ndarray]:
    """The ids of slots ``start`` .. ``start + count``, in order: a reader resumes at any slot.

    ``path`` is a local copy of the shards or, with ``spark``, a folder of any store that the session can open.
    """
    m = read_manifest(path, spark)
    at, stop = start, min(start + count, m.sequences)
    while at < stop:
        k, i = divmod(at, m.shard)
        folder = f"{path}/shards/shard={k}"
        n = min(stop - at, m.shard - i)
        if spark is None:
            raw = np.fromfile(next(Path(folder).glob("part-*")), np.uint8, n * m.stride, offset=i * m.stride)
        else:
            raw = np.frombuffer(store.read_bytes(spark, f"{folder}/{_part(store.names(spark, folder))}", i * m.stride, n * m.stride), np.uint8)
        yield from np.ascontiguousarray(raw.reshape(n, m.stride)[:, :-1]).view(np.uint16)
        at += n


def write_temporary(docs: DataFrame, ranks_file: str, **more) -> DataFrame:
    """As write_shards, into a new folder of the shared directory."""
    return write_shards(docs, ranks_file, store.new_path(docs.sparkSession, "shards"), **more)
