"""Operator 2: token ids in binary shards, with constant-time access by document key.

A store is a folder of shards in ascending key order, none much over ``SHARD_BYTES``.  ``K.ids`` is a shard's raw payload, ids one after the
other (little-endian, 16 bits if the vocabulary allows, else 32).  ``K.index`` holds a minimal perfect
hash of the shard's keys with a fingerprint for each, the row range of each slot, and the offset of
each row: a key's ids are one hash, one fingerprint test and one read away.

Rows of one key are dealt by their texts too, so a key with a third of all rows is in many tasks and shards, and a
look-up goes to each of its shards.  Two keys of one 64-bit hash are never put into one shard.

Tasks write files under names of their own attempt, and only the rows that Spark accepts name them, so a
task that is lost and run again leaves at worst a file that nothing refers to.
"""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoder import encoder, resolve
from ..functions.ranking import running
from ..sources.scratch import staged
from .perfect_hash import PerfectHash, packed, unpacked


#: A shard is closed once its payload has so many bytes, or its index so many rows.
SHARD_BYTES = 32 * 1024 * 1024
SHARD_ROWS = 1_000_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Shard:
    """A shard's index, and its payload opened for reading."""

    def __init__(self, base: str):
        fs, path = _open(base)
        with fs.open_input_file(f"{path}.index") as file:
            arrays, head = unpacked(file.read())
        self.kind = np.dtype(head["kind"])
        self.hash = PerfectHash(*(arrays[k] for k in ("sizes", "bits", "before", "prints")))
        self.first, self.rows, self.offsets = arrays["first"], arrays["rows"], arrays["offsets"]
        self._file = fs.open_input_file(f"{path}.ids")

    def row_range(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key hash; no rows for keys that the shard hasn't."""
        slots = self.hash.slots(hashes)
        if not len(self.first):
            return np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        return np.where(slots < 0, 0, self.first[slots]).astype(np.int64), np.where(slots < 0, 0, self.rows[slots]).astype(np.int64)

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + 1])
        size = self.kind.itemsize
        return np.frombuffer(self._file.read_at((b - a) * size, a * size), self.kind)


def _write_shard(folder: str, hashes: list[int], payload: list[bytes], lengths: list[int], kind: str) -> str:
    """Writes both files; keys come in order, so rows of one key are neighbours. Returns their common path."""
    keys = np.array(hashes, np.int64).view(np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    table = PerfectHash.build(keys[starts])
    first, rows = np.zeros(len(starts), "<u4"), np.zeros(len(starts), "<u4")
    slots = table.slots(keys[starts])
    first[slots], rows[slots] = starts, np.diff(np.r_[starts, len(keys)])
    offsets = np.r_[0, np.cumsum(lengths)].astype("<u8")
    base = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
    fs, path = _open(base)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.ids") as file:
        for part in payload:
            file.write(part)
    with fs.open_output_stream(f"{path}.index") as file:
        file.write(packed(table.arrays() | {"first": first, "rows": rows, "offsets": offsets}, kind=kind))
    return base


class _OpenShard:
    """What one task holds before it writes a shard."""

    def __init__(self, most: int):
        self.most = most
        self.keys: list[pa.Array] = []
        self.hashes: list[int] = []
        self.known: set[int] = set()
        self.payload: list[bytes] = []
        self.lengths: list[int] = []
        self.bytes = 0

    @property
    def full(self) -> bool:
        return self.bytes >= self.most or len(self.hashes) >= SHARD_ROWS

    def add(self, hashed: int, ids: bytes, length: int) -> None:
        self.hashes.append(hashed)
        self.known.add(hashed)
        self.payload.append(ids)
        self.lengths.append(length)
        self.bytes += len(ids)

    def close(self, folder: str, shard: int, kind: str) -> pa.RecordBatch:
        """Writes the files and gives the directory's rows."""
        base, h, n = _write_shard(folder, self.hashes, self.payload, self.lengths, kind), self.hashes, len(self.hashes)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(self.keys), pa.array([shard] * n, pa.int64()), pa.array([base] * n, pa.string()), pa.array(h, pa.int64()), pa.array(range(n), pa.int64()),
                pa.array([k == 0 or h[k] != h[k - 1] for k in range(n)], pa.bool_()), pa.array(self.lengths, pa.int64()),
            ],
            names=["key", "shard", "base", "key_hash", "row", "first", "n_tokens"],
        )


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text, writes the store under ``folder`` (a URI all machines can reach), returns its directory.

    The directory has a row per document, in the order of the store: key, shard, base (path without
    ending), key_hash, row, first (of the rows of its key in its shard), n_tokens; it is written as Parquet to
    ``folder/directory``.  Null text: the end
    id alone.  Null keys come first, and rows of equal keys follow each other in the order of their texts' hashes;
    all of them are found by their key.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("key_hash"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "text_hash").sortWithinPartitions("key", "text_hash", "text").drop("text_hash")
    kept = rows.schema["key"]
    out = T.StructType([kept, T.StructField("shard", T.LongType()), T.StructField("base", T.StringType()), T.StructField("key_hash", T.LongType()), T.StructField("row", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("n_tokens", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(resolve(tokenizer))
        kind = "<u2" if max(worker.size, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 32
        shard, before = _OpenShard(shard_bytes), None
        for batch in batches:
            keys, start = batch.column(0), 0
            hashes = batch.column(1).to_pylist()
            # neighbours of one hash may still be two keys
            plain = keys.to_pylist()
            for k, ids in enumerate(worker.encode(batch.column(2).to_pylist())):
                other = not shard.hashes or plain[k] != before
                if shard.full or (other and hashes[k] in shard.known):
                    if k > start:
                        shard.keys.append(keys.slice(start, k - start))
                    yield shard.close(folder, number, kind)
                    shard, start, number = _OpenShard(shard_bytes), k, number + 1
                ids += end
                shard.add(hashes[k], np.frombuffer(ids, "<u4").astype(kind).tobytes(), len(ids) // 4)
                before = plain[k]
            if len(keys) > start:
                shard.keys.append(keys.slice(start))
        if shard.hashes:
            yield shard.close(folder, number, kind)

    path = f"{folder}/directory"
    rows.mapInArrow(write, out).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out).parquet(path)


def _rows_of(base: str, shards: OrderedDict[str, Shard], most: int = 2) -> Shard:
    """The shard at ``base``; a few stay open."""
    if base not in shards:
        while len(shards) >= most:
            shards.popitem(last=False)
        shards[base] = Shard(base)
    return shards[base]


def read_keys(routed: DataFrame, with_ids: bool = True) -> DataFrame:
    """routed: key, key_hash, base, as from the directory or ``route``. Result: a row per stored row of each key.

    Columns: key, base, row, start (ids before it in its shard), n_tokens, ids_crc32 (of 32-bit ids), ids (array,
    if asked for).  Keys that a shard hasn't give no row.  Rows in shard order open each shard once.
    """
    kept = routed.schema["key"]
    fields = [kept] + [T.StructField(n, t) for n, t in (("base", T.StringType()), ("row", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: OrderedDict[str, Shard] = OrderedDict()
        for batch in batches:
            bases = batch.column(2).to_pylist()
            hashes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cuts = [0, *(k for k in range(1, len(bases)) if bases[k] != bases[k - 1]), len(bases)]
            take, found = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi or bases[lo] is None:
                    continue
                shard = _rows_of(bases[lo], shards)
                first, many = shard.row_range(hashes[lo:hi])
                for k in range(hi - lo):
                    for row in range(int(first[k]), int(first[k] + many[k])):
                        ids = shard.ids(row)
                        take.append(lo + k)
                        found.append((bases[lo], row, int(shard.offsets[row]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
            columns = list(zip(*found)) if found else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + with_ids]
            arrays = [batch.column(0).take(pa.array(take, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "base", "row", "start", "n_tokens", "ids_crc32", "ids"][: 6 + with_ids])

    return routed.select("key", "key_hash", "base").mapInArrow(read, T.StructType(fields))


def shard_starts(directory: DataFrame) -> DataFrame:
    """A row per shard: base, number (from 0, in the order of the store), before (ids in all shards before it), first_key, last_key.

    Ids are summed over range-partitioned stretches of the order, so no task sees all shards.
    """
    each = directory.groupBy("shard", "base").agg(F.sum("n_tokens").alias("_n"), F.min_by("key", "row").alias("first_key"), F.max_by("key", "row").alias("last_key"), F.lit(1).cast("long").alias("_one"))
    at = running(each, [], ["shard"], {"_upto": ("sum", "_n"), "_number": ("sum", "_one")})
    return at.select("base", (F.col("_number") - 1).alias("number"), (F.col("_upto") - F.col("_n")).alias("before"), "first_key", "last_key")


def read_all(directory: DataFrame) -> DataFrame:
    """A row per document, read back from the files: key, start (ids of all documents before it), n_tokens, ids_crc32.

    Each key of the directory is looked up once in its shard; a key with several rows gives them all.
    """
    back = read_keys(directory.where("first"), with_ids=False)
    starts = shard_starts(directory).select("base", "before")
    return back.join(starts, "base").select("key", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def route(keys: DataFrame, directory: DataFrame, key: str = "key") -> DataFrame:
    """Adds to each key the shards that would hold it: key, key_hash, base; a row for each shard of a key that spans several.

    Keys and the first keys of shards are sorted together, and each key takes the last shard that begins at or before it:
    a search in sorted bounds, spread over tasks.  A key at which that shard begins may be in the shards before it that
    end with it, too.  Keys before all shards have no row.  A null key is a key like any other.
    """
    shards = staged(shard_starts(directory), "shards")
    ends = shards.groupBy("last_key").agg(F.min("number").alias("_least"))
    back = shards.join(ends.withColumnRenamed("last_key", "_end"), F.col("first_key").eqNullSafe(F.col("_end")), "left")
    none = F.lit(None).cast("long")
    bounds = back.select(F.col("first_key").alias("key"), F.lit(0).alias("kind"), "number", F.struct("number", F.col("first_key").alias("k"), F.least("number", F.coalesce("_least", "number")).alias("least")).alias("s"))
    asked = keys.select(F.col(key).alias("key")).withColumns({"kind": F.lit(1), "number": none, "s": F.lit(None).cast(bounds.schema["s"].dataType)})
    met = running(bounds.unionByName(asked), [], ["key", "kind", "number"], {"at": ("last", "s")}).where("kind = 1 and at is not null")
    least = F.when(F.col("at.k").eqNullSafe(F.col("key")), F.col("at.least")).otherwise(F.col("at.number"))
    spread = met.select("key", F.explode(F.sequence(least, F.col("at.number"))).alias("number"))
    routed = spread.join(shards.select("number", "base"), "number").select("key", F.xxhash64("key").alias("key_hash"), "base")
    return routed.repartitionByRange("base").sortWithinPartitions("base", "key_hash")
