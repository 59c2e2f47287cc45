"""Helpers that the operators share: the shared folder, Arrow slices and byte-level text scans."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python task holds at a time; a longer text is a step of its own.
SLICE_BYTES = 2 << 20
#: Rows of one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000
#: Rows of a few numbers that ``packed`` puts into one file.
FILE_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process (local master,
    as in tests) may leave it unset and gets a folder of the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def packed(df: DataFrame, name: str, rows: int = FILE_ROWS) -> DataFrame:
    """``stored`` in as few files as ``rows`` rows each need, however many tasks made them.

    All tasks leave their rows on the executors' disks first, where a few others collect them: neither the tasks
    that compute nor a shuffle's partitions set the number of files.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return stored(held.coalesce(max(1, -(-held.count() // rows))), name)
    finally:
        held.unpersist()


def drop_stored(df: DataFrame) -> None:
    """Deletes a table of ``stored`` that no later step reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_slices(df: DataFrame, column: str, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` whose step sees slices of bounded text size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame, by: list[str], how: str = "left_semi") -> DataFrame:
    """``left`` joined with ``right`` (a row per key) on ``keys``, where a key may hold any share of ``left``.

    ``sizes`` (keys, rows) is a stored table with the rows that ``left`` has of each key. A key with more than a
    quarter of a mean task's rows is dealt over several tasks by a hash of the columns ``by``, and its row of
    ``right`` goes to each of them. At most four keys for each shuffle partition are that large, whatever the
    input, so they are broadcast. Nulls join nothing.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    share = max(1.0, total / (4 * n))
    hot = F.broadcast(sizes.filter(F.col("rows") > share).select(*keys, F.ceil(F.col("rows") / F.lit(share)).cast("int").alias("_parts")))
    many = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), many).cast("int")).drop("_parts")
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


def text_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under the names doc_id and text; a null text becomes empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, straight from the Arrow buffers."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240501))
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["up"]) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(max(n, SLICE_BYTES // 4), base, np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any ranges of one array of bytes (or of 64-bit codes): polynomial prefix sums modulo 2**64.

    Strings made for it can collide from about a thousand bytes on: equal hashes of long ranges are candidates,
    to be confirmed on the bytes.
    """

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        codes = BYTE_CODES[data] if data.dtype == np.uint8 else data
        np.cumsum(codes * up[: len(data)], out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of ``inside`` bytes; runs never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:n] = inside
    start = np.nonzero(here & (~before | edge))[0]
    end = np.nonzero(before & (~here | edge))[0]
    return start, end, np.searchsorted(offsets, start, "right") - 1
