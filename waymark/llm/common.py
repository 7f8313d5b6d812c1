"""What the operators share: staged tables, byte views of Arrow columns, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import prepare

#: Bytes of text that one vectorised step handles; bounds the memory of a Python worker.
STEP_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can read: ``spark.checkpoint.dir``.

    Only where it is unset (a local session) a temporary folder is made, once per session.
    """
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("waymark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("waymark.checkpoint.dir", own)
    return own


class Staged:
    """Parquet tables of one operator call in the shared folder: they cut the lineage and
    outlive a lost executor. ``drop`` deletes what is no longer needed; what lazy results may still read
    goes when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.base = f"{shared_dir(spark).rstrip('/')}/waymark-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.drop("")
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table dealt by ``key`` once, one file a bucket, so that later joins on it move only their other side.

        Its entry in the catalog goes with its files when the driver's Python ends."""
        table, n = f"{name}_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables.append(table)
        df.repartition(n, key).write.format("parquet").option("compression", "uncompressed").option("path", f"{self.base}/{name}").bucketBy(n, key).sortBy(key).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def release() -> None:
    """Gives what Arrow and the allocator hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settled(scan):
    """``scan`` for ``mapInArrow``; when it ends, what it freed goes back to the system.

    Python workers outlive their tasks and share an executor's memory with what runs next."""

    def run(batches):
        yield from scan(batches)
        release()

    return run


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a detour through Python strings."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def kept_rows(docs: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows of ``docs`` for which ``judge`` (texts to booleans) holds, all columns as they were.

    Each row is judged where it lies and by its own text alone, so neither null nor repeated ids matter and no row moves."""
    at = docs.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            own = batch.column(at)
            own = own if pa.types.is_string(own.type) or pa.types.is_large_string(own.type) else own.cast(pa.string())
            yield batch.filter(pa.array(np.asarray(judge(texts(own)), bool)))

    return docs.mapInArrow(settled(scan), docs.schema)


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` whose next join is a sort-merge join, so that neither side is gathered in the driver and broadcast.

    Spark takes a table for as large as its compressed files, and for no larger after ``explode``: what it takes for
    10 MB can be gigabytes. Needed for joins of tables that grow with the input."""
    return rows.hint("merge")


def salted_join(rows: DataFrame, found: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row a key; a key's rows are dealt to ``salts`` shares by
    ``by``, and each share gets its copy of the found row, so that a key of very many rows does not end in one task. Rows are never broadcast, few though their bytes on disk may be."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    told = dealt.select(key, "__salt").distinct().join(found, key)
    return apart(dealt).join(told, [key, "__salt"]).drop("__salt")


def steps(values: list[bytes | None], size: int = STEP_BYTES):
    """(from, to) of consecutive rows of about ``size`` bytes; a longer text is a step alone."""
    begin = total = 0
    for i, value in enumerate(values):
        n = len(value) if value else 0
        if i > begin and total + n > size:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(values):
        yield begin, len(values)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLAT = _TABLE.reshape(-1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (two multiply-xorshift rounds)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_runs(buf: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of ``buf`` that are no space."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hashes of words: a random number for each (place, byte), summed.

    Words are taken in groups of about ``STEP_BYTES / 4`` bytes, so a long text needs no more memory than a short one.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    total = np.cumsum(lengths)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(STEP_BYTES // 4, int(total[-1]), STEP_BYTES // 4)), [len(starts)]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = lengths[a:b]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), n)
        part = _FLAT[((place & 63) << 8) | buf[place + np.repeat(starts[a:b], n)]]
        if n.max() > 64:
            part = part * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        out[a:b] = np.add.reduceat(part, first)
    return mix(out)


def joined(values: list[bytes | None], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a step as one buffer, a line break after each, and their end offsets."""
    rows = [v or b"" for v in values[begin:end]]
    buf = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    return buf, np.cumsum(np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows)))
