"""Helpers shared by the operators: shared scratch tables, whole-text access, rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd base of the polynomial hashes (fixed, so that hashes agree between tasks and runs).
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where nothing is set and the master is local (tests) a temporary folder is chosen.
    Spark removes the folder when the session's JVM ends.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return files.makeQualified(path).toString()


#: Folders made inside the open ``scratch`` blocks of this driver.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` writes inside the block goes when the block ends, but for tables stored with ``keep``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for name in _SCRATCH.pop():
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread: cuts lineage, survives lost executors.

    Inside a ``scratch`` block the table goes with the block; with ``keep`` it belongs to the block around that one.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(folder)
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share_of(df: DataFrame, wanted: int, hashed: Column) -> Column:
    """A condition that about ``wanted`` rows meet: their hash lies in the lowest part.  Nothing is sorted or collected."""
    return hashed.cast("double") / F.lit(2.0**64) + 0.5 < F.lit(wanted / max(1, df.count()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_schema(text: str):
    return pa.schema([(n, _ARROW[t]) for n, t in (part.strip().rsplit(" ", 1) for part in text.split(","))])


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()),
}


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[list]], schema: str, rows: int = 100_000) -> DataFrame:
    """``mapInArrow`` whose ``work`` yields output rows column by column.

    ``work(batch)`` yields lists of columns (Python lists, numpy or Arrow arrays in the order of ``schema``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fixed_schema(schema)
        for batch in batches:
            for columns in work(batch):
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, out)]
                made = pa.RecordBatch.from_arrays(arrays, schema=out)
                for start in range(0, made.num_rows, rows):
                    yield made.slice(start, rows)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches of a few megabytes, whatever their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """UTF-8 bytes of every text; a null is an empty text."""
    for value in batch.column(name).cast(pa.binary()):
        raw = value.as_py()
        yield raw if raw is not None else b""


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        for name, factor in (("_POWERS", BASE), ("_INVERSES", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _POWERS[:n], _INVERSES[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads all bits of a polynomial hash (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[s:e]`` (bytes) for many spans at once, equal for equal spans."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


#: Bytes of words: a-z and all other alphabets; with digits.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True
LETTERS_AND_DIGITS = LETTERS.copy()
LETTERS_AND_DIGITS[48:58] = True


def word_hashes(text: str | None, member: np.ndarray) -> np.ndarray:
    """Signed hashes of the words of a text (case folded runs of UTF-8 bytes that are ``member``), in order."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    step = np.diff(inside)
    return span_hashes(data, np.flatnonzero(step == 1), np.flatnonzero(step == -1)).view(np.int64)


def seeded(column: Column, seed: int) -> Column:
    """An integer of 48 bits for a key, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), column.cast("string"))), 1, 12), 16, 10).cast("long")
