"""Helpers shared by the corpus operators.

Row conventions used by every operator of this subpackage:

* a null text counts as the empty text unless the operator says otherwise;
* result columns of an operator win over input columns of the same name, which
  are then not carried through;
* nothing here writes to a machine-local folder when the session names a shared
  one in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Increment and multipliers of the public splitmix64 generator.
GOLDEN, MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

_scratch: dict[str, str] = {}
_recorders: list[list[Stored]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="roadsift-")
        _scratch[app] = f"{base.rstrip('/')}/roadsift-{app}"
        atexit.register(_forget, spark, _scratch[app])
    return _scratch[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the JVM is already gone: the folder's owner cleans up
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stored:
    """A table written to the shared folder: lineage ends here and a lost executor costs nothing."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        with _own_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        for tables in _recorders:
            tables.append(self)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block, what a query has shuffled goes when the query ends, not only when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def recorded() -> Iterator[list[Stored]]:
    """Lists the tables that are stored inside the block, so that they can be dropped when what was made of them is written."""
    tables: list[Stored] = []
    _recorders.append(tables)
    try:
        yield tables
    finally:
        _recorders.remove(tables)


def store(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def grows(df: DataFrame) -> DataFrame:
    """Marks the side of a join whose size grows with the corpus: both sides are exchanged, at every size, and it is never broadcast."""
    return df.hint("merge")


def utf8(text: str | Column) -> Column:
    """Whole text as UTF-8 bytes, null as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")).cast("binary")


def others(df: DataFrame, reserved: Iterable[str]) -> list[str]:
    """Columns that are carried through: all whose names an operator does not claim for its result."""
    taken = {c.lower() for c in reserved}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterable[pa.RecordBatch], column: str, most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds few rows and few bytes of ``column`` (a single row may be larger)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        done = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = int(done[start - 1]) if start else 0
            stop = int(np.searchsorted(done, base + most_bytes, "right"))
            stop = min(max(stop, start + 1), start + most_rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


#: Look-up tables of this worker process: how to empty each, and which one is in use.
_tables: dict[str, Callable[[], None]] = {}
_in_use = [""]


def claim(table: str) -> None:
    """A worker that goes over to another operator frees the look-up tables of the one before."""
    if _in_use[0] != table:
        for name, empty in _tables.items():
            if name != table:
                empty()
        _in_use[0] = table


def register(table: str, empty: Callable[[], None]) -> None:
    _tables[table] = empty


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64 and of its inverse."""
    if len(_powers[0]) < n:
        room = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(MIX_A), pow(int(MIX_A), -1, 1 << 64))):
            steps = np.full(room, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of ``values`` (64-bit numbers): a polynomial whose prefix sums are taken once, then mixed."""
    up, down = _powers_to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end) of ``data``."""
    return run_hashes(_BYTES[data], starts, ends)


def hash_words(words: list[bytes], part: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of words, about ``part`` bytes at a time."""
    claim("words")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    data = np.frombuffer(b"".join(words), np.uint8)
    out, at = np.empty(len(words), np.uint64), 0
    while at < len(words):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + part, "right")))
        local = ends[at:stop] - base
        out[at:stop] = hash_bytes(data[base : base + int(local[-1])], np.concatenate([[0], local[:-1]]), local)
        at = stop
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by the position of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out = out * GOLDEN + words[k : k + n]
    return mix64(out)


def ids_field(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
