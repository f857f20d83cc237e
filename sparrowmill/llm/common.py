"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import shared_dir

#: The separators of the word rules: space and the control characters 9 to 13.
SPACES = r"\x20\x09-\x0D"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, each the first whose name matches to the letter.

    Columns are addressed by position, so extra columns may carry any name: one that an
    operator returns, one that differs only in case, or the same name twice.
    """
    have = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"_c{have.index(n)}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Write `df` under the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete what `stash` wrote for these frames; nothing that is still to run may read them."""
    for path in {getattr(df, "_stash", None) for df in frames if df is not None} - {None}:
        delete(next(df for df in frames if df is not None).sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Ids up to this many (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def among(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key is (left_anti: isn't) among `ids`, distinct and written already."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


#: A key is hot if it holds over a thousandth of all rows, so at most a thousand keys are.
HOT = 1_000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """`rows` with the columns of `table`, which has one row for each key; `weight` counts the key's rows.

    Hot keys are joined where their rows are, by a broadcast of at most `HOT` rows of `table`, so no task gets all rows of one.
    """
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    limit = max(HOT, (total or 0) // HOT)
    if (most or 0) <= limit:
        return rows.join(table, key)
    hot = table.where(F.col(weight) > limit)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


_HELD: dict[Hashable, object] = {}
_OWNER: list[str] = [""]


def held(key: Hashable, make: Callable):
    """`make()`, kept in this process under `key` until a step of another operator begins."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def begin(owner: str) -> None:
    """A step of `owner` begins in this Python worker.

    Workers are used again by later stages; vocabularies and memories that another operator left would
    count against the executor all along, so they go and their pages go back to the system.
    """
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    _HELD.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch; it returns columns by name, in the order of `schema`."""
    owner = fn.__module__

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        for batch in batches:
            for piece in small(batch):
                yield pa.RecordBatch.from_pydict(fn(piece))

    return df.mapInArrow(run, schema)


def small(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that the memory of a step doesn't follow the batch size of the session."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, nulls as empty ones."""
    return ["" if t is None else t for t in column.to_pylist()]


class Recent(dict):
    """A dict that makes what it misses, of bounded size: when `limit` keys have come, what isn't asked for again goes.

    Keys of 64 characters or more are made each time.
    """

    def __init__(self, limit: int, make: Callable) -> None:
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) >= 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
