"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import shared_folder

#: Rows and bytes of one Arrow batch: a task holds one batch of texts at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stage's rows in the session's shared folder."""
    return f"{shared_folder(spark.sparkContext).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``stage_folder`` once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: What a Python worker keeps between tasks of one operator: a model or vocabulary by its key.
_kept: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]) -> object:
    """The value of ``make``, made once a worker; only the last key's is kept."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what the worker keeps."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def _forgetful(fn):
    """``fn`` after dropping what an operator before has kept, for workers serve one stage after another."""

    def task(batches):
        forget()
        yield from fn(batches)

    return task


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes; ``keeps``: the function uses ``once``.

    The bounds are session settings that Spark reads when the plan runs, so they stay set.
    """
    fn = fn if keeps else _forgetful(fn)
    # Python workers of this machine find the package where the driver found it; a cluster is given it by --py-files.
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def crc_mod(doc_id, n: int):
    """crc32 of the id's decimal text, modulo ``n`` (null ids: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def texts_of(column: pa.Array) -> list[str]:
    """The values of a column of strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def lists_of(column: pa.Array) -> Iterator[list[int]]:
    """The values of a column of lists of numbers, null as empty; only one row's are Python objects at a time."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return (flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False))


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns by exact name, whatever else the table holds (names that differ in case or hold dots too)."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def add_by_text(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], new: str, text: str = "text", keep: list[str] | None = None, keeps: bool = False) -> DataFrame:
    """``keep`` columns (default: all but none of ``new``) and the columns ``new`` (a DDL list) that ``make()`` computes from the texts.

    ``make`` runs once a task and returns a function from a batch of texts
    (null as empty) to one list or Arrow array for each new column. A kept
    column with the name of a new one is replaced by it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(new)
    keep = [c for c in (df.columns if keep is None else keep) if c not in made.names]
    names = [f"k{i}" for i in range(len(keep))]
    at = keep.index(text) if text in keep else len(keep)
    taken = pick(df, keep).toDF(*names) if text in keep else pick(df, [*keep, text]).toDF(*names, "t")
    out = StructType([taken.schema[f"k{i}"] for i in range(len(keep))] + list(made.fields))
    types = to_arrow_schema(made).types

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            columns = of(lists_of(b.column(at)) if pa.types.is_list(b.column(at).type) else texts_of(b.column(at)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=out.names)

    return map_batches(taken, fn, out, keeps).toDF(*keep, *made.names)
