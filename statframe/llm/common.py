"""Small helpers of the corpus operators: shared tables, column handling, the workers' code."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

import statframe

__all__ = ["ship", "shared_folder", "keep", "free", "schema_with", "slices", "per_batch", "read"]


#: Rows that Python functions get at once, at most: texts are long, and Arrow holds a batch several times.
ARROW_ROWS = 4096


def ship(spark: SparkSession) -> None:
    """``statframe.ship``, and a smaller Arrow batch for the session unless it has one already."""
    statframe.ship(spark)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach (``spark.checkpoint.dir``); a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"file://{tempfile.mkdtemp(prefix='statframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage at files that outlive any executor.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more, and let Spark drop the shuffle files of plans that are garbage."""
    for table in tables:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def schema_with(df: DataFrame, **new: T.DataType | str) -> T.StructType:
    """``df``'s columns, then ``new`` ones; a column of ``df`` with the name of a new one gives way to it."""
    taken = {c.lower() for c in new}
    fields = [f for f in df.schema.fields if f.name.lower() not in taken]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]
                        + [T.StructField(c, T._parse_datatype_string(t) if isinstance(t, str) else t, True) for c, t in new.items()])


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: what a function makes of one bounds its memory."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


#: Rows handed to a function of ``per_batch`` at once.
ROWS = 1024


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], **new: T.DataType | str) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each Arrow batch; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema_with(df, **new)
    arrow = to_arrow_schema(schema)
    old = [f.name for f in schema.fields[: len(schema.fields) - len(new)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            made = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [_as(batch.column(batch.schema.get_field_index(c)), arrow.field(c).type) for c in old]
                + [_as(made[c], arrow.field(c).type) for c in new], schema=arrow)

    return df.mapInArrow(run, schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
