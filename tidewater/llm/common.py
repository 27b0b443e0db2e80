"""What the operators of this subpackage share: the scratch folder and Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Masters whose executors are the driver's own process.
ONE_PROCESS = re.compile(r"local(\[|$)")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; whatever else the table holds is never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies in the folder that spark.checkpoint.dir names. Where that is unset and Spark runs
    in one process, as in tests, a temporary folder is set for the session; on a cluster it's
    an error. The folder goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not ONE_PROCESS.match(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidewater-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder; a session that has ended leaves it to its cluster."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and a lost
    executor takes nothing with it."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch: texts can be long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_tidewater_shipped", False) or not root.is_dir():
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidewater-")), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._tidewater_shipped = True


#: What small_batches() sets, where a session has none or a greater number: rows and bytes of
#: an Arrow batch, rows that the Parquet reader decodes at a time, bytes of a written row group.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
    "spark.sql.parquet.columnarReaderBatchSize": 512, "parquet.block.size": 32 << 20,
}


def small_batches(df: DataFrame) -> DataFrame:
    """Prepares a session for Python on executors: they get this package, small batches, and
    small buffers of the Parquet reader and writer, which would otherwise hold a row group of
    whole texts for each task.

    Plans read these settings when they run, which may be long after they are made, so they
    stay set for the session. Each is judged by itself, whatever was called before.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for key, most in SETTINGS.items():
        held = conf.get(key, None)
        if not held or not held.isdigit() or not 0 < int(held) <= most:
            conf.set(key, str(most))
    return df


def give_back() -> None:
    """Returns freed memory to the system: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in small batches."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return small_batches(df).mapInArrow(task, schema)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Maps each Arrow batch to a dict of columns; make() builds the function once a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                yield record_batch(fn(batch), schema)

    return map_batches(df, run, schema)


_SCHEMAS: dict[str, pa.Schema] = {}


def arrow_schema(ddl: str) -> pa.Schema:
    if ddl not in _SCHEMAS:
        _SCHEMAS[ddl] = to_arrow_schema(parse_ddl(ddl))
    return _SCHEMAS[ddl]


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "boolean": T.BooleanType(), "array<long>": T.ArrayType(T.LongType()),
    "array<int>": T.ArrayType(T.IntegerType()), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType()),
    "array<string>": T.ArrayType(T.StringType()), "array<boolean>": T.ArrayType(T.BooleanType()),
}


def parse_ddl(ddl: str) -> T.StructType:
    """A DDL string of plain types, read without a session, so that workers can too."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (f.strip().split(" ", 1) for f in ddl.split(","))])


def record_batch(columns: dict, ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((columns[f.name], f) for f in schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
