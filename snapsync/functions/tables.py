"""Written intermediate tables, and order over a whole table without a single partition."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a session on one machine (tests) may go without one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Spark's setting by which a query's shuffle files go when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: later steps see these very rows, whatever executors are lost, so
    what was shuffled for them is removed at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, key: str, value: str, before: str, place: str) -> DataFrame:
    """df with the sum of value over all rows before (exclusive) and the place (from 1) in the order of key.

    The rows are dealt out by ranges of the key and written once, so that both passes see the same ranges. Each range
    is summed by itself; the sums of the ranges, one row for each, give its base.
    """
    ranged = written(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    bases = sums.select("__range", F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__base"), F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__first"))
    inner = Window.partitionBy("__range").orderBy(key)
    rows = ranged.join(F.broadcast(bases), "__range")
    rows = rows.withColumn(before, (F.col("__base") + F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
    return rows.withColumn(place, (F.col("__first") + F.row_number().over(inner)).cast("long")).drop("__range", "__base", "__first")


def folded(df: DataFrame, key: str, values: list[str], start, results: list[tuple[str, DataType]]) -> DataFrame:
    """key and results, one row for each key: its rows' values, in their own order, go to add() of a start() one by one.

    Only that object is held for a key, whatever the number of its rows; result() gives the results.
    """
    schema = StructType([df.schema[key], *(StructField(n, t) for n, t in results)])
    arrow, names = to_arrow_schema(schema), schema.names

    def run(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or k != at:
                    if state is not None:
                        done.append((at, *state.result()))
                    at, state = k, start()
                state.add(*row)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (at, *state.result())))], schema=arrow)

    rows = df.select(key, *values).repartition(key).sortWithinPartitions(key, *(F.col(v).asc_nulls_last() for v in values))
    return rows.mapInArrow(run, schema)
