"""Shared helpers: stable input columns, the shared scratch folder, Arrow row loops."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables; any path that Spark itself can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    A folder of our own is set only where the session names none and runs on one machine; elsewhere that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def row_struct(df: DataFrame) -> Column:
    """A whole row as one struct column `row`, so that no column of the caller's can clash with ours."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def with_row(schema: str, rows: DataFrame) -> StructType:
    """The schema of some results, and of the struct `row` if rows have it."""
    found = StructType.fromDDL(schema)
    return found.add("row", rows.schema["row"].dataType) if "row" in rows.columns else found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage, and outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def fold(id_column: str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = 512) -> DataFrame:
    """Apply fn to slices of at most `rows` rows, inside the tasks that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # functions of earlier tasks hold what they closed over in reference cycles
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)
