"""Sources and sinks: fact tables, derived tables, images and vectors."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_fact_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header and an explicit schema; measures are best read as strings and coerced."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """Text to double; what isn't a number becomes null."""
    return df.withColumn(column, F.expr(f"try_cast(`{column}` as double)"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name where driver and executors share it, in the folder set as spark.checkpoint.dir; only a local session may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
    # With its scheme: tasks that write files themselves would take a bare path for one of their own machine.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read again, so that all plans over it see the same rows: sums of doubles depend on the order in which tasks end."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order, name: str = "__part") -> DataFrame:
    """``df`` dealt out by ranges of ``order``, with the number of a row's range in column ``name``, rising along the order.

    The table is written to the shared folder with that number and read again: ranges are cut at sampled bounds, so two plans over one range exchange, or a stage that runs
    again, need not agree on them, and numbers may be joined only if they are kept.
    """
    return kept(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranged")


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A PNG file of 8-bit RGB values, row by row, without compression."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgb[i : i + 3 * width] for i in range(0, len(rgb), 3 * width))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 0)) + chunk(b"IEND", b"")


def write_images(df: DataFrame, path: str) -> DataFrame:
    """Write a PNG file for every row of ``df`` (label, name, width, height, rgb) to a folder a label in the shared folder ``path``; returns (label, name, path).

    A task that is repeated writes the same files again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri("s3:" + path[4:] if path.startswith(("s3a:", "s3n:")) else path if ":/" in path else f"file://{path}")
        made: set = set()
        for frame in batches:
            out = []
            for label, name, width, height, rgb in frame[["label", "name", "width", "height", "rgb"]].itertuples(index=False):
                if label not in made:
                    system.create_dir(f"{root}/{label}", recursive=True)
                    made.add(label)
                with system.open_output_stream(f"{root}/{label}/{name}.png", compression=None) as sink:
                    sink.write(png(width, height, np.asarray(rgb, np.uint8).tobytes()))
                out.append((label, name, f"{path}/{label}/{name}.png"))
            yield pd.DataFrame(out, columns=["label", "name", "path"])

    manifest = df.select(F.col("label").cast("string").alias("label"), F.col("name").cast("string").alias("name"), "width", "height", "rgb").mapInPandas(write, "label string, name string, path string")
    manifest.write.parquet(f"{path}-manifest")
    return df.sparkSession.read.parquet(f"{path}-manifest")


def image_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(label, n_images, avg_kb): files by the folder that names their class; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path)
    label = F.element_at(F.split("path", "/"), -2)
    return files.select(label.alias("label"), "length").groupBy("label").agg(F.count(F.lit(1)).alias("n_images"), (F.avg("length") / 1024).alias("avg_kb"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, height, width, channels, bgr) of a folder of one folder a class; the source keeps pixels as BGR."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path)
    return images.select(
        F.col("image.origin").alias("path"), F.element_at(F.split("image.origin", "/"), -2).alias("label"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"),
    )


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors with a column split, one folder a split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_vectors(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a fact table of year, month, country, region, route, kind and measure."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .select(
            F.col("o_orderkey").alias("order_key"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("ds"), F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("route"),
            F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("measure"),
        )
    )
