"""Scans: tables with explicit schemas, one-document-per-file folders, saved pages, word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """No type inference: the literal n/a stays a text."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON array, or no rows where the file is missing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_folder(spark: SparkSession, folder: str, schema: StructType | str, key: str) -> DataFrame:
    """One document per file; of several with one key the last by file name stays."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("_file", F.col("_metadata.file_path")).where(F.col(key).isNotNull())
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col("_file").desc()))).where("_r = 1").drop("_r", "_file")


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of saved pages; bytes that are no UTF-8 become replacement characters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(folder).select("path", F.expr("make_valid_utf8(cast(content as string))").alias("html"))


def vectors_with_manifest(vectors: DataFrame, manifest: DataFrame, row: str = "row") -> DataFrame:
    """Vectors by row number with the manifest's columns; a row of one without the other is an error."""
    odd = vectors.select(row).join(manifest.select(row), row, "left_anti").unionByName(manifest.select(row).join(vectors.select(row), row, "left_anti")).limit(1)
    if not odd.isEmpty():
        raise ValueError("the manifest and the vectors have different rows")
    return vectors.join(manifest, row)
