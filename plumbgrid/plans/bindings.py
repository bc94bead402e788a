"""The driver's tables as operator inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud from lineitem; the extended key, compared column by column, is the point's identity."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.struct(*KEY).alias("point_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100 + 0.0).alias("z"))


def flat(df: DataFrame) -> DataFrame:
    """``point_id`` back to its columns."""
    return df.select("point_id.*", *[c for c in df.columns if c != "point_id"])


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cloud with normals from the first six dimensions of the embeddings."""
    d = table(spark, sf_dir, "embeddings")
    return d.select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo records from events: sequence by time, user as camera, value as sharpness."""
    d = table(spark, sf_dir, "events")
    return d.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("camera"), F.col("event_type").alias("kind"), F.col("value").alias("sharpness"),
        F.format_string("frame_%d", "event_id").alias("name"), F.pmod("event_id", F.lit(4096)).cast("long").alias("signature"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as views of parts."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.format_string("S%04d", "l_suppkey").alias("name"), F.col("l_partkey").alias("point_id")).distinct()


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier")
    return d.select(F.col("s_suppkey").alias("pos"), F.format_string("S%04d", "s_suppkey").alias("name"))
