"""XML collections of tracks: scan with its filters and location decoding, sink, and validation of markers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "array<struct<_Name:string,_Type:string,_Start:double,_End:double,_Num:int>>"
SCHEMA = f"_TrackID string, _Name string, _Artist string, _TotalTime double, _AverageBpm double, _Tonality string, _Location string, _Size long, POSITION_MARK {MARK}"


def scan(spark: SparkSession, path: str, least_seconds: float = 30.0) -> DataFrame:
    """Rows of the TRACK elements of at least least_seconds, with decoded locations and their position marks."""
    raw = spark.read.format("xml").option("rowTag", "TRACK").option("nullValue", "").schema(SCHEMA).load(path)
    where = F.regexp_replace(F.try_url_decode(F.regexp_replace("_Location", r"\+", "%2B")), "^file://(localhost)?", "")
    return raw.where(F.col("_TotalTime") >= least_seconds).select(
        F.col("_TrackID").alias("ref"), F.coalesce("_Artist", F.lit("")).alias("artist"), F.coalesce("_Name", F.lit("")).alias("title"), F.col("_TotalTime").alias("total_time"), F.col("_AverageBpm").alias("bpm"),
        F.col("_Tonality").alias("key"), where.alias("location"), F.col("_Size").alias("size_bytes"), F.col("POSITION_MARK").alias("marks"),
    )


def write(tracks: DataFrame, folder: str) -> str:
    """(id, artist, title, seconds) columns, in this order, as TRACK elements; returns the path."""
    path = f"{folder}/{uuid.uuid4().hex}"
    a, b, c, d = tracks.columns
    rows = tracks.select(F.col(a).alias("_TrackID"), F.col(c).alias("_Name"), F.col(b).alias("_Artist"), F.col(d).alias("_TotalTime"))
    rows.write.format("xml").option("rootTag", "COLLECTION").option("rowTag", "TRACK").save(path)
    return path


def mark_kinds(tracks: DataFrame) -> DataFrame:
    """Rows (ref, hot, memory, loops, bad): markers of each track by kind; a marker before 0 or a slot above 7 is bad."""
    m = tracks.select("ref", F.explode_outer("marks").alias("m"))
    num, start, end = F.col("m._Num"), F.col("m._Start"), F.col("m._End")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return m.groupBy("ref").agg(count(num.between(0, 7)).alias("hot"), count(num == -1).alias("memory"), count(end > start).alias("loops"), count((start < 0) | (num > 7) | (num < -1)).alias("bad"))
