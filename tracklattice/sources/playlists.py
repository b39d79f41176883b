"""Playlists: CSV exports read into typed rows, and extended M3U files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of playlist exports with names: milliseconds become seconds, artists and genres arrays; the file name is the playlist."""
    raw = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    cols = {c.replace("﻿", "").strip(): c for c in raw.columns}
    cell = lambda name: F.col(f"`{cols[name]}`") if name in cols else F.lit(None).cast("string")
    parts = lambda c, sep: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")
    return raw.where(F.trim(cell("Track Name")) != "").select(
        cell("Track URI").alias("uri"), F.trim(cell("Track Name")).alias("name"), parts(cell("Artist Name(s)"), ";").alias("artists"), (cell("Duration (ms)").try_cast("double") / 1000).alias("duration_sec"),
        cell("Album Name").alias("album"), F.substring(cell("Release Date"), 1, 4).alias("year"), parts(cell("Genres"), ",").alias("genres"), cell("Record Label").alias("label"), cell("Added At").alias("added_at"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("playlist"),
    )


def m3u_lines(rows: DataFrame, playlist: str, order: str, seconds: Column, title: Column, path: Column) -> DataFrame:
    """Rows (playlist, place, line): the entries of an extended M3U file for each playlist, numbered from 1 in the given order.

    Entries without a path or title are left out. A playlist of any length stays rows; write puts them in files.
    """
    line = F.concat(F.lit("#EXTINF:"), seconds.cast("long").cast("string"), F.lit(","), title, F.lit("\n"), path)
    w = Window.partitionBy(playlist).orderBy(order)
    return rows.select(playlist, order, line.alias("line")).where("line is not null").select(playlist, F.row_number().over(w).alias("place"), "line")


def write(lines: DataFrame, playlist: str, folder: str) -> None:
    """Lines of m3u_lines as text files below folder, one folder a playlist, each file begun with the format's first line."""
    head = lines.select(playlist).distinct().select(playlist, F.lit(0).alias("place"), F.lit("#EXTM3U").alias("line"))
    every = lines.unionByName(head).repartition(playlist).sortWithinPartitions(playlist, "place")
    every.select(playlist, "line").write.partitionBy(playlist).mode("overwrite").text(folder)
