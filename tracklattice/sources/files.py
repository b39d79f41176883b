"""Directory scans with content hashes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions.text import file_stem, tokens


#: paths in one read of contents
PATHS = 10_000


def scan(spark: SparkSession, root: str, extensions: list[str], excluded: str = "outputs", known: DataFrame | None = None) -> DataFrame:
    """Files under root of the extensions, outside folders called `excluded`, with size, time and SHA-256.

    The listing reads no contents. Those are read only for files whose (path, size, time) is not among the known rows, whose hash is taken over; fresh
    paths are loaded PATHS at a time (the driver lists the files of any scan).
    """
    pattern = "*.{" + ",".join(sorted({v for e in extensions for v in (e.lower(), e.upper())})) + "}"
    source = spark.read.format("binaryFile")
    named = lambda df: df.withColumnRenamed("length", "size_bytes").withColumnRenamed("modificationTime", "mtime")
    raw = named(source.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)).where(~F.col("path").rlike(f"/{excluded}/"))
    keys = ["path", "size_bytes", "mtime"]
    if known is None:
        return raw.select(*keys, F.sha2("content", 256).alias("sha256"))
    listing = raw.select(*keys)
    out = listing.join(known.select(*keys, "sha256"), keys)
    fresh = [r["path"] for r in listing.join(known.select(*keys), keys, "left_anti").select("path").toLocalIterator()]
    for i in range(0, len(fresh), PATHS):
        literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in fresh[i : i + PATHS]]
        out = out.unionByName(named(spark.read.format("binaryFile").load(literal)).select(*keys, F.sha2("content", 256).alias("sha256")))
    return out


def library_entries(files: DataFrame, path: str = "path") -> DataFrame:
    """Words of each file name, and of its part after the first dash."""
    stem = file_stem(F.col(path))
    title = F.regexp_replace(stem, r"^.*?\s-\s", "")
    return files.withColumns({"all_tokens": tokens(stem), "title_tokens": tokens(title)})
