"""Tables as text cells: a tolerant scan with types and defaults, and a sanitised sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklattice.functions.text import sanitised_cell

_DEFAULTS = {"double": 0.0, "float": 0.0, "int": 0, "bigint": 0, "boolean": False, "string": ""}


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header read as text and cast; cells that do not parse, and columns that are missing, get the type's default."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        if f.name not in raw.columns:
            out.append(F.lit(_DEFAULTS.get(kind)).cast(kind).alias(f.name))
            continue
        cell = F.when(F.col(f.name).startswith("'") & F.col(f.name).rlike("^'[=+@\\t\\r-]"), F.substring(f.name, 2, 1_000_000)).otherwise(F.col(f.name))
        value = cell if kind == "string" else cell.try_cast(kind)
        out.append(F.coalesce(value, F.lit(_DEFAULTS.get(kind)).cast(kind)).alias(f.name))
    return raw.select(*out)


def write(df: DataFrame, folder: str) -> str:
    """df as CSV with a header in a new folder under folder, cells sanitised; returns the path."""
    path = f"{folder}/{uuid.uuid4().hex}"
    cells = [sanitised_cell(F.col(c).cast("string")).alias(c) for c in df.columns]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)
    return path
