"""Session helpers shared by every module: tables, lineage cuts, sizes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.java_gateway import JavaObject, JVMView
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tracklattice", cores: str = "8") -> SparkSession:
    """A local session with the settings the engine expects; on a cluster use its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables; a file and a folder of files read alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: one of this application inside spark.checkpoint.dir, removed when the application ends.

    Where the setting is missing a temporary folder serves, but in local mode only (tests): executors of a cluster could not
    read it, so a cluster without the setting is an error that names it.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir is not set: name a folder there that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tracklattice-")
        _OWN[app] = f"{base.rstrip('/')}/tracklattice-{app}"
        atexit.register(_remove, context._jvm, context._jsc.hadoopConfiguration(), app)
    return _OWN[app]


def discard(spark: SparkSession) -> None:
    """Delete the tables written so far; results that still read them can no longer be computed."""
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext.applicationId)


def _remove(jvm: JVMView, conf: JavaObject, app: str) -> None:
    own = _OWN.pop(app, None)
    if own:
        try:
            path = jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(conf).delete(path, True)
        except (Py4JError, OSError):  # the JVM has gone already
            pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as parquet and read it back: lineage ends there and any executor can be lost.

    The table survives executor loss because it lies in the folder that the whole cluster shares; the schema is the one written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def env_path(name: str, default: str) -> str:
    """A path parameter that the environment may override."""
    return os.environ.get(name, default)
