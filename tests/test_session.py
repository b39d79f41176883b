"""The folder of intermediate tables, without the settings of this machine."""

import os
import subprocess
import sys
import time

import pytest

SCRIPT = """
import os, sys
from pyspark.sql import SparkSession
from tracklattice.session import discard, materialise, shared_dir
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
own = shared_dir(spark).removeprefix("file://")
kept = materialise(spark.range(5), "t")
assert kept.count() == 5 and os.path.isdir(own)
discard(spark)
assert not os.path.isdir(own)
assert materialise(spark.range(3), "t").count() == 3
print("FOLDER", shared_dir(spark).removeprefix("file://"))
"""


def run(tmp_path, master):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    return subprocess.run([sys.executable, "-c", SCRIPT, master], env=env, capture_output=True, text=True, timeout=120)


def test_works_without_the_setting_and_cleans_up(tmp_path):
    got = run(tmp_path, "local[1]")
    assert got.returncode == 0, got.stderr[-800:]
    own = got.stdout.split("FOLDER ")[1].strip()
    for _ in range(50):  # the JVM ends a little after Python
        if not os.path.isdir(own):
            return
        time.sleep(0.2)
    raise AssertionError(own)


@pytest.mark.skipif("SPARK_HOME" in os.environ and not os.path.isdir(os.environ["SPARK_HOME"]), reason="no Spark home")
def test_a_cluster_without_the_setting_is_an_error(tmp_path):
    got = run(tmp_path, "local-cluster[1,1,1024]")
    assert got.returncode != 0 and "spark.checkpoint.dir" in got.stderr
