import os
import subprocess
import sys
import threading
from pathlib import Path

from tallyloom.store import keep, scratch, store

ROOT = Path(__file__).resolve().parents[1]


def test_a_plain_session_stores(tmp_path):
    """Without any defaults file, as in the README."""
    code = """
from pyspark.sql import SparkSession
import tallyloom.plans
from tallyloom import catalog
from tallyloom.store import shared_folder, store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark.newSession())
assert store(spark.range(5), "five").df.count() == 5
assert catalog.QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001").count() == 15
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_scratch_belongs_to_its_thread(spark):
    kept = []

    def other():
        kept.append(store(spark.range(3), "other"))

    with scratch():
        mine = store(spark.range(4), "mine")
        t = threading.Thread(target=other)
        t.start()
        t.join()
        with scratch():
            inner = keep(store(spark.range(2), "inner"))
        assert inner.df.count() == 2
    assert kept[0].df.count() == 3
    gone = [not Path(x.path.removeprefix("file://")).exists() for x in (mine, inner)]
    assert gone == [True, True]
