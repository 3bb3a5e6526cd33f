import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources.folder import register


@pytest.fixture
def root(tmp_path):
    for path, text in {
        "b.txt": "eins\fzwei", "a.MD": "# Kopf", "c.ipynb": json.dumps({"cells": [{"source": ["x = 1\n", "y"]}, {"source": "text"}]}), "bad.ipynb": "{", "x.pdf": "%PDF", "~lock.txt": "-", ".DS_Store": "-",
        "sub/d.txt": "drei", "sub/deep/e.txt": "vier", "sub/deep/er/f.txt": "fünf", ".git/g.txt": "-",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    return str(tmp_path)


def load(spark, root, **options):
    return register(spark).read.format("document_folder").options(path=root, **options).load()


def test_one_folder(spark, root):
    rows = load(spark, root, taskBytes="8").collect()
    got = sorted((r.path, r.page, r.text, r.error) for r in rows if r.error is None)
    assert got == [("a.MD", 0, "# Kopf", None), ("b.txt", 0, "eins", None), ("b.txt", 1, "zwei", None), ("c.ipynb", 0, "x = 1\ny", None), ("c.ipynb", 1, "text", None)]
    assert {r.path: r.error for r in rows if r.error} == {"bad.ipynb": "JSONDecodeError", "x.pdf": "kein_extraktor"}
    assert not any(r.truncated for r in rows) and {r.ext for r in rows} == {".md", ".txt", ".ipynb", ".pdf"}
    assert load(spark, root, taskBytes="8").rdd.getNumPartitions() > 2


def test_all_folders_within_bounds(spark, root):
    names = lambda **o: sorted(r.path for r in load(spark, root, recursive="true", extensions=".txt", listOnly="true", **o).collect())
    cut = lambda **o: {r.truncated for r in load(spark, root, recursive="true", extensions=".txt", listOnly="true", **o).collect()}
    assert names() == ["b.txt", "sub/d.txt", "sub/deep/e.txt", "sub/deep/er/f.txt"] and cut() == {False}
    assert names(maxDepth="2") == ["b.txt", "sub/d.txt"] and cut(maxDepth="2") == {True}
    assert names(maxFiles="3") == ["b.txt", "sub/d.txt", "sub/deep/e.txt"] and cut(maxFiles="3") == {True}
    assert cut(maxFiles="4", maxDepth="4") == {False}
    assert {r.path: r.depth for r in load(spark, root, recursive="true", extensions=".txt").collect()}["sub/deep/e.txt"] == 3


def test_an_empty_folder(spark, tmp_path):
    assert load(spark, str(tmp_path)).count() == 0


def files(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith(".")) if os.path.isdir(folder) else []


def test_log_is_there_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "log")
    rows = spark.range(40, numPartitions=4).select("id", F.concat(F.lit('a;"b"'), F.col("id")).alias("ziel"))
    register(spark)
    rows.write.format("log_folder").option("path", out).mode("append").save()
    back = spark.read.csv(out, sep=";", header=True, quote='"', escape='"')
    assert sorted(int(r[0]) for r in back.collect()) == list(range(40)) and {r.ziel for r in back.collect()} == {f'a;"b"{k}' for k in range(40)}
    assert open(f"{out}/{files(out)[0]}", "rb").read(3) == b"\xef\xbb\xbf"
    before = files(out)
    broken = rows.select("id", F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise("x").alias("ziel"))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("log_folder").option("path", out).mode("append").save()
    assert files(out) == before
    rows.where("id < 5").write.format("log_folder").option("path", out).mode("overwrite").save()
    assert sorted(int(r[0]) for r in spark.read.csv(out, sep=";", header=True).collect()) == list(range(5))
