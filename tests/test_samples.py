"""One file per sample: read back through the default glob; failed tasks and jobs leave nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files as IO
from tallyforge.sources.samples import read_sample_json, write_sample_json


def found(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b/../c", 0, 7), ("ü", None, 9)], "sample_id string, label int, file_size long").repartition(3)
    path = str(tmp_path / "out")
    write_sample_json(df, path)
    files = found(path)
    assert sorted(os.path.basename(f) for f in files) == ["%C3%BC_static.json", "a_static.json", "b%2F..%2Fc_static.json"]
    assert json.loads(open(next(f for f in files if f.endswith("/a_static.json"))).read()) == {"sample_id": "a", "label": 1, "file_size": None}
    back = IO.read_graph_json(spark, path).select("sample_id", "label", "file_size")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    write_sample_json(df.limit(0), path)
    write_sample_json(spark.createDataFrame([("later", 1)], "sample_id string, label int"), path)
    assert len(found(path)) == 4 and not [d for d in os.listdir(path) if d.startswith("_")]


def test_empty_table_makes_a_folder(spark, tmp_path):
    write_sample_json(spark.createDataFrame([], "sample_id string, label int"), str(tmp_path / "none"))
    assert os.path.isdir(tmp_path / "none") and found(tmp_path / "none") == []


@pytest.mark.parametrize("names", [["a", "a"], ["a", None]])
def test_names_are_checked_first(spark, tmp_path, names):
    df = spark.createDataFrame([(n, 1) for n in names], "sample_id string, label int")
    with pytest.raises(ValueError):
        write_sample_json(df, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).alias("label"))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="broken"):
        write_sample_json(df, path)
    assert found(path) == []


def test_compressed_samples(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5), ("b.json", 0, 7)], "sample_id string, label int, file_size long")
    path = str(tmp_path / "out")
    write_sample_json(df, path, suffix=IO.SAMPLE_SUFFIX + ".gz")
    assert all(open(f, "rb").read(2) == b"\x1f\x8b" for f in found(path))
    back = IO.read_graph_json(spark, path)
    assert sorted(map(tuple, back.select("sample_id", "label", "file_size").collect())) == sorted(map(tuple, df.collect()))
    named = back.select(IO.path_sample_id(F.col("_metadata.file_name")), "label", "sample_id")
    assert {(r[0], r[2]) for r in named.collect()} == {("a", "a"), ("b.json", "b.json")}


def test_folders_of_samples_are_read_by_tasks(spark, tmp_path):
    units = "map<string, struct<addr: long, name: string>>"
    rows = [(f"s/{i}" if i % 7 else f"é {i}", i, {f"func_{i}": (i, "n")} if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, f"sample_id string, file_size long, intra_procedural_graphs {units}")
    path = str(tmp_path / "s")
    write_sample_json(df.filter("file_size < 30").repartition(3), path, suffix=IO.SAMPLE_SUFFIX + ".gz")
    write_sample_json(df.filter("file_size >= 30"), path)
    packed = list(tmp_path.rglob("*.json.gz"))
    assert len(packed) == 30 and all(p.read_bytes()[8] != 2 for p in packed)  # 2: the slowest level
    (tmp_path / "s" / "noid_static.json").write_text('\n{"file_size": 7}\n{"file_size": \n')
    (tmp_path / "s" / "other.json").write_text('{"sample_id": "no"}')
    (tmp_path / "s" / "_staging-1").mkdir()
    (tmp_path / "s" / "_staging-1" / "x_static.json").write_text('{"sample_id": "no"}')
    got = read_sample_json(spark, path)
    plan = got.groupBy("sample_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    want = IO.read_graph_json(spark, path)
    key = lambda r: r["sample_id"]
    assert sorted(got.drop("file").collect(), key=key) == sorted(want.collect(), key=key) and got.count() == 41
    assert got.filter("sample_id = 's/1'").first()["file"] == "s%2F1_static.json.gz"
    write_sample_json(df.limit(0), str(tmp_path / "none"))
    assert read_sample_json(spark, str(tmp_path / "none")).isEmpty()
