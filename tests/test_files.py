"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.sources import files


def test_leaderboard_payload(spark, tmp_path):
    objs = [{"item_id": "a", "like_cnt": 5}, {"item_title": "lost"}, {"item_id": "b", "item_title": "t", "play_cnt": 3}]
    (tmp_path / "2026_1001.json").write_text(json.dumps({"code": 0, "data": {"objs": objs}}, indent=1))
    got = sorted(map(tuple, files.read_leaderboards(spark, str(tmp_path)).select("item_id", "list_id", "rank", "likes", "title").collect()))
    assert got == [("a", 1001, 1, 5, None), ("b", 1001, 3, None, "t")]


def test_log_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"tool": "x", "cost": 1}\n\nnot json\n{"tool": "y"}\n')
    schema = T.StructType([T.StructField("tool", T.StringType()), T.StructField("cost", T.LongType())])
    assert sorted(r.tool for r in files.read_log(spark, str(tmp_path), schema).collect()) == ["x", "y"]


def test_vector_store_notices_stale_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [0.5])], "id long, text string, embedding array<float>")
    files.write_vectors(rows, str(tmp_path / "v"), "m1")
    assert files.read_vectors(spark, str(tmp_path / "v"), rows, "m1").count() == 2
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "v"), rows.withColumn("text", F.upper("text")), "m1")
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "v"), rows, "m2")


def test_json_in_model_text_and_devices(spark):
    df = spark.createDataFrame([('<think>{x}</think>```json\n{"a": {"b": 1}}\n``` done',), ("none",)], "t string")
    assert [r[0] for r in df.select(files.first_json(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None]
    devices = spark.createDataFrame([("u1", 100, 1), ("u2", 9000, 0), ("u3", 9000, 50)], "uuid string, memory_mib long, load long")
    processes = spark.createDataFrame([("u3", 7)], "uuid string, pid long")
    got = {r.uuid: r.eligible for r in files.device_eligibility(devices, processes, [7]).collect()}
    assert got == {"u1": True, "u2": False, "u3": True}


def test_lines_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    files.write_lines(df, str(tmp_path / "l"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "l")).count() == 2
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True).collect())) == [("1", "x"), ("2", None)]
