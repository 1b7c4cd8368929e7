"""Strict readers and streaming jobs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import addressing, classify
from tidemark.sources import csv, records
from tidemark.streaming import prequential


def test_numeric_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y y",t\n1,-2.5,no\n"3",4e1,yes\n')
    got = csv.read_numeric(spark, str(tmp_path / "a.csv"), "t", {"no": 0, "yes": 1}).collect()
    assert [tuple(r) for r in got] == [(1.0, -2.5, 0), (3.0, 40.0, 1)]
    (tmp_path / "b.csv").write_text("x,t\n1,no\n0x10,yes\n")
    with pytest.raises(ValueError, match="0x10"):
        csv.read_numeric(spark, str(tmp_path / "b.csv"), "t", {"no": 0, "yes": 1})


def test_writer_refuses_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        csv.write_csv(spark.range(0), str(tmp_path / "out"))


def test_two_tapes_must_match(spark):
    x, y = spark.range(3).withColumn("x", F.col("id") * 2), spark.range(3).withColumn("y", F.lit(1))
    assert csv.two_tapes(x, y, "id").count() == 3
    with pytest.raises(Exception, match="lacks"):
        csv.two_tapes(x, y.where("id < 2"), "id").collect()


def test_online_majority(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, i, y) for i, y in enumerate([1, 1, 0, 1])] + [(2, 0, 0), (2, 2, 1)]
    spark.createDataFrame(rows, "key long, seq long, y int").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("key long, seq long, y int").parquet(str(source))
    query = prequential.online_majority(stream).writeStream.format("memory").queryName("majority").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.seq): (r.pred, r.losses, r.failed) for r in spark.table("majority").collect()}
    assert got == {(1, 0): (0, 1, False), (1, 1): (1, 1, False), (1, 2): (1, 2, False), (1, 3): (1, 2, False), (2, 0): (0, 0, False), (2, 2): (None, 1, True)}


def test_tab_separated_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "n long, s string")
    csv.write_csv(df, str(tmp_path / "t"), sep="\t")
    assert {tuple(r) for r in records.read_schedule(spark, str(tmp_path / "t"), "n long, s string").collect()} == {(1, "a b"), (2, "c")}
    with pytest.raises(Exception, match="(?i)header|schema|column"):
        records.read_schedule(spark, str(tmp_path / "t"), "n long, other string").collect()


def test_lines_and_folders_are_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1,"b":"x"}\n{"a":2}\n')
    assert [tuple(r) for r in records.read_lines(spark, str(tmp_path / "a.jsonl"), "a long, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"a":1,"b":"x"}\n{"a": 2}\n\n{"a":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_lines(spark, str(tmp_path / "b.jsonl"), "a long, b string").collect()
    found = {(r.line, r.rule) for r in records.line_violations(spark, str(tmp_path / "b.jsonl"), "a long, b string", longest=12).collect()}
    assert {('{"a":1,"b":"x"}', "long"), ('{"a": 2}', "canonical"), ("", "empty")} <= found and ('{"a":1,"b":"x"}', "canonical") not in found
    for name in ("x/r1.json", "x/y/r2.json", "x/y/other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"id": 5,\n "arms": {"A": {"ns": 2000, "use": {"q": 3}}, "B": {"ns": 1000}}}')
    nested = records.read_folder(spark, str(tmp_path / "x"), "id long, arms map<string, struct<ns: long, use: struct<q: long>>>", "r*.json")
    rows = records.flattened(nested, ["id"], "arms", {"us": ("ns", 1000), "q": ("use.q", 1)}).distinct().collect()
    assert nested.count() == 2 and {(r.arm, r.us, r.q) for r in rows} == {("A", 2.0, 3.0), ("B", 1.0, None)}
    assert nested.select(records.measured("arms.C.use.q")).first()[0] is None
    with pytest.raises(Exception, match="below 0"):
        nested.withColumn("n", -nested["id"]).select(records.measured("n")).collect()


def test_chunks_and_their_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    manifest = records.write_chunks(spark.range(10, numPartitions=1), path, 4)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert manifest.count() == 3 and records.chunk_differences(manifest, spark, path).count() == 0
    files = sorted((tmp_path / "out").glob("*.json.gz"))
    for crc in (tmp_path / "out").glob(".*.crc"):
        crc.unlink()
    files[0].unlink()
    files[1].write_bytes(b"changed")
    assert {r.rule for r in records.chunk_differences(manifest, spark, path).collect()} == {"missing", "changed"}


def test_canonical_json_and_seeds(spark):
    row = spark.range(1).select(records.canonical_json(F.lit(2), F.lit("x"), F.lit(None).cast("int"), names=["b", "a", "c"]).alias("j"), addressing.seed_32(F.lit("s")).alias("s"), addressing.seed_64(F.lit("s")).alias("l")).first()
    digest = hashlib.sha256(b"s").hexdigest()
    assert row.j == '{"a":"x","b":2}' and row.s == int(digest[:8], 16) and int(row.l) == int(digest[:16], 16)
    parts = spark.createDataFrame([("BENEFICIAL", "HARMFUL", "EQUIVALENT"), ("BENEFICIAL", "HARMFUL", "HARMFUL"), ("HARMFUL", "HARMFUL", "HARMFUL"), ("EQUIVALENT", "HARMFUL", "HARMFUL")], "a string, b string, c string")
    assert [r[0] for r in parts.select(classify.cancellation(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["CANCELLING", "OPPOSED", "AGREEING", "MIXED"]


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", 1, 1, 1), ("2024-01-01 00:00:50", 1, 1, 0), ("2024-01-01 00:01:10", 1, 0, 0), ("2024-01-01 02:00:00", 1, 0, 1), ("2024-01-01 09:00:00", 2, 1, 1)]
    spark.createDataFrame(rows, "t string, k int, y int, pred int").selectExpr("to_timestamp(t) AS t", "k", "y", "pred").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("t timestamp, k int, y int, pred int").parquet(str(tmp_path / "in"))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    found = {r.window.start.strftime("%H:%M"): (r.tp, r.fn, r.fp, r.tn) for r in run(prequential.online_confusion(read(), "t", "1 minute", "1 minute"), "confusion")}
    assert found == {"00:00": (1, 1, 0, 0), "00:01": (0, 0, 0, 1), "02:00": (0, 0, 1, 0)}
    assert sorted(r.events for r in run(prequential.sessions(read(), "k", "t", "5 minutes", "1 minute"), "sessions")) == [1, 3]
