"""Records as JSON and back, times, rejects, and decisions saved file by file."""

import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill import codecs
from gristmill.functions.text import instant, iso
from gristmill.schemas import STATUS_KEY
from gristmill.store import Store

AT = datetime(2024, 2, 29, 23, 59, 58, 120, timezone.utc)
#: A row of each kind as the table has it.
ROWS = {
    "files": [("f1", "/a/b.md", AT, {"k": "v"}), ("f2", "/ü\n\"x\".md", datetime(1901, 1, 1, tzinfo=timezone.utc), {})],
    "blocks": [("f1", "/a/b.md", "b1", 3, "code", "line\n\ttwo   \"q\" \\", {"of": "{}"}), ("f1", None, "b2", None, "text", "", {}), ("f1", None, "b3", 1, "table", "long " * 100_000, {})],
    "results": [("x", "a", "b", "md5_duplicate", None), ("x", "b", "a", "semantic_similarity", 0.25)],
    "pair_decisions": [("x", "a", "b", "md5_duplicate", "mark_similar", AT, None), ("x", "", "b", "unknown", "undecided", AT, "why")],
}


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("kind", codecs.SCHEMAS)
def test_round_trip(spark, kind):
    table = spark.createDataFrame(ROWS[kind], codecs.SCHEMAS[kind])
    once = codecs.decoded(codecs.encoded(table, kind), kind)
    assert codecs.rejected(once).count() == 0
    rows = codecs.accepted(once, kind)
    if kind in ("results", "pair_decisions"):  # the ids are made from the pair, whatever the record says
        name = rows.columns[0]
        assert rows.where(F.col(name) == "x").count() == 0 and rows.drop(name).exceptAll(table.drop(name)).count() == 0
    else:
        columns = [F.to_json(c).alias(c) if c == "metadata" else F.col(c) for c in rows.columns]  # maps don't compare
        assert rows.select(columns).exceptAll(table.select(columns)).count() == 0
    assert rows.count() == len(ROWS[kind])
    again = codecs.decoded(codecs.encoded(rows, kind), kind)
    assert sorted(map(str, codecs.accepted(again, kind).collect())) == sorted(map(str, rows.collect()))
    assert codecs.decoded(codecs.encoded(table.limit(0), kind), kind).count() == 0


def test_rejects_and_defaults(spark):
    good = {"file_id": "f", "text": "t", "other": 5}
    bad = [None, "", "  ", "[]", "5", "null", '{"file_id": "f"', "{", json.dumps({"file_id": "f", "text": "t", "pos": "three"}), json.dumps({"file_id": "f", "text": None}), json.dumps({}), "[" + json.dumps(good) + "]"]
    kept = [json.dumps(good), json.dumps(good), json.dumps(good | {"block_type": "CODE", "block_id": "", "metadata": {"n": 1, "l": [1, 2]}})]
    rows = codecs.decoded(texts(spark, *bad, *kept), "blocks").collect()
    assert len(rows) == len(bad) + len(kept)
    by = {(r["record"], r["reject"]) for r in rows if r["reject"]}
    assert by == {(t, "without text" if t and '"text": null' in t else "without file_id, text" if t == "{}" else "unreadable") for t in bad}
    assert all(r["file_id"] is None and r["metadata"] is None for r in rows if r["reject"])
    one, two, typed = sorted((r for r in rows if not r["reject"]), key=lambda r: len(r["record"]))
    assert one["block_id"] == two["block_id"] != typed["block_id"] != "" and one["metadata"] == {}
    assert typed["block_type"] == "unknown" and typed["metadata"] == {"n": "1", "l": "[1,2]"}
    pair = [json.dumps({"block_id_1": a, "block_id_2": b, "analysis_type": t, "decision": "no", "timestamp": "soon"}) for a, b, t in (("a", "b", "?"), ("b", "a", "unknown"))]
    rows = codecs.decoded(texts(spark, *pair), "pair_decisions", F.lit(AT)).collect()
    assert len({r["decision_id"] for r in rows}) == 1 and {(r["analysis_type"], r["decision"]) for r in rows} == {("unknown", "undecided")}
    assert all(r["decided_at"].timestamp() == AT.timestamp() for r in rows)


def test_times_as_python_reads_them(spark):
    zones = ["", "Z", "+00:00", "+05:30", "-0800", "+14:00", "-03:15"]
    good = [f"{day}{t}{z}" for day in ("2024-02-29", "1969-12-31", "1883-11-18", "2024-03-10", "2024-11-03") for t in ("T00:00", " 02:30:01", "T23:59:59.5", "T01:30:00.123456789") for z in zones] + ["2024-02-29"]
    bad = ["", "2023-02-29", "2024-13-01T00:00", "2024-01-01T25:00", "yesterday", "2024", "2024-01-01T00:00+", "2024-01-01X00:00", "12:00", None, "2024-01-01T00:00:00Zulu"]
    for zone in ("UTC", "America/New_York"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = texts(spark, *good, *bad).select("value", F.unix_micros(instant(F.col("value"))).alias("at"), iso(instant(F.col("value"))).alias("iso")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        for r in found:
            if r["value"] in bad:
                assert r["at"] is None and r["iso"] is None, r
                continue
            want = datetime.fromisoformat(r["value"])
            want = want.replace(tzinfo=timezone.utc) if want.tzinfo is None else want.astimezone(timezone.utc)
            assert r["at"] == (want - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) and r["iso"] == want.isoformat(), r


def test_records_are_loaded_and_rejects_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path), ranges=2)
    assert store.rejects("files").count() == 0
    records = codecs.encoded(spark.createDataFrame(ROWS["files"], codecs.SCHEMAS["files"]), "files").unionByName(texts(spark, "no", "{}"))
    assert store.load_records("files", records) == {"accepted": 2, "rejected": 2}
    assert store.load_records("files", texts(spark, '{"file_id": 1}')) == {"accepted": 0, "rejected": 1}
    assert store.load_records("files", texts(spark)) == {"accepted": 0, "rejected": 0}
    assert sorted(r["file_id"] for r in store.read("files").collect()) == ["f1", "f2"]
    assert sorted((r["reject"], r["record"]) for r in store.rejects("files").collect()) == [("unreadable", "no"), ("without file_id, original_path", "{}"), ("without original_path", '{"file_id": 1}')]


def test_decisions_are_saved_by_file(spark, tmp_path):
    store = Store(spark, str(tmp_path), ranges=16)
    rows = [(f"/d/{i}.md", f"b{j}", j, "text", "t", {"original_path": f"/d/{i}.md", STATUS_KEY: "nonsense"} if j == 0 else None) for i in range(12) for j in range(3)]
    blocks = spark.createDataFrame(rows, "path string, block_id string, pos int, block_type string, text string, metadata map<string,string>")
    assert store.save_block_decisions(blocks.selectExpr("path", "block_id", "block_type", "'keep' AS decision")) == {"valid": 36, "saved": 0, "files": 0, "unknown": 36}
    files = store.register_files(blocks)
    store.upsert("blocks", blocks.join(files, "path"))
    assert {r["decision"] for r in store.block_decisions().collect()} == {"undecided"}
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "blocks/data").rglob("*.parquet")}
    asked = [("/d/3.md", "b0", "text", "keep"), ("/d/3.md", "b1", "text", "delete"), ("/d/5.md", "b2", "text", "keep"), ("/d/5.md", "b2", "text", "delete")]
    odd = [("/d/5.md", "b1", "text", "later"), ("/d/5.md", "b1", "code", "keep"), ("/d/none.md", "b1", "text", "keep"), (None, "b1", "text", "keep"), ("/d/4.md", "b1", "text", None)]
    decisions = spark.createDataFrame(asked + odd, "path string, block_id string, block_type string, decision string")
    assert store.save_block_decisions(decisions) == {"valid": 5, "saved": 3, "files": 2, "unknown": 2}
    got = {(r["path"], r["block_id"]): r["decision"] for r in store.block_decisions().collect()}
    assert len(got) == 36 and {k: v for k, v in got.items() if v != "undecided"} == {("/d/3.md", "b0"): "keep", ("/d/3.md", "b1"): "delete", ("/d/5.md", "b2"): "keep"}
    after = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "blocks/data").rglob("*.parquet")}
    assert before.items() <= after.items()  # what was there is as it was
    assert store.history("blocks").orderBy("version").collect()[-1]["ranges"] <= 2  # and ranges of the two files alone have more
    assert store.save_block_decisions(decisions)["saved"] == 0 and store.history("blocks").count() == 2
    kept = store.read("blocks").where("path = '/d/3.md' AND block_id = 'b0'").first()["metadata"]
    assert kept == {"original_path": "/d/3.md", STATUS_KEY: "keep"}
    assert store.save_block_decisions(decisions.limit(0)) == {"valid": 0, "saved": 0, "files": 0, "unknown": 0}


def test_saved_decisions_move_whole_rows_once(spark, tmp_path):
    """A change of every block replaces the segments, a change of some adds to them, and another writer's rows are kept."""
    store = Store(spark, str(tmp_path / "s"), ranges=4)
    blocks = spark.range(60).selectExpr("concat('p', id % 12) AS path", "concat('b', id) AS block_id", "int(id) AS pos", "'text' AS block_type", "concat('t', id) AS text")
    blocks = blocks.withColumn("file_id", F.md5("path")).withColumn("metadata", F.create_map(F.lit("of"), F.col("path")))
    store.register_files(blocks)
    assert store.upsert("blocks", blocks) and not store.upsert("blocks", blocks)
    log = store._log("blocks")
    of = lambda d, rows=blocks: rows.select("path", "block_id", "block_type", F.lit(d).alias("decision"))
    assert store.save_block_decisions(of("keep"))["saved"] == 60
    assert all(len(s) == 1 for s in log.segments(log.entries()).values())
    assert store.read("blocks").count() == 60 and store.read("blocks", 1).where("metadata['of'] <> path OR size(metadata) <> 1").count() == 0
    assert store.save_block_decisions(of("delete", blocks.where("pos < 7")))["saved"] == 7
    assert max(len(s) for s in log.segments(log.entries()).values()) == 2
    assert {r["decision"]: r["count"] for r in store.block_decisions().groupBy("decision").count().collect()} == {"keep": 53, "delete": 7}
    twice = blocks.where("pos = 1").withColumn("text", F.lit("z")).unionByName(blocks.where("pos = 1").withColumn("text", F.lit("y")))
    assert store.upsert("blocks", twice)
    assert [r["text"] for r in store.read("blocks").where("block_id = 'b1'").collect()] == ["z"] and store.read("blocks").count() == 60

    # a version that another writer has put in since is compared with, and its rows of the same ranges are not replaced
    rows = store.read("blocks").withColumn("metadata", F.create_map(F.lit("x"), F.col("path")))
    seen = len(log.entries())
    assert store.upsert("blocks", blocks.where("pos = 0").withColumn("block_id", F.lit("theirs")))
    assert store._put("blocks", rows, seen=seen, whole=True)
    assert store.read("blocks").count() == 61
