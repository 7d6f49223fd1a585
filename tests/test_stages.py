"""Metrics, encoders that fail, canonical paths, lineage and stages that are run again."""

import os
import posixpath
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import paths
from gristmill.metrics import Metrics
from gristmill.operators import encoding, lineage, render, semantic
from gristmill.plans.pipeline import Config, analyse, analyse_again
from gristmill.plans.stages import Stages, digest_of
from gristmill.sources import files as src


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in {"a.md": "# A\n\nThe same words here.\n\nMore of a.", "b.md": "# B\n\nThe same words here.\n\n```\n\n```\n\nOnly in b.", "sub/c.md": "# C\n\nOnly in b, or c."}.items():
        (tmp_path / "in" / name).write_text(text)
    return tmp_path


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_metrics_ride_on_the_run(spark, folder):
    metrics = Metrics()
    config = Config(str(folder / "in"), str(folder / "out"))
    plain, found = analyse(spark, config), analyse(spark, config, metrics=metrics)
    assert scans(found.rendered()) == scans(plain.rendered()) > 0
    assert metrics.stages(wait=0) == {}  # nothing has run
    with metrics.timed("write"):
        assert render.write(found.rendered()) == 3 and (folder / "out/sub/c_deduped.md").exists()
    got = metrics.stages()
    assert got["files"] == {"rows": 3, "bytes": sum(p.stat().st_size for p in (folder / "in").rglob("*.md"))}
    assert got["exact"]["rows"] == plain.blocks.count() and got["exact"]["skipped_heading"] == 3 and got["exact"]["skipped_deleted"] == 0
    assert got["exact"]["processed"] + sum(v for k, v in got["exact"].items() if k.startswith("skipped")) == got["exact"]["rows"]
    with pytest.raises(ZeroDivisionError), metrics.timed("write"):
        1 / 0
    assert metrics.operations()["write"]["count"] == 2 and metrics.operations()["write"]["seconds"] > 0
    with pytest.raises(ValueError):
        metrics.observed(plain.blocks, "files")
    empty = Metrics()
    assert empty.observed(plain.blocks.limit(0), "none").count() == 0 and empty.stages() == {"none": {"rows": 0}}


def bad_on_b(texts):
    if any("b" in t for t in texts):
        raise RuntimeError("no b")
    return np.array([[len(t), np.nan if t == "nan" else 1.0] for t in texts])


def test_encoder_that_fails_on_some_batches(spark):
    texts = [f"t{i}" for i in range(200)] + ["b1", "x b", "nan", "", None, "t1", "long " * 50_000]
    blocks = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = {r["text_md5"]: r for r in encoding.encoded(blocks, bad_on_b, batch=64).collect()}
    assert len(rows) == 204
    by_text = {r["text"]: rows[r["m"]] for r in blocks.where("text <> ''").select("text", F.md5("text").alias("m")).collect()}
    assert {t: (r["embedding"], r["code"], r["reason"]) for t, r in by_text.items() if r["code"]} == {
        "b1": ([], 3002, "RuntimeError: no b"),
        "x b": ([], 3002, "RuntimeError: no b"),
        "nan": ([], 3002, "not finite"),
    }
    assert by_text["t7"]["embedding"] == [2.0, 1.0] and by_text["long " * 50_000]["embedding"] == [250_000.0, 1.0]
    wrong = encoding.encoded(blocks, lambda t: np.zeros(len(t))).first()
    assert wrong["code"] == 3002 and "shape" in wrong["reason"]
    kept = encoding.saved(encoding.encoded(blocks, bad_on_b))
    cache = encoding.cacheable(kept)
    assert cache.count() == 201 and encoding.failures(kept).count() == 3
    again = encoding.encoded(blocks, lambda t: np.ones((len(t), 2)), cache=cache)
    assert again.count() == 204 and again.where("embedding = array(1D, 1D)").count() == 3  # only what had failed is encoded
    assert encoding.encoded(blocks.limit(0), bad_on_b).count() == 0
    assert semantic.encoded_texts(blocks, bad_on_b).columns == ["text_md5", "embedding"]


def counting(folder):
    def make():
        import uuid

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return semantic.hashing_encoder

    return make


def no_model():
    raise OSError("no such model")


def test_encoder_loads_once_a_worker(spark, tmp_path):
    blocks = spark.range(400).select(F.concat(F.lit("t"), "id").alias("text")).repartition(16)
    loader = encoding.Loader("counted", counting(str(tmp_path)))
    assert encoding.encoded(blocks, loader).where("code IS NULL").count() == 400
    by_worker = [x.split("-")[0] for x in os.listdir(tmp_path)]
    assert len(by_worker) == len(set(by_worker)) > 0
    assert encoding.loads(spark, loader) is None and encoding.loads(spark, semantic.hashing_encoder) is None
    broken = encoding.Loader("broken", no_model)
    assert encoding.loads(spark, broken) == "OSError: no such model"
    rows = encoding.encoded(blocks, broken)
    assert {(r["code"], r["reason"], len(r["embedding"])) for r in rows.collect()} == {(3001, "OSError: no such model", 0)}


def test_semantic_stage_is_gated(spark, folder):
    found = analyse(spark, Config(str(folder / "in"), encoder=encoding.Loader("broken", no_model)))
    assert found.pairs is None and found.semantic_skipped == "OSError: no such model" and found.status().first()["similar_pairs"] == 0
    found = analyse(spark, Config(str(folder / "in"), threshold=0.5, encoder=bad_on_b))
    assert found.semantic_skipped is None and {r["code"] for r in found.encoder_failures.collect()} == {3002}
    assert found.pairs.count() >= 0


def plainly(path):
    """What canonical() says of a path without a scheme, by the standard library."""
    out = posixpath.normpath(path) if path else "."
    return "/" + out.lstrip("/") if out.startswith("//") else out


def test_canonical_paths(spark):
    draw = random.Random(7)
    made = ["".join(draw.choice(["/", "//", "a", "b.c", ".", "..", "/./", "/../", "-", "ü"]) for _ in range(draw.randint(0, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(p,) for p in made], "p string").select("p", paths.canonical(F.col("p")).alias("c"), paths.canonical(F.col("p"), F.lit("/base/x")).alias("b")).collect()
    for r in rows:
        assert r["c"] == plainly(r["p"]), r["p"]
        assert r["b"] == plainly(r["p"] if r["p"].startswith("/") else f"/base/x/{r['p']}"), r["p"]
    fixed = {"file:/a/b": "/a/b", "file:///a//b/": "/a/b", "S3A://Bucket/x/../y": "s3a://Bucket/y", "hdfs://h:1": "hdfs://h:1/", "abfs://c@h/..": "abfs://c@h/", None: None, "x" * 5000: "x" * 5000}
    got = spark.createDataFrame([(p,) for p in fixed], "p string").select("p", paths.canonical(F.col("p")).alias("c"), paths.canonical(F.col("p"), F.lit("s3://k/r")).alias("b")).collect()
    assert {r["p"]: r["c"] for r in got} == fixed and {r["b"] for r in got if r["p"] == "hdfs://h:1"} == {"hdfs://h:1/"}
    order = spark.createDataFrame([("a-b",), ("a/b",), ("a",), (None,)], "p string").orderBy(paths.by_parts(F.col("p")))
    assert [r["p"] for r in order.collect()] == [None, "a", "a/b", "a-b"]


def test_listing_has_canonical_paths(spark, folder):
    got = {r["path"] for r in src.listing(spark, f"{folder}/in/sub/..//", max_depth=0).collect()}
    assert got == {f"{folder}/in/a.md", f"{folder}/in/b.md"}


def test_lineage(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)]
    star = [(f"s{i}", "hub") for i in range(300)] + [("hub", "top")]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x")]
    odd = [("self", "self"), (None, "c1"), ("none", None), ("two", "c9"), ("two", "c10"), ("two", "c10")]
    rows = spark.createDataFrame(chain + star + circle + odd, "block_id string, merged_into string")
    got = {r["block_id"]: (r["root"], r["hops"]) for r in lineage.ends(rows).collect()}
    want = {f"c{i}": ("c37", 37 - i) for i in range(37)} | {f"s{i}": ("top", 2) for i in range(300)} | {"hub": ("top", 1)}
    want |= {k: (None, None) for k in ("x", "y", "z", "into")} | {"two": ("c37", 28)}
    assert got == want
    assert lineage.ends(rows.limit(0)).count() == 0
    assert lineage.ends(spark.createDataFrame([("a", "a")], "block_id string, merged_into string")).count() == 0
    both = spark.createDataFrame([("a", "b"), ("b", "a")], "block_id string, merged_into string")
    assert {r["root"] for r in lineage.ends(both).collect()} == {None}
    long = spark.createDataFrame([(i, i + 1) for i in range(64)], "k long, t long")
    assert {(r["k"], r["root"], r["hops"]) for r in lineage.ends(long, "k", "t").collect()} == {(i, 64, 64 - i) for i in range(64)}


def test_stages_run_again_only_where_something_changed(spark, folder):
    def run(**more):
        stages = Stages(spark, f"{folder}/stages")
        decisions = more.pop("decisions", None)
        found = analyse_again(spark, Config(str(folder / "in"), **{"encoder": semantic.hashing_encoder, "threshold": 0.5} | more), stages, decisions)
        return found, stages.ran

    first, ran = run()
    assert ran == ["blocks", "decided", "members", "vectors", "pairs"]
    plain = analyse(spark, first.config)
    same = lambda a, b: {tuple(map(str, r)) for r in a.collect()} == {tuple(map(str, r)) for r in b.collect()}
    assert same(first.pairs, plain.pairs) and same(first.blocks, plain.blocks.select(first.blocks.columns)) and first.members.count() == plain.members.count()
    assert run()[1] == [] and run(threshold=0.9)[1] == ["pairs"] and run(threshold=0.9)[1] == []
    assert run(encoder=encoding.Loader("other", lambda: semantic.hashing_encoder))[1] == ["vectors", "pairs"]
    assert run(skip_semantic=True)[0].pairs is None
    block = first.blocks.where("block_type = 'text'").select("path", "block_id", "block_type", F.lit("delete").alias("decision")).limit(1)
    assert run(decisions=block)[1] == ["decided", "members", "pairs"]
    assert run(merge_code=True)[1] == ["blocks", "decided", "members", "vectors", "pairs"]
    with open(folder / "in/a.md", "a") as f:
        f.write("\n\nMore.")
    found, ran = run()
    assert ran[0] == "blocks" and found.blocks.where("text = 'More.'").count() == 1
    # an unfinished output is passed over
    for root, _, names in os.walk(folder / "stages/pairs"):
        if "_SUCCESS" in names:
            os.remove(f"{root}/_SUCCESS")
    assert run()[1] == ["pairs"]
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert digest_of(rows, "k", "v") == digest_of(rows.orderBy(F.desc("k")), "k", "v") != digest_of(rows.distinct(), "k", "v")
    assert digest_of(rows.limit(0), "k", "v") == digest_of(rows.where("false"), "k", "v")
