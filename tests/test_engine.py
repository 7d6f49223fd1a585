import re

import pytest
from pyspark.sql import functions as F

from gristmill.errors import EngineError
from gristmill.functions import text as fn
from gristmill.operators import decisions as dec
from gristmill.operators import duplicates, merge, render, semantic, simhash
from gristmill.plans.pipeline import Config, analyse
from gristmill.sources import files as src
from gristmill.store import Store

FENCE = "```"


def code(*texts, kind="code", file="f"):
    return [{"file_id": file, "pos": i, "block_id": str(i), "block_type": kind if isinstance(t, str) else t[0], "text": t if isinstance(t, str) else t[1], "token_count": 1} for i, t in enumerate(texts)]


@pytest.mark.parametrize(
    "texts, gap, want, language",
    [
        ((FENCE + "python", "print(1)", FENCE), 1, "\nprint(1)", "python"),
        ((FENCE + "python", "print(1)", FENCE), 0, "```python\n\nprint(1)\n```", "python"),
        ((FENCE + "python", "def", "factorial", "(n):", "    if", FENCE), 1, "\ndef factorial(n):    if", "python"),
        ((FENCE + "python", "  ", "x", FENCE), 1, "\n\n\nx", "python"),
        (("```\npython", "print('Hello')", FENCE), 1, "```\npython print('Hello')", None),
        (("```python import x", "y", FENCE), 1, "\ny", "python"),
        ((FENCE, FENCE), 1, "", None),
        (("```python\nimport x\n", "y", FENCE), 1, "import x\ny", "python"),
        (("```python\n", "a = 1\r\n", "z\n```"), 1, None, "python"),
        (("```python", "def f():\n    return 1\n", "x = f()\n", FENCE), 1, "\ndef f():\n    return 1\nx = f()\n", "python"),
    ],
)
def test_merge_examples(texts, gap, want, language):
    out, members = merge.fold(code(*texts), gap)
    assert [r["text"] for r in out] == [merge.body_of(list(texts)) if want is None else want]
    assert out[0]["block_type"] == "code_merged" and out[0]["language"] == language
    assert len(members) == len(texts) and {m["merged_into"] for m in members} == {out[0]["block_id"]}


def test_merge_body_keeps_line_ends():
    assert merge.body_of(["```python\n", "a = 1\r\n", "z\n```"]) == "\na = 1\r\nz\n"
    assert merge.body_of(["```python\nimport x\n", "y", "```"]) == "import x\ny"
    assert merge.body_of(["\n```python", "x", "```"]) == "\n```python x"
    assert merge.body_of(["", "x"]) == "\nx"


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.md").write_text("# A\n\nä")
    (tmp_path / "bad.MD").write_bytes(b"# \xff\xfe")
    (tmp_path / "other.txt").write_text("x")
    assert [r["content"] for r in src.markdown_files(spark, str(tmp_path)).collect()] == ["# A\n\nä"]
    assert [tuple(r) for r in src.quarantined(src.listing(spark, str(tmp_path))).collect()] == [(f"{tmp_path}/bad.MD", 1002, "not UTF-8")]
    assert src.markdown_file(spark, f"{tmp_path}/good.md").first()["content"] == "# A\n\nä"
    for name, number in (("bad.MD", 1002), ("none.md", 1001), ("other.txt", 1002)):
        with pytest.raises(EngineError) as e:
            src.markdown_file(spark, f"{tmp_path}/{name}")
        assert e.value.number == number


def test_store_recovers_from_broken_files(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    path = tmp_path / "decisions.json"
    assert store.load_json("block_decisions", str(path)).count() == 0
    path.write_text("")
    assert store.load_json("block_decisions", str(path)).count() == 0
    path.write_text("{invalid json")
    assert store.load_json("block_decisions", str(path)).count() == 0
    assert not path.exists() and [p.read_text() for p in tmp_path.glob("decisions.json.corrupt.*")] == ["{invalid json"]
    row = '{"path": "p", "block_id": "b", "block_type": "text", "decision": %s, "decided_at": "2024-01-02T03:04:05"}'
    path.write_text("[" + row % '"keep"' + ", " + row.replace('"b"', '"c"') % '"maybe"' + ', {"path": "p"}]')
    assert sorted((r["block_id"], r["decision"]) for r in store.load_json("block_decisions", str(path)).collect()) == [("b", "keep"), ("c", "undecided")]
    path.write_text('{"x": ' + row % '"delete"' + "}")
    assert [r["decision"] for r in store.load_json("block_decisions", str(path)).collect()] == ["delete"]


def test_updates_and_pair_review(spark):
    blocks = spark.createDataFrame([("p", "b1", "text", "one\ntwo"), ("p", "b2", "text", None)], "path string, block_id string, block_type string, text string")
    decided = spark.createDataFrame([("p", "b1", "text", "keep")], "path string, block_id string, block_type string, decision string")
    for key, value, holds, want in (("p::b1::text", "delete", True, "delete"), ("p::b1::text", "keep", True, "keep"), ("p::b9::text", "delete", False, "keep"), ("p::b1", "delete", False, "keep"), ("p::b1::text", "maybe", False, "keep"), ("", "keep", False, "keep")):
        after, ok = dec.update(decided, blocks, key, value)
        assert ok == holds and [r["decision"] for r in after.collect()] == [want]
    pairs = spark.createDataFrame([("r1", "b1", "b2", "semantic_similarity", 0.8), ("r2", "b2", "b1", "semantic_similarity", 0.9)], "result_id string, block_id_1 string, block_id_2 string, analysis_type string, score double")
    chosen = dec.decide_pair(pairs, "r2", "keep")
    assert [r["decision_id"] for r in chosen.collect()] == ["r2"] and dec.decide_pair(pairs, "r2", "x").count() == 0 and dec.decide_pair(pairs, "r9", "keep").count() == 0
    got = dec.pair_review(pairs, chosen, blocks, 0, 2).collect()
    assert [(r["result_id"], r["decision"]) for r in got] == [("r2", "keep"), ("r1", "undecided")] and got[1]["preview_1"] == "one two"


def test_encoder_by_name():
    assert semantic.load_encoder("gristmill.operators.semantic:hashing_encoder") is semantic.hashing_encoder
    for name in ("gristmill.operators.semantic:none", "no_such_module:f", "", "gristmill:__name__"):
        with pytest.raises(EngineError):
            semantic.load_encoder(name)


def test_merge_gap_and_conservation():
    rows = code("```python", ("text", "a"), ("text", "b"), FENCE)
    assert merge.fold(rows, 1) == (rows, [])
    assert len(merge.fold(rows, 2)[1]) == 4
    whole = code("```python\nx\n```", ("text", "t"), "```js", "open")
    out, members = merge.fold(whole)
    assert [r["text"] for r in out] == ["```python\nx\n```", "t", "\nopen"] and len(members) == 2


def test_merge_over_files(spark):
    rows = code("```a", "x", FENCE, file="f") + code("```a", "y", file="g")
    df = spark.createDataFrame(rows)
    got = merge.merge_code_blocks(df)
    assert got.where("merged_into IS NULL").count() == 2 and got.where("status = 'delete'").count() == 5


def _python_normal(t):
    t = t.replace("`", "")
    t = re.sub(r"(?<!\\)[*_~]{1,2}(.+?)(?<!\\)[*_~]{1,2}", r"\1", t)
    t = re.sub(r"\[(.*?)\]\(.*?\)", r"\1", t)
    t = re.sub(r"!\[(.*?)\]\(.*?\)", r"\1", t)
    t = re.sub(r"^\s*([-*+]|\d+\.)\s+", "", t)
    t = re.sub(r"^\s*>\s?", "", t, flags=re.MULTILINE)
    return " ".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in t.split("\n")) if x).strip()


def test_normalize_matches_python(spark):
    import random

    rng = random.Random(3)
    parts = ["a", "_", "*", "**", "~", "`", "[t](u)", "![x](y)", "> ", "- ", "12. ", "\n", " ", " ", "　", "\x1c", "\x85", "\r", "中", "\\", "x y"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)] + ["a_b_c", "* item *x*", "![alt](u)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", fn.normalize(F.lit("Text"), F.col("t")).alias("n"), fn.strip(F.col("t")).alias("s")).collect()
    assert [(r["t"], r["n"]) for r in got if r["n"] != _python_normal(r["t"])] == []
    assert all(r["s"] == r["t"].strip() for r in got)


def test_emphasis_in_sql_matches_python():
    import random

    import duckdb

    from gristmill.plans import catalogue

    rng = random.Random(1)
    texts = ["".join(rng.choices("*_~\\ab\n` ", k=rng.randint(0, 14))) for _ in range(2000)]
    with duckdb.connect() as db:
        got = db.execute(f"SELECT {catalogue._PLAIN} FROM (SELECT unnest(?) AS m)", [texts]).fetchall()
    want = [re.sub(r"(?<!\\)[*_~]{1,2}(.+?)(?<!\\)[*_~]{1,2}", r"\1", t.replace("`", "")) for t in texts]
    assert [g[0] for g in got] == want


def test_types_keys_previews(spark):
    rows = [("# T", "Title"), ("- x", "ListItem"), ("1. x", "ListItem"), ("```x", "CodeSnippet"), ("абв", "Text"), ("中文", "NarrativeText"), ("12", "Text"), ("#", "Text")]
    df = spark.createDataFrame([(r, w) for r, w in rows], "r string, w string")
    got = df.select("w", fn.infer_element_type(F.lit("Text"), F.col("r")).alias("g")).collect()
    assert [r["g"] for r in got] == [r["w"] for r in got]
    keys = ["a::b::c", "p::q::b::c", "a::b", "", None, "a:::b::c", "x\ny::b::c"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in df.select("k", fn.parsed_key(F.col("k")).alias("p")).collect():
        parts = (r["k"] or "").rsplit("::", 2)
        assert tuple(r["p"]) == (tuple(parts) if len(parts) == 3 else (None, None, None))
    got = spark.createDataFrame([(None, "b", ""), ("p", "id-10", "t")], "p string, b string, t string").select(fn.decision_key(F.col("p"), F.col("b"), F.col("t")).alias("k"), fn.sort_key(F.col("p"), F.col("b")).alias("s")).collect()
    assert [r["k"] for r in got] == ["UNKNOWN_FILE::b::UNKNOWN_TYPE", "p::id-10::t"] and got[1]["s"]["id"] == "0000000010"
    views = spark.createDataFrame([(None,), ("a\nb",), ("x" * 80,), ("x" * 81,)], "t string").select(fn.preview(F.col("t")).alias("v"))
    assert [r["v"] for r in views.collect()] == ["[无内容]", "a b", "x" * 80, "x" * 80 + "..."]


def test_pair_id_is_uuid5(spark):
    import uuid

    ns = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    df = spark.createDataFrame([(f"b{i}", f"a{i}") for i in range(40)], "x string, y string")
    for r in df.select("x", "y", fn.pair_id(F.col("x"), F.col("y"), F.lit("md5_duplicate")).alias("p")).collect():
        assert r["p"] == str(uuid.uuid5(ns, f"{min(r['x'], r['y'])}_{max(r['x'], r['y'])}_md5_duplicate"))


@pytest.fixture()
def folder(tmp_path):
    shared, code_ = "The same paragraph here.", "```python\nprint(1)\n```"
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text(f"# A\n\n{shared}\n\n{code_}\n\nOnly a.\n")
    (tmp_path / "in/b.md").write_text(f"# B\n\n{shared}\n\n{code_}\n\nOnly b.\n")
    (tmp_path / "in/sub/c.MARKDOWN").write_text(f"# C\n\n{shared}\n\nOnly c.\n")
    (tmp_path / "in/d.txt").write_text("no")
    return tmp_path


def test_folder_end_to_end(spark, folder):
    found = analyse(spark, Config(str(folder / "in"), str(folder / "out"), encoder=semantic.hashing_encoder))
    sizes = sorted(r["n"] for r in duplicates.group_arrays(found.members).collect())
    assert sizes == [2, 3]
    files = {r["output_path"]: r["content"] for r in found.rendered().collect()}
    assert set(files) == {f"{folder}/out/{x}_deduped.md" for x in ("a", "b", "sub/c")}
    assert files[f"{folder}/out/b_deduped.md"] == "# B\n\nOnly b."
    assert "The same" in files[f"{folder}/out/a_deduped.md"]
    assert found.status().first()["exact_groups"] == 2
    render.write(found.rendered())
    assert (folder / "out/sub/c_deduped.md").read_text() == "# C\n\nOnly c."
    store = Store(spark, f"{folder}/store")
    decided = found.blocks.withColumn("decided_at", F.current_timestamp())
    assert store.upsert("block_decisions", decided) and store.read("block_decisions").count() == found.blocks.count()
    again = analyse(spark, Config(str(folder / "in")), decisions=store.read("block_decisions"))
    assert {tuple(r) for r in again.blocks.select("block_id", "decision").collect()} == {tuple(r) for r in found.blocks.select("block_id", "decision").collect()}


def test_prior_decisions_rule(spark):
    rows = [("p1", "1", "text", " x ", "delete"), ("p2", "1", "text", "x", "undecided"), ("p3", "1", "text", "x　", "keep"), ("p4", "1", "heading", "x", "undecided"), ("p5", "1", "code", "x", "undecided"), ("p6", "1", "code", "```", "undecided")]
    blocks = spark.createDataFrame(rows, "path string, block_id string, block_type string, text string, decision string")
    members = duplicates.exact_groups(blocks)
    assert {r["path"] for r in members.collect()} == {"p2", "p3"}
    after = {r["path"]: r["decision"] for r in duplicates.applied(blocks, duplicates.suggestions(members)).collect()}
    assert after["p2"] == "keep" and after["p3"] == "keep" and after["p1"] == "delete" and after["p4"] == "undecided"
    h = members.first()["h"]
    assert {tuple(r) for r in dec.decide(members, h, keep=(2,), delete=(1,)).select("path", "decision").collect()} == {("p2", "delete"), ("p3", "keep")}


def test_unique_files_and_listing(spark, folder):
    listing = src.listing(spark, str(folder / "in"))
    assert listing.count() == 3 and src.listing(spark, str(folder / "in"), max_depth=0).count() == 2
    files = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "path string, content string")
    assert [r["path"] for r in duplicates.unique_files(files).collect()] == ["c"]
    assert sorted(r["path"] for r in duplicates.unique_files(files, "keep_first").collect()) == ["a", "c"]
    json = spark.createDataFrame([('[{"files":[{"path":"a","size":1},{"path":"b"}],"x":1},{"files":[]}]',), ("nonsense",)], "value string")
    assert [[f["path"] for f in r["files"]] for r in src.external_groups(json).collect()] == [["a"]]


def test_store_upsert_and_filters(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("results").count() == 0
    one = spark.createDataFrame([("r1", "a", "b", "md5_duplicate", None), ("r2", "a", "c", "md5_duplicate", 0.9), ("", "x", "y", "md5_duplicate", 1.0)], "result_id string, block_id_1 string, block_id_2 string, analysis_type string, score double")
    assert store.save_results("md5_duplicate", one) and not store.save_results("md5_duplicate", one)
    assert not store.save_results("semantic_similarity", one)
    assert [r["result_id"] for r in store.results("md5_duplicate", min_score=0.5).collect()] == ["r2"]
    assert store.results("md5_duplicate", block_id="b").count() == 1
    decided = spark.createDataFrame([("r1", "a", "b", "md5_duplicate", "undecided"), ("r2", "a", "c", "md5_duplicate", "keep")], "decision_id string, block_id_1 string, block_id_2 string, analysis_type string, decision string").withColumns({"decided_at": F.current_timestamp(), "notes": F.lit(None).cast("string")})
    assert store.upsert("pair_decisions", decided)
    assert [r["result_id"] for r in store.undecided("md5_duplicate").collect()] == ["r1"]
    files = spark.createDataFrame([("/x/a.md",)], "path string")
    assert store.register_files(files).collect() == store.register_files(files).collect()


def test_similar_pairs_and_simhash(spark):
    rows = [("A", [1.0, 0.0, 0.0]), ("B", [0.9, 0.1, 0.0]), ("C", [0.0, 1.0, 0.0]), ("D", []), ("E", None)]
    got = semantic.similar_pairs(spark.createDataFrame(rows, "block_id string, embedding array<double>"), 0.85).collect()
    assert [(r["id_1"], r["id_2"]) for r in got] == [("A", "B")]
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([("1", " ".join(words)), ("2", " ".join(words[:-1])), ("3", "other words entirely"), ("4", None)], "block_id string, text string")
    prints = spark.createDataFrame([(b, h) for b, h in (("a", 0), ("b", 7), ("c", 7), ("d", -1), ("e", -(1 << 63)), ("f", 15))], "block_id string, simhash long")
    got = {tuple(r) for r in simhash.similar(prints, 3).collect()}
    value = {0, 7, -1, -(1 << 63), 15}
    far = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert got == {(x, y, far(x, y)) for x in value for y in value if x < y and far(x, y) <= 3} and len(got) >= 3
    assert ("b", "c", 0) in {tuple(r) for r in simhash.similar_blocks(prints, 3).collect()} and simhash.similar_blocks(prints, 3).count() == len(got) + 1
    assert simhash.fingerprints(docs.na.fill("")).count() == 4
    odd = [("F", [1.0, 0.0]), ("G", [1.0, float("nan"), 0.0]), ("H", [None, 1.0, 0.0]), ("I", [2.0, 0.0]), (None, [1.0, 0.0])]
    got = semantic.similar_pairs(spark.createDataFrame(rows + odd, "block_id string, embedding array<double>"), 0.85).collect()
    assert sorted((r["id_1"], r["id_2"]) for r in got) == [("A", "B"), ("F", "I")]


def test_simhash_keys_are_not_broadcast(spark):
    """Each fingerprint has twenty keys; Spark's measure of them is that of the fingerprints, so they must not go through the driver."""
    prints = spark.range(3000).select(F.col("id").cast("string").alias("block_id"), F.xxhash64("id").alias("simhash"))
    near = prints.limit(50).select(F.concat(F.lit("n"), "block_id").alias("block_id"), F.col("simhash").bitwiseXOR(F.lit(7)).alias("simhash"))
    found = simhash.similar(prints.unionByName(near), 3)
    assert found.count() == 50
    pairs = found.collect()
    assert len(pairs) == 50 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_rich_rendering_and_paths(spark):
    rows = [("Title", "heading", "H", None), ("Heading-3", "heading", "H", None), ("x", "list_item", "i", None), ("x", "code", "c", "py")]
    df = spark.createDataFrame(rows, "e string, block_type string, text string, language string").withColumn("metadata", F.map_filter(F.create_map(F.lit("element_type"), F.col("e"), F.lit("language"), F.col("language")), lambda k, v: v.isNotNull()))
    assert [r["m"] for r in df.select(render.rendered("rich").alias("m")).collect()] == ["# H", "### H", "- i", "```py\nc\n```"]
    path = spark.createDataFrame([("/in/s/a.b.md",), ("/else/c.md",)], "p string").select(render.output_path(F.col("p"), "/in", "/out").alias("o"))
    assert [r["o"] for r in path.collect()] == ["/out/s/a.b_deduped.md", "/out/c_deduped.md"]


def test_entry_has_oracles(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_pruned_pairs_are_exact_and_skip_blocks(spark):
    """Clustered vectors against all pairs: cells whose bounds stay below the threshold never meet."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    x = [(centres[k % 30] / np.linalg.norm(centres[k % 30]) + rng.choice((0.02, 0.05)) * rng.standard_normal(16)) * rng.uniform(0.1, 9) for k in range(1500)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000 + k, rng.standard_normal(3).tolist()) for k in range(60)] + [(9500, [0.0] * 16), (9501, [1e300] * 16), (9502, [2e300] * 16)]
    df = spark.createDataFrame(rows, "block_id long, embedding array<double>")
    plan = semantic.planned(semantic.usable(df, "block_id"), 0.9, block=40)
    met, every = plan.counts()
    assert 0 < met < every / 2
    want = set()
    unit = {}
    for k, v in rows:
        m = np.array(v) / max(np.abs(v).max(), 1e-300)
        unit[k] = m / max(np.sqrt(m @ m), 1e-12)
    for size in (3, 16):
        ids = [k for k, v in rows if len(v) == size]
        m = np.stack([unit[k] for k in ids])
        a, b = np.nonzero(np.triu(m @ m.T >= 0.9, 1))
        want |= {(ids[i], ids[j]) for i, j in zip(a, b)}
    got = semantic.similar_pairs(df, 0.9, block=40).collect()
    assert {(r["id_1"], r["id_2"]) for r in got} == want and len(got) == len(want) > 5000
    assert semantic.similar_pairs(df.limit(0), 0.9).count() == 0
    # vectors spread evenly can't be told apart, and none may be lost
    even = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((400, 16)))], df.schema)
    assert semantic.similar_pairs(even, 0.5, block=50).count() == semantic.similar_pairs(even, 0.5).count() > 0


def test_copies_of_a_vector_do_not_grow_with_rows(spark, monkeypatch):
    """Four times the rows make larger blocks, not more of them; tiles of a block pair lose nothing, and floats are no doubles' loss."""
    import numpy as np

    monkeypatch.setattr(semantic, "BLOCK", 20)
    monkeypatch.setattr(semantic, "BLOCKS", 4)
    monkeypatch.setattr(semantic, "TILE", 7)
    x = np.random.default_rng(3).standard_normal((800, 8)).astype(np.float32)
    for n in (200, 800):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:n])], "block_id long, embedding array<float>")
        plan = semantic.planned(semantic.usable(df, "block_id"), 0.6, block=semantic.block_rows(n))
        assert 4 <= sum(plan.many.values()) <= 16
        u = x[:n].astype(float) / np.linalg.norm(x[:n].astype(float), axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(u @ u.T >= 0.6, 1))
        got = semantic.similar_pairs(df, 0.6).collect()
        assert sorted((r["id_1"], r["id_2"]) for r in got) == sorted(zip(a.tolist(), b.tolist()))
        assert all(abs(r["score"] - u[r["id_1"]] @ u[r["id_2"]]) < 1e-12 for r in got)


def _decisions(spark, rows):
    return spark.createDataFrame([(p, "b", "text", d) for p, d in rows], "path string, block_id string, block_type string, decision string").withColumn("decided_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))


def _state(rows):
    return {r["path"]: r["decision"] for r in rows.collect()}


def test_store_versions_and_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path), ranges=4)
    first = {f"p{k}": "keep" for k in range(40)}
    assert store.upsert("block_decisions", _decisions(spark, first.items()))
    assert not store.upsert("block_decisions", _decisions(spark, [("p1", "keep")]))
    assert store.upsert("block_decisions", _decisions(spark, [("p1", "delete"), ("p1", "delete"), ("new", "keep"), ("", "keep")]))
    assert store.upsert("block_decisions", _decisions(spark, [("p1", "undecided"), ("p1", "delete")]))  # of one key the greatest values stay
    assert _state(store.read("block_decisions")) == first | {"p1": "undecided", "new": "keep"}
    assert _state(store.read("block_decisions", version=1)) == first and _state(store.read("block_decisions", version=2))["p1"] == "delete"
    assert [tuple(r)[:2] for r in store.history("block_decisions").orderBy("version").collect()] == [(1, "upsert"), (2, "upsert"), (3, "upsert")]
    # a row's key range alone is read, and what it goes with stays as it is
    assert len(store.read("block_decisions", key="p7").inputFiles()) < len(store.read("block_decisions").inputFiles())
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "block_decisions/data").rglob("*.parquet")}
    assert store.upsert("block_decisions", _decisions(spark, [("p2", "delete")]))
    assert {p: p.stat().st_mtime_ns for p in before} == before and store._log("block_decisions").entries()[-1]["rows"] == 1
    want = _state(store.read("block_decisions"))
    assert store.compact("block_decisions", 2) and not store.compact("block_decisions", 2)
    assert _state(store.read("block_decisions")) == want and _state(store.read("block_decisions", version=1)) == first
    store.vacuum("block_decisions")
    assert _state(store.read("block_decisions")) == want


def test_two_writers_of_one_store(spark, tmp_path):
    """Of two writers of one version one goes on from what the other wrote, and nothing is lost."""
    from concurrent.futures import ThreadPoolExecutor

    a, b = Store(spark, str(tmp_path), ranges=2), Store(spark, str(tmp_path), ranges=8)
    log = a._log("block_decisions")
    entry = {"version": 1, "operation": "upsert", "segment": "x", "ranges": [], "replaces": False, "rows": 0, "of": 2}
    log.fs.mkdirs(log.path(f"{tmp_path}/other/log"))
    other = a._log("other")
    assert other.commit(entry) and not other.commit(entry | {"segment": "y"}) and [e["segment"] for e in other.entries()] == ["x"]
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(s.upsert, "block_decisions", _decisions(spark, [(f"{n}{k}", "keep"), ("both", n)])) for k in range(2) for n, s in (("a", a), ("b", b))]
        for j in jobs:
            j.result()
    got = _state(a.read("block_decisions"))
    assert set(got) == {"a0", "a1", "b0", "b1", "both"} and got["both"] in "ab"
    assert [e["version"] for e in log.entries()] == list(range(1, len(log.entries()) + 1)) and len({e["of"] for e in log.entries()}) == 1
    # a commit that another writer has overtaken in the same range starts again from there
    seen = []
    real = log.__class__.commit

    def late(self, entry):
        if not seen:
            seen.append(1)
            assert b.upsert("block_decisions", _decisions(spark, [("a0", "delete")]))
        return real(self, entry)

    log.__class__.commit = late
    try:
        assert a.upsert("block_decisions", _decisions(spark, [("a0", "undecided")]))
    finally:
        log.__class__.commit = real
    assert _state(a.read("block_decisions"))["a0"] == "undecided"


def _elements(spark, text):
    files = spark.createDataFrame([("f", "p.md", text)], "file_id string, path string, content string")
    return [(r["element_type"], r["raw_text"]) for r in src.split_markdown(files).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("````\n```\ninner\n```\n````\nafter", [("CodeSnippet", "````\n```\ninner\n```\n````"), ("Text", "after")]),
        ("~~~\n# no title\n```\n~~~~\n# T", [("CodeSnippet", "~~~\n# no title\n```\n~~~~"), ("Title", "# T")]),
        ("```a`b\ntext", [("Text", "```a`b\ntext")]),
        ("```py\nx\n``` not closed\ny", [("CodeSnippet", "```py\nx\n``` not closed\ny")]),
        ("a\n```\nx\n```\n```\ny\n```", [("Text", "a"), ("CodeSnippet", "```\nx\n```"), ("CodeSnippet", "```\ny\n```")]),
        ("Big\n===\n\ntwo\nlines\n---\n---\nx", [("Title", "Big"), ("Title", "two\nlines"), ("Text", "---\nx")]),
        ("p\n    still p\n\n    code\n\tmore\n\nq", [("Text", "p\n    still p"), ("CodeSnippet", "    code\n\tmore"), ("Text", "q")]),
        ("- a\n- b\n\n    of b\n\n1. c", [("ListItem", "- a"), ("ListItem", "- b"), ("Text", "    of b"), ("ListItem", "1. c")]),
        ("| a |\n|---|\n| b |\nx", [("Table", "| a |\n|---|\n| b |"), ("Text", "x")]),
        ("", []),
        ("\r\n \r\n# A\r\nb\r\n", [("Title", "# A"), ("Text", "b")]),
        ("   ```\nx\n    ```\ny\n   ```", [("CodeSnippet", "   ```\nx\n    ```\ny\n   ```")]),
    ],
)
def test_markdown_elements(spark, text, want):
    assert _elements(spark, text) == want


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_merging_is_the_plain_loop(spark, gap):
    """merge_code_blocks() against fold() over files of random blocks, multi-line and odd ones among them."""
    import random

    rng = random.Random(gap)
    texts = [FENCE, FENCE, FENCE + "python", "```py\nx = 1\n", "x", " y", "\n", "", "  ", "a_", "_b", "z\n```", "```\npython", "```js\ncode\n```", " ``` ", "é1\r\n", "中", "l1\u2028```", "w\x85", "\n```ruby", None]
    rows = []
    for f in range(150):
        for i in range(rng.randint(0, 12)):
            rows.append({"file_id": f"f{f}", "pos": i // 2 if f % 9 == 0 else i, "block_id": f"b{i:02d}", "block_type": rng.choice(("code", "code", "code", "code", "text", "heading")), "text": rng.choice(texts), "token_count": rng.randint(0, 5)})
    want = []
    for f in {r["file_id"] for r in rows}:
        own = sorted((r for r in rows if r["file_id"] == f), key=lambda r: (r["pos"], r["block_id"]))
        out, members = merge.fold([r | {"status": "undecided", "char_count": len(r["text"] or ""), "language": None, "merged_into": None} for r in own], gap)
        want += [*out, *members]
    df = spark.createDataFrame([(r["file_id"], r["pos"], r["block_id"], r["block_type"], r["text"], r["token_count"]) for r in rows], "file_id string, pos int, block_id string, block_type string, text string, token_count long")
    got = [r.asDict() for r in merge.merge_code_blocks(df, gap).collect()]
    columns = ["file_id", "pos", "block_id", "block_type", "text", "status", "char_count", "token_count", "language", "merged_into"]
    as_rows = lambda rs: sorted(str([r[c] for c in columns]) for r in rs)
    assert as_rows(got) == as_rows(want) and len(got) > len(rows)
    assert merge.merge_code_blocks(df.limit(0)).count() == 0


def test_scans_read_what_has_changed(spark, tmp_path):
    import os
    from datetime import datetime

    from gristmill.sources import scans

    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    for name, text in (("a.md", "one"), ("b.md", "one"), ("sub/c.md", "two"), ("d.txt", "no")):
        (top / name).write_text(text)
    log = scans.ScanLog(spark, f"{tmp_path}/log", seconds=600, days=2)
    at = lambda day, minute: datetime(2024, 1, day, 10, minute)
    assert log.recent(str(top), at(1, 0)).count() == 0
    first = {r["path"]: r["digest"] for r in log.scan(str(top), now=at(1, 0)).collect()}
    assert set(first) == {f"{top}/{n}" for n in ("a.md", "b.md", "sub/c.md")} and first[f"{top}/a.md"] == first[f"{top}/b.md"]
    # what changes without size and time doing so isn't seen, so it wasn't read; what changes in either is
    kept = os.stat(top / "a.md")
    (top / "a.md").write_text("eno")
    os.utime(top / "a.md", ns=(kept.st_atime_ns, kept.st_mtime_ns))
    (top / "b.md").write_text("other")
    (top / "sub/c.md").unlink()
    (top / "e.md").write_text("two")
    assert {r["path"]: r["digest"] for r in log.scan(str(top), now=at(1, 5)).collect()} == first  # still fresh
    second = {r["path"]: r["digest"] for r in log.scan(str(top), now=at(1, 20)).collect()}
    assert set(second) == {f"{top}/{n}" for n in ("a.md", "b.md", "e.md")}
    assert second[f"{top}/a.md"] == first[f"{top}/a.md"] and second[f"{top}/b.md"] != first[f"{top}/b.md"] and second[f"{top}/e.md"] == first[f"{top}/sub/c.md"]
    assert {r["scanned_at"] for r in log.recent(str(top), at(1, 25)).collect()} == {at(1, 20)}
    assert log.scan(str(top), now=at(1, 21), fresh=False).count() == 3
    (top / "f.md").write_text("two")
    third = log.scan(str(top), now=at(2, 0))
    assert sorted(r["path"] for r in scans.copies(third).collect()) == [f"{top}/e.md", f"{top}/f.md"]
    assert scans.copies(third, f"{top}/a.md").count() == 0 and scans.copies(third, f"{top}/e.md").count() == 2
    (tmp_path / "none").mkdir()
    assert log.scan(f"{tmp_path}/none", now=at(2, 0)).count() == 0 and log.recent(f"{tmp_path}/none", at(2, 1)).count() == 1
    assert log.expire(at(3, 0)) == 0 and log.expire(at(4, 0)) == 1 and {r["day"].day for r in log.rows().select("day").distinct().collect()} == {2}
    gone = spark.createDataFrame([(f"{top}/no.md", 1)], "path string, size int")
    assert [r["digest"] for r in scans.digests(gone).collect()] == [None]


def test_changes_of_hard_listings(spark):
    from datetime import datetime

    from gristmill.sources import scans

    t = [datetime(2024, 1, k) for k in (1, 2)]
    shape = "path string, size long, modified timestamp"
    before = spark.createDataFrame([("a", 1, t[0]), ("a", 1, t[0]), ("b", None, None), ("c", 1, t[0]), (None, 1, t[0]), ("d", 1, t[0]), ("e", 2, t[1]), ("e", 1, t[0])], shape)
    after = spark.createDataFrame([("a", 1, t[0]), ("b", None, None), ("c", 1, t[1]), (None, 2, t[0]), ("e", 2, t[1]), ("f", 0, None)], shape)
    assert {tuple(r) for r in scans.changes(before, after).collect()} == {("a", "unchanged"), ("b", "unchanged"), ("c", "changed"), ("d", "gone"), ("e", "unchanged"), ("f", "new")}
