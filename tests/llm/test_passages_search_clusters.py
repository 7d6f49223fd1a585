"""Passage removal, lexical search and clustering against plain loops, and on hard rows."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import delta_lloyd, lexical_search, passages

DOCS = "doc_id long, text string, n_words string, kept long, digest string"
LONG = "word " * 20_000


def key(rows):
    return sorted(map(str, rows))


def naive_passages(rows, window):
    """n_words, n_removed, kept text of each row, by a dictionary of all windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            if doc is not None:
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window, busy", [(5, 2), (5, 10_000), (12, 3), (1, 2)])
def test_passages(spark, window, busy):
    rng = random.Random(window)
    shared = [[f"s{k}_{i}" for i in range(20)] for k in range(3)]
    rows = []
    for doc in range(120):
        words = [rng.choice(("a", "é", "B\x1c", "😀")) for _ in range(rng.randint(0, 12))]
        words += rng.choice(shared)[rng.randint(0, 6) : rng.randint(10, 20)] + [f"own{doc}"] + words[:7]
        rows.append((doc * 7 - 30, rng.choice((" ", "\n", " \t")).join(words)))
    rows += [(5000, LONG), (5001, LONG), (5002, None), (5003, ""), (5004, " \n"), (None, rows[0][1]), (None, None), (rows[3][0], rows[4][1]), rows[5], rows[5], (5005, " " + rows[9][1] + " ")]
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], DOCS)
    got = passages.without_repeats(docs, window, busy).collect()
    assert key((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == key(naive_passages(rows, window))
    for r in got:
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] and all(a["end"] < b["begin"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_copies_of_a_busy_piece_go_whole(spark):
    """A range for each piece of a later copy, not for each of its windows; only first and differing pieces are cut."""
    rng, copies = random.Random(6), 40
    words = [f"w{i}" for i in range(80)]
    exact = [(d, " ".join(words)) for d in range(copies)]
    near = [(100 + d, " ".join(words[:k] + [f"own{d}"] + words[k + 1 :])) for d in range(copies) for k in [rng.randrange(80)]]
    found = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.unhex(F.md5("text")))
    pieces = len(passages.Cutter(12).pieces([exact[0][1]])[1])
    assert pieces * 2 < 80 - 11
    got = passages.removed_ranges(found(exact), 12, 2).collect()
    assert len(got) == (copies - 1) * pieces and {r["doc_id"] for r in got} == set(range(1, copies))
    # pieces that repeat in one document, and two rows of the first document's doc_id, of which one has the windows of the other
    rows = exact + near + [(7, exact[0][1] + " " + exact[0][1]), (0, "before " + exact[0][1] + " " + exact[0][1]), (500, near[5][1]), (-3, near[9][1])]
    got = passages.without_repeats(found(rows), 12, 2).collect()
    assert key((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == key(naive_passages(rows, 12))


def test_near_copies_of_a_busy_piece_are_not_cut_into_windows(spark, monkeypatch):
    """Pieces that differ are cut by longer and longer cores: few rows and ranges for very many windows, and nothing is lost."""
    rng, copies, made = random.Random(9), 90, []
    words = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join("own%d" % d if i in own else w for i, w in enumerate(words))) for d in range(copies) for own in [rng.sample(range(300), 2)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.unhex(F.md5("text")))
    pieces = passages.Cutter().pieces([t for _, t in rows])[3]
    assert passages.removed_ranges(docs, busy=8).count() < 2 * len(pieces) < pieces.sum() / 10
    cut = passages.finer
    monkeypatch.setattr(passages, "finer", lambda p, span, window: (made.append((span, p.count(), cut(p, span, window).count())), cut(p, span, window))[1])
    got = passages.without_repeats(docs, busy=8).collect()
    assert key((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == key(naive_passages(rows, 50))
    assert [span for span, _, _ in made] == [16, 4] and all(out <= 4 * n for _, n, out in made) and sum(out for _, _, out in made) < pieces.sum() / 10


@pytest.mark.parametrize("window, span", [(50, 16), (50, 4), (50, 1), (12, 4), (9, 1)])
def test_finer_pieces(spark, window, span):
    """Every window is in one of the finer pieces, and equal windows come under one hash, also where words repeat."""
    rng = random.Random(window + span)
    base = [rng.choice("ab") for _ in range(70)] + ["w"] * 80 + ["x", "y"] * 45 + [f"n{i}" for i in range(100)]
    rows = []
    for doc in range(8):
        words = base[rng.randrange(60) :] + [f"own{doc}"] + base[: rng.randrange(60, 200)]
        data, _, at, many, keys, begin, end = passages.Cutter(window).pieces([" ".join(words)])
        rows += [(doc, b"k", int(a), int(n), data[b:e], int(k)) for a, n, b, e, k in zip(at, many, begin, end, keys.view(np.int64))]
    cut = passages.finer(spark.createDataFrame(rows, passages._PIECE), span, window).collect()
    opened = lambda rows: [(d, a + i, tuple(w[i : i + window]), k) for d, _, a, n, p, k in rows for w in [bytes(p).split()] for i in range(n) if len(w) == n + window - 1]
    assert sorted(x[:3] for x in opened(cut)) == sorted(x[:3] for x in opened(rows))
    assert max(r["windows"] for r in cut) == span
    of = {}
    for _, _, w, k in opened(cut):
        assert of.setdefault(w, k) == k
    assert len(of) < len(opened(cut))


def test_passages_of_no_rows_and_of_short_texts(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1, ""), (2, "a b", "", 1, "")], DOCS)
    assert key((r["doc_id"], r["kept"]) for r in passages.without_repeats(docs).collect()) == key([(1, "a b"), (2, "a b")])
    assert passages.without_repeats(docs.limit(0)).count() == 0


def test_equal_hashes_of_different_windows(monkeypatch):
    """Windows that hash alike are told apart by their bytes."""
    monkeypatch.setattr(passages.Rolling, "__call__", lambda self, v: np.zeros(max(0, len(v) - self.size + 1), np.uint64))
    pieces = [(3, "a b c d"), (1, "x b c"), (2, "b c d"), (5, "x b c"), (4, "z z z")]
    table = pa.table({"doc_id": [d for d, _ in pieces], "digest": [b"k"] * 5, "start": [10] * 5, "windows": [len(t.split()) - 2 for _, t in pieces], "packed": [t.encode() for _, t in pieces]})
    got = passages.sorted_bucket(3)(table).to_pylist()
    assert [(r["doc_id"], r["begin"], r["end"]) for r in got] == [(3, 11, 14), (5, 10, 13)]


def naive_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(d, cut(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(cut(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, w in texts:
            score = 0
            for t in terms:
                tf, df = w.count(t), sum(t in x for _, x in texts)
                if tf:
                    m = 100 - 25 + ((25 * len(w) * n) // total)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("window, block", [(16_384, 1024), (7, 2)])
def test_search(spark, monkeypatch, window, block):
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    rng = random.Random(4)
    words = ["a", "B", "b2", "é", "É", "中文", "😀x", "c-d", "e_f", "~", "w1", "W2", "zz", "ß"]
    docs = [(rng.choice((None, 7, 7, *range(-20, 60))), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(90)]
    docs += [(1, None), (2, ""), (3, "!!"), (5, "A a " * 5000)]
    items = [(1, "a É 😀x a a"), (2, "nothing here known: q"), (3, None), (4, "c d e F zz"), (4, "zz W1"), (None, "b2 中文"), (6, ""), (7, "ß~ß")]
    d = spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id long, text string, score long, rank long")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    assert key(tuple(r) for r in lexical_search.ranked(d, i, 6, block).collect()) == key(naive_search(docs, items, 6))
    assert lexical_search.ranked(d.limit(0), i).count() == 0 and lexical_search.ranked(d, i.limit(0)).count() == 0
    assert lexical_search.ranked(d.where("text IS NULL OR text IN ('', '!!')"), i).count() == 0


def naive_lloyd(rows, k, rounds, dimensions, seed):
    most = delta_lloyd.LARGEST
    kept = [(i, [max(-most, min(most, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners) if o == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, *reversed(near(v))) for i, v in kept] if centroids else [], centroids


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 1), (5, 0), (40, 4)])
def test_clusters(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.choice((rng.uniform(-1, 1), rng.gauss(i % 4, 0.1), 0.5)) for _ in range(3)]) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(300, 330)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0]), (404, [1.0, float("nan"), 0.0]), (405, [float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (7, [9.0, 9.0, 9.0]), (8, [1e300, -1e300, 0.0]), (9, rows[9][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    got, centroids = delta_lloyd.clusters(table, k, rounds, dimensions=3)
    want, want_centroids = naive_lloyd(rows, k, rounds, 3, 3)
    assert key(tuple(r) for r in got.select("vec_id", "cluster", "distance").collect()) == key(want) and centroids == want_centroids
    none, centroids = delta_lloyd.clusters(table.limit(0), k, rounds, dimensions=3)
    assert none.count() == 0 and centroids == []


def test_a_round_meets_only_what_has_changed():
    rng = np.random.default_rng(2)
    x, old = rng.integers(-9, 9, (300, 4)), rng.integers(-9, 9, (6, 4))
    owner, distance = delta_lloyd.reassigned(x, np.full(300, -1), np.zeros(300, np.int64), old, np.ones(6, bool))
    new = old.copy()
    new[[1, 4]] += 1
    changed = np.array([0, 1, 0, 0, 1, 0], bool)
    got = delta_lloyd.reassigned(x, owner, distance, new, changed)
    all_ = ((x[:, None] - new[None]) ** 2).sum(2)
    assert (got[0] == all_.argmin(1)).all() and (got[1] == all_.min(1)).all()
    assert (owner == got[0]).any() and (owner != got[0]).any()


def test_queries(spark, tmp_path):
    """The registered queries' digests, from the operators' own outputs."""
    rng = random.Random(8)
    text = " ".join(f"w{i}" for i in range(70))
    docs = [(1, text, "q"), (2, "before it " + text + " after", None), (3, None, "q"), (9, text, "q")]
    spark.createDataFrame(docs, "doc_id long, text string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, n, g, hashlib.sha256(kept.encode()).hexdigest()) for d, n, g, kept in naive_passages([r[:2] for r in docs], 50)]
    assert key(tuple(r) for r in passages.query(spark, str(tmp_path)).collect()) == key(want)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, centroids = naive_lloyd(rows, 8, 10, 64, 3)
    sums = {c: sum(d for _, o, d in found if o == c) for c in range(8)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert key(tuple(r) for r in delta_lloyd.query(spark, str(tmp_path)).collect()) == key((i, c, d, sums[c], sum(sums.values()), digest[c]) for i, c, d in found)
