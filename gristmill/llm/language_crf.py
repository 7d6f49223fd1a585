"""Language identification with a linear-chain conditional random field over words.

Words are the runs of letters of a text, by white space or without it; a run too long for a word, as in scripts that don't
part words, is cut into consecutive pieces, each a word here, so that every letter of a text counts.  A word's features are its prefixes and suffixes, its character n-grams, the word itself and the learned lexicons that it is
in.  Emission weights and transitions are learned together by gradient steps on the log-likelihood of code-switched
sequences, spliced from documents of known language.  Forward-backward gives every word's label distribution; a document's
language has the largest mean probability over its words with a letter.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices, table

UNDETERMINED = "und"
#: Bounds of the labelled sample that a model is fitted on: languages (the most frequent ones), documents of all languages
#: together (in equal parts) and of one, code points of a document, and words of the spliced training sequences.
LANGUAGES, DOCUMENTS, PER_LANGUAGE, LONGEST, TRAINED = 100, 8_000, 400, 20_000, 800_000
DIMENSIONS = 1 << 17
LEXICON = 50_000
_RUNS = re.compile(r"[^\W\d_]+").findall
#: Letters of the longest word; a longer run is cut into pieces of PIECE letters, about as many as a common word has.
WIDEST, PIECE = 40, 8
#: What stands inside a word unseen: soft hyphen, joiner and non-joiner, word joiner.
_UNSEEN = "\u00ad\u200c\u200d\u2060"
_EDGE = string.punctuation + string.digits
#: Words (and 32 code points of tokens) that a worker's cache holds before it starts anew, padded words that are scored at once, words whose features
#: are held at once, and code points of the texts that are taken apart at once (a longer text alone).
CACHE, BLOCK, SLICE, CHUNK = 300_000, 300_000, 10_000, 2_000_000


def pieces(token: str) -> list[str]:
    """The token's words in lower case: its runs of letters in turn, whole or in pieces; marks on letters are left out."""
    token = token.lower()
    core = token.strip(_EDGE)
    if core.isalpha():  # a single run
        found = [core]
    else:
        if not token.isascii():
            token = "".join(c for c in token if c not in _UNSEEN and unicodedata.category(c)[0] != "M")
        found = _RUNS(token)
    out = []
    for run in found:
        if len(run) > WIDEST:
            out += [run[i : i + PIECE] for i in range(0, len(run), PIECE)]
        else:
            out.append(run)
    return out if core and found[:1] == [core] else [w for w in out if any(map(str.isalpha, w))]


def _hashed(kind: int, *points: np.ndarray) -> np.ndarray:
    """A feature's place from its kind and code points."""
    h = np.full(points[0].shape, kind, np.uint64)
    for p in points:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(DIMENSIONS - 1)).astype(np.int32)


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Hashed features of each word of letters, one row each, filled up with DIMENSIONS; none for the empty word.

    The word (of WIDEST letters at most) itself, its lexicons, its first and last 1 to 4 letters, and its pairs and triples of
    letters with a mark at either end.
    """
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    tails = [w[:-5:-1] for w in words]
    first = np.array(words, f"U{WIDEST}").view(np.uint32).reshape(n, WIDEST).astype(np.uint64)[:, : max(4, int(sizes.max(initial=0)))]
    last = np.array(tails, "U4").view(np.uint32).reshape(n, 4).astype(np.uint64)
    marked = np.zeros((n, first.shape[1] + 2), np.uint64)
    marked[:, 0] = ord("^")
    marked[:, 1:-1] = first
    marked[np.arange(n), sizes + 1] = ord("$")
    whole = np.fromiter((crc32(w.encode()) for w in words), np.uint64, n)
    listed = np.fromiter((lexicon.get(w, 0) for w in words), np.uint64, n)
    columns, valid = [_hashed(1, whole)[:, None], _hashed(2, listed)[:, None]], [np.ones((n, 2), bool)]
    for kind, letters in ((10, first), (20, last)):
        for k in (1, 2, 3, 4):
            columns.append(_hashed(kind + k, *letters.T[:k])[:, None])
        valid.append(sizes[:, None] >= np.arange(1, 5))
    for k in (2, 3):
        width = marked.shape[1] - k + 1
        columns.append(_hashed(30 + k, *(marked[:, i : i + width] for i in range(k))))
        valid.append(np.arange(width) <= (sizes + 2 - k)[:, None])
    ids = np.concatenate(columns, axis=1)
    ids[~(np.concatenate(valid, axis=1) & (sizes > 0)[:, None])] = DIMENSIONS
    return ids


def _sums(weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Emissions of each row of features."""
    there = ids < DIMENSIONS
    sizes = there.sum(1)
    out = np.zeros((len(ids), weights.shape[1]), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(weights[ids[there]], np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), axis=0)
    return out


def _chain(weight: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward weights (T, B, L) of sequences of label weights (T, B, L), each place's up to a factor.

    Weights and steps are at most 1; scales are taken out at every other place, between which nothing can vanish.
    """
    t, b, n = weight.shape
    one = np.ones((n, 1), weight.dtype)  # a product adds few labels up faster than a sum along them
    forward, backward = np.empty_like(weight), np.empty_like(weight)
    np.divide(weight[0], weight[0] @ one, out=forward[0])
    for i in range(1, t):
        f = forward[i]
        np.matmul(forward[i - 1], step, out=f)
        f *= weight[i]
        if i & 1:
            f /= f @ one
    backward[t - 1] = 1
    back, shortest = np.ascontiguousarray(step.T), int(lengths.min())
    for i in range(t - 2, -1, -1):
        z = backward[i]
        np.matmul(backward[i + 1] * weight[i + 1], back, out=z)
        if i & 1:
            z /= z @ one
        if i + 1 >= shortest:
            z[lengths <= i + 1] = 1
    return forward, backward


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, expected: bool = False):
    """Label distributions (B, T, L) of sequences padded at their end; with expected, also the sum of pair distributions.

    emissions: (B, T, L) log weights; beyond a sequence's length all distributions are of no meaning.
    """
    b, t, n = emissions.shape
    step = np.exp(transitions - transitions.max())
    weight = np.exp(emissions - emissions.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    forward, backward = _chain(weight, lengths, step)
    marginal = forward * backward
    marginal /= marginal.sum(2, keepdims=True)
    if not expected:
        return marginal.transpose(1, 0, 2), None
    live = np.arange(t)[None, :] < lengths[:, None]
    pairs = np.zeros((n, n))
    for i in range(1, t):
        p = forward[i - 1][:, :, None] * step * (weight[i] * backward[i])[:, None, :]
        p /= p.sum((1, 2), keepdims=True)
        pairs += p[live[:, i]].sum(0)
    return marginal.transpose(1, 0, 2), pairs


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray = None
    transitions: np.ndarray = None
    lexicon: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.cache: dict[str, int] = {}  # number of each token
        self.words: dict[str, int] = {"": 0}  # row of each word, 0 for none
        self.rows = np.ones((1, len(self.languages)), np.float32)  # the labels' weights, 1 at most
        self.first, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each token: first row, rows
        self.used, self.held = 1, 0

    def __getstate__(self):
        return self.languages, self.weights, self.transitions, self.lexicon

    def __setstate__(self, state):
        self.languages, self.weights, self.transitions, self.lexicon = state
        self.__post_init__()

    def _learn(self, new: list[str]) -> None:
        """Gives numbers to tokens, and rows to their words: a token's one word has the row of that word, several have rows in turn."""
        start = len(self.cache)
        self.cache.update(zip(new, range(start, start + len(new))))
        parts = [pieces(t) for t in new]
        words = sorted({w for p in parts for w in p}.difference(self.words), key=len)  # so that slices need little filling up
        several = [k for k, p in enumerate(parts) if len(p) > 1]
        at, end = self.used + len(words), self.used + len(words) + sum(len(parts[k]) for k in several)
        if len(self.rows) < end:
            rows = self.rows[: self.used]
            self.rows = np.zeros((2 * end, len(self.languages)), np.float32)
            self.rows[: self.used] = rows
        for k in range(0, len(words), SLICE):
            part = words[k : k + SLICE]
            found = _sums(self.weights, features(part, self.lexicon))
            self.rows[self.used + k : self.used + k + len(part)] = np.exp(found - found.max(axis=1, keepdims=True))
        self.words.update(zip(words, range(self.used, at)))
        row = self.words.__getitem__
        first = np.fromiter((row(p[0]) if p else 0 for p in parts), np.int64, len(parts))
        counts = np.fromiter((len(p) or 1 for p in parts), np.int64, len(parts))
        if several:
            self.rows[at:end] = self.rows[[row(w) for k in several for w in parts[k]]]
            sizes = counts[several]
            first[several] = at + np.cumsum(sizes) - sizes
        self.first, self.counts = np.concatenate([self.first, first]), np.concatenate([self.counts, counts])
        self.held += len(new) + end - at + sum(map(len, new)) // 32
        self.used = end

    def places(self, documents: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each document's words as rows of self.rows (row 0 for a token without a letter), and its tokens' numbers of them."""
        new = list(set().union(*documents).difference(self.cache)) if documents else []
        if self.held > CACHE:
            self.__post_init__()
            new = list(set().union(*documents))
        if new:
            self._learn(new)
        get, rows, sizes = self.cache.__getitem__, [], []
        for d in documents:
            tokens = np.fromiter(map(get, d), np.int64, len(d))
            first, counts = self.first[tokens], self.counts[tokens]
            total = int(counts.sum())
            rows.append(first if total == len(d) else np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total))
            sizes.append(counts)
        return rows, sizes

    def marginals(self, documents: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, distributions of its words, which words have a letter, words of each token) of each document that has tokens."""
        places, sizes = self.places(documents)
        order = sorted((k for k, p in enumerate(places) if len(p)), key=lambda k: len(places[k]))
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32) if order else None
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end + 1 - begin) * len(places[order[end]]) <= BLOCK:
                end += 1
            group = order[begin:end]
            lengths = np.array([len(places[k]) for k in group])
            padded = np.zeros((lengths[-1], len(group)), np.int64)
            for i, k in enumerate(group):
                padded[: lengths[i], i] = places[k]
            forward, backward = _chain(self.rows[padded], lengths, step)
            forward *= backward
            forward /= forward @ np.ones((len(self.languages), 1), np.float32)
            for i, k in enumerate(group):
                yield k, forward[: lengths[i], i], places[k] > 0, sizes[k]
            begin = end

    def labelled(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """What marginals() gives for each text with words, a bounded number of texts at a time."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end] or "") <= CHUNK):
                size += len(texts[end] or "")
                end += 1
            for k, *found in self.marginals([(t or "").split() for t in texts[begin:end]]):
                yield begin + k, *found
            begin = end


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 6, length: int = 60, switch: float = 1 / 15) -> Model:
    """A model of (text, language) rows.  `switch` is the chance that a training sequence changes language at a word."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([])
    of = {lang: k for k, lang in enumerate(languages)}
    pools: list[list[str]] = [[] for _ in languages]
    for text, lang in rows:
        pools[of[lang]] += [w for token in text.split() for w in pieces(token)]
    pools = [p or ["a"] for p in pools]
    counts = [Counter(p) for p in pools]
    listed: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        for w, n in c.most_common(max(1, LEXICON // len(languages))):
            if n >= 2:
                listed.setdefault(w, []).append(k)
    number: dict[tuple[int, ...], int] = {}  # of each set of lexicons, from 1 on
    lexicon = {w: number.setdefault(tuple(ks), len(number) + 1) for w, ks in listed.items()}
    words = sorted(set().union(*counts))
    place = {w: i for i, w in enumerate(words)}
    table_ = np.sort(features(words, lexicon), axis=1)
    width = int((table_ < DIMENSIONS).sum(1).max())
    table_ = table_[:, :width]
    streams = [np.fromiter(map(place.__getitem__, p), np.int64, len(p)) for p in pools]
    n, rng = len(languages), np.random.default_rng(seed)
    total = max(1, min(sum(map(len, streams)), TRAINED) // length)
    labels = np.empty((total, length), np.int64)
    labels[:, 0] = rng.integers(n, size=total)
    for t in range(1, length):
        labels[:, t] = np.where(rng.random(total) < switch, rng.integers(n, size=total), labels[:, t - 1])
    tokens = np.empty_like(labels)
    for k in range(n):
        at = np.flatnonzero(labels.ravel() == k)
        tokens.ravel()[at] = np.resize(np.roll(streams[k], rng.integers(len(streams[k]))), len(at))
    w, a = np.zeros((DIMENSIONS + 1, n)), np.zeros((n, n))
    gw, ga = np.full_like(w, 1e-8), np.full_like(a, 1e-8)
    size = 256
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(total), max(1, total // size)):
            x, y = tokens[batch], labels[batch]
            used, inverse = np.unique(x, return_inverse=True)
            f = table_[used]
            e = w[f].sum(1)[inverse.reshape(x.shape)]
            marginal, pairs = forward_backward(e, np.full(len(batch), length), a, expected=True)
            d = -marginal
            np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], 2) + 1, 2)
            flat = inverse.ravel()
            per_word = np.stack([np.bincount(flat, d[..., k].ravel(), len(used)) for k in range(n)], 1)
            touched, back = np.unique(f, return_inverse=True)
            spread = np.repeat(per_word, width, axis=0)
            g = np.stack([np.bincount(back.ravel(), spread[:, k], len(touched)) for k in range(n)], 1) / len(batch) - 1e-5 * w[touched]
            gw[touched] += g * g
            w[touched] += 0.3 * g / np.sqrt(gw[touched])
            w[DIMENSIONS] = 0
            seen = np.zeros((n, n))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g = (seen - pairs) / len(batch)
            ga += g * g
            a += 0.1 * g / np.sqrt(ga)
    return Model(languages, w.astype(np.float32), a, lexicon)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST, languages: int = LANGUAGES, documents: int = DOCUMENTS) -> list[tuple[str, str]]:
    """Rows (text, lang) by a hash of doc_id and text: of the `languages` most frequent ones, at most per_language of each and `documents` in all.

    Only texts of at most `longest` code points are taken.  Rows alike in doc_id, text and lang count once; other rows of one
    doc_id count each, and no more rows than the bound reach the driver.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    usable = usable.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("digest"), "text", "lang")
    known = usable.select("lang", "doc_id", "digest").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not known:
        return []
    most = max(1, min(per_language, documents // len(known)))
    shares = {r["lang"]: min(1.0, (1.3 * most + 20) / r["count"]) for r in known}
    point = F.pmod(F.xxhash64(F.lit("crf"), "doc_id", "digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("lang"))
    some = usable.where(F.col("lang").isin(*shares)).withColumn("point", point).where(F.col("point") < share).dropDuplicates(["lang", "doc_id", "digest"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("point", "doc_id", "digest"))  # of about the bound's rows
    rows = some.withColumn("place", place).where(F.col("place") <= most).select("text", "lang", "place").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["place"]))]


def predict(docs: DataFrame, model: Model, segments: bool = False) -> DataFrame:
    """docs (text and other columns) with lang_pred and score, replacing columns of those names; no rows give no rows.

    A null or empty text, or one without a letter, is 'und' with score 0; so is every text of a model without languages.
    Otherwise score is the mean probability of the predicted language over words with a letter.  With segments: runs of
    tokens (start, end, lang; by white space, end exclusive) of one most likely label, by the mean of a token's words.  Rows
    stand alone, repeated or not, and every letter of a text of any length counts.  Of two languages equally likely, the
    first in order is predicted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if segments:
        run_type = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
        added.append(T.StructField("segments", T.ArrayType(run_type)))
    names = {f.name for f in added}
    docs = docs.select(*(c for c in docs.columns if c not in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, 2 * CHUNK):
            texts = batch.column("text").to_pylist()
            langs, scores, runs = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for k, found, letters, counts in m.labelled(texts) if m.languages else ():
                if letters.any():
                    mean = found[letters].mean(0, dtype=np.float64)
                    best = int(mean.argmax())
                    langs[k], scores[k] = m.languages[best], min(1.0, float(mean[best] / mean.sum()))
                    if segments:
                        label = np.add.reduceat(found, np.cumsum(counts) - counts, axis=0).argmax(1)
                        cuts = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)]
                        runs[k] = [{"start": a, "end": b, "lang": m.languages[label[a]]} for a, b in zip(cuts, cuts[1:])]
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if segments:
                columns.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(f.name for f in added)])
        m.__post_init__()  # the model outlives the task in its worker; what it has cached need not

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *added]))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame) -> Model:
    """The model of the rows that aren't held out (those of a null doc_id aren't learned from)."""
    return fit(sample(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
