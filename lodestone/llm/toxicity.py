"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Texts are folded first: lower case, look-alike letters of other scripts and digits inside words as the Latin letters they stand
for, marks that hide letters dropped, letters that signs pull apart joined; words with accents are also tried without them.  The lexicon (whole words and word beginnings, each with a log-odds
weight) is learned from labelled rows; matches inside an exception phrase do not count.  A logistic function of the
matched weight, also normalised by length, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: At most so many labelled rows are learned from, those with the least hashes of their ids.
SAMPLE_ROWS = 12_000
#: At most so many candidate terms are weighed, those in the most toxic rows.
CANDIDATES = 20_000
#: A term of the lexicon has at least this log-odds weight, and is in this share of the toxic rows (and in 3 at least).
MIN_WEIGHT, MIN_SHARE = 3.0, 0.004
#: Words with accents whose weight a worker remembers.
REMEMBERED = 200_000
#: Lengths of the word beginnings that are weighed beside whole words.
STEMS = range(4, 10)

# Letters of other scripts that look like Latin ones, and what digits and signs stand for inside words.
# l, 1 and | all become i, in texts and terms alike.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "i", "l": "i", "|": "i",
}
STROKES = {"ø": "o", "đ": "d", "ħ": "h", "ł": "i", "ŧ": "t"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
HIDDEN = "­​‌‍⁠﻿"
#: Phrases whose words are harmless in them.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "pond scum", "idiot proof", "sore loser rule", "scum line")


class _Fold(dict):
    """For str.translate: letters folded, hidden marks dropped, all else a space; found once for each character."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if c in HIDDEN:
            out: str | None = None
        else:
            if 0xFF01 <= code <= 0xFF5E:  # full-width forms
                c = chr(code - 0xFEE0)
            c = c.lower()
            c = HOMOGLYPHS.get(c, c)
            c = DIGITS.get(c, c)
            out = "".join(x if x.isalnum() or unicodedata.combining(x) else " " for x in c)
        self[code] = out
        return out


_FOLD = _Fold()


#: Four or more single letters with the same sign between each two: a word that was pulled apart.
_APART = re.compile(r"(?<!\w)\w([.\-_*·])\w(?:\1\w){2,}(?!\w)")


#: What each of them holds; quick to rule out.
_SIGNS = re.compile(r"([.\-_*·])\w\1\w\1\w")


def fold(text: str | None) -> str:
    """The folded text: words with one space before and after each; letters that signs pull apart (i.d.i.o.t) are one word."""
    joined = text or ""
    if _SIGNS.search(joined):
        joined = _APART.sub(lambda m: m[0].replace(m[1], ""), joined)
    return " " + " ".join(joined.translate(_FOLD).split()) + " "


_MARKED = re.compile(r"\S*[^\x00-\x7f\s]\S*")


def bare(word: str) -> str:
    """A folded word without accents and strokes, folded once more."""
    letters = (STROKES.get(c, c) for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return fold("".join(letters)).strip()


@dataclass
class Model:
    """Terms (" word " or " beginning") with weights, and the logistic function's coefficients."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-2.0, 1.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)
    _bare: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_bare": {}}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                a.add_word(term, (weight, len(term)))
            for phrase in self.exceptions:
                a.add_word(folded := fold(phrase), (None, len(folded)))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """Matched weight, damped, and matched weight for each hundred words."""
        words = fold(text)
        if not self.terms or len(words) < 3:
            return 0.0, 0.0
        spared, hits = [], []
        for end, (weight, length) in self.automaton().iter(words):
            if weight is None:
                spared.append((end - length + 1, end))
            else:
                hits.append((end - length + 1, weight))
        if spared:
            hits = [(at, w) for at, w in hits if not any(a <= at <= z - 1 for a, z in spared)]
        # words that only match without their accents; accents that a language has of its own do not hide a match
        total = sum(w for _, w in hits)
        if not words.isascii():
            total += sum(map(self._bare_weight, set(_MARKED.findall(words))))
        return math.log1p(total), math.log1p(100 * total / words.count(" "))

    def _bare_weight(self, word: str) -> float:
        """What a word with accents weighs without them, if it weighs nothing with them; remembered for many words."""
        found = self._bare.get(word)
        if found is None:
            found = 0.0 if self._weight(word) else self._weight(bare(word))
            if len(self._bare) >= REMEMBERED:
                self._bare.clear()
            self._bare[word] = found
        return found

    def _weight(self, word: str) -> float:
        return sum(weight for _, (weight, _) in self.automaton().iter(f" {word} ") if weight is not None)

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return 0.0 if a == -math.inf else 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def terms_of(text: str | None) -> set[str]:
    """The distinct words of a text, and their beginnings."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if len(w) > n)
    return out


def _count(known: frozenset[str] | None):
    """Document counts of terms, reduced within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                counts.update(found if known is None else found & known)
        items = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["term", "n"])
    return run


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weighed terms: the strongest first, and none that a shorter chosen beginning already covers."""
    least = max(3, MIN_SHARE * n_toxic)
    weights = {
        t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))
        for t, n in toxic.items() if n >= least
    }
    chosen: dict[str, float] = {}
    for term in sorted((t for t, w in weights.items() if w >= MIN_WEIGHT), key=lambda t: (len(t.rstrip()), t)):
        if not any(term[:n] in chosen for n in range(len(term))):
            chosen[term] = min(weights[term], 8.0)
    return chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression of labels on two features by Newton's method, with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(3)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic) and their texts in ``docs`` (doc_id, text).

    Null ids and null labels are left out; of rows that repeat an id the greatest label counts, for each of that id's texts.  With no toxic
    or no clean rows there is nothing to tell texts apart by: the model has no terms and scores every text 0 (no text is called toxic
    without evidence), also where ``labels`` or ``docs`` are empty.
    """
    common.prepare(docs.sparkSession)
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = common.cut(common.texts(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic"))
    sizes = {int(r.toxic): r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, coefficients=(-math.inf, 0.0, 0.0))
    counted = lambda part, known: part.select("text").mapInArrow(_count(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    top = counted(rows.where("toxic = 1"), None).where(F.col("n") >= max(3, MIN_SHARE * n_toxic)).orderBy(F.desc("n"), "term").limit(CANDIDATES)
    toxic = {r.term: r.n for r in top.collect()}
    clean = {r.term: r.n for r in counted(rows.where("toxic = 0"), frozenset(toxic)).collect()}
    model = Model(choose(toxic, clean, n_toxic, n_clean))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in x]), pa.array([v for _, v in x]), batch.column("toxic").cast(pa.int32())], names=["x", "y", "toxic"])

    got = rows.mapInArrow(measure, "x double, y double, toxic int").toArrow()
    table = np.column_stack([got["x"].to_numpy(), got["y"].to_numpy(), got["toxic"].to_numpy()])
    table = table[np.lexsort(table.T)]
    model.coefficients = fit(table[:, :2], table[:, 2])
    return model


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id, as text, is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, score.  Null and empty texts get the score of no match; other columns are ignored."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["k", "score"])

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("k", key)


def scorer(spark: SparkSession, model: Model):
    """The model's score as a column function of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores by a model that learns from ``labels`` only where the row is not held out: key, held_out, score, predicted."""
    model = train(docs.select(F.col(key).alias("doc_id"), "text"), labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model, key)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
