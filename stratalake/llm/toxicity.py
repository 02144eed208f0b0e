"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities and counts of lexicon words, as they stand and after undoing obfuscation (digits and
signs for letters, marks between letters); how near second-person words are; capitals; punctuation; obfuscation.  The
lexicon has two parts: a short fixed list, and the words with the highest log-odds among the labelled training rows, at
most ``LEARNED``.  Training reads at most ``TRAIN`` labelled rows; only their features come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .boosting import Trees, fit_trees, isotonic
from .labelled import fold, training_rows
from .store import bound_batches

TRAIN = 20_000
LEARNED = 64
NEAR = 5

# Common insults, and second-person words of English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool jerk hate kill shut ugly liar".split()
SECOND = "you your yours yourself ur du dich dir dein ihr euch tu te toi ton vous votre usted ustedes tú ti".split()
# Fixed pairs of signs and the letters they stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t"}

_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"'()[]{}<>*_-~|#%&/\\$^`=+@")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LEET = K.LOWER.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)

FEATURES = ["plain", "plain_density", "hidden", "hidden_density", "distinct", "second_density", "near", "near_density", "capitals", "shouted", "exclaims", "questions", "marks", "inner_marks", "leet", "symbols", "log_words", "word_length"]


class Hasher:
    """Hashes of single words in the form that a text's words get."""

    roll = K.Rolling(47)

    @classmethod
    def of(cls, words: list[str]) -> np.ndarray:
        data = [w.lower().encode() for w in words]
        end = np.cumsum([len(x) for x in data]).astype(np.int64)
        if not len(end):
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        return np.sort(cls.roll.ranges(cls.roll.prefix(raw), np.concatenate([[0], end[:-1]]), end))


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Documents x FEATURES."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    put = lambda name, x: out.__setitem__((slice(None), FEATURES.index(name)), x)
    w = K.Words(data, offsets)
    if not len(w.start):
        return out
    d, words = w.doc(), np.maximum(1, np.diff(w.bounds))
    per = lambda hit: np.bincount(d[hit], minlength=n)
    # bounds without marks at either end
    start, end = w.start.copy(), w.end.copy()
    for _ in range(6):
        end -= _MARK[data[end - 1]] & (end - start > 1)
        start += _MARK[data[start]] & (end - start > 1)
    lower = K.LOWER[data]
    plain = Hasher.roll.ranges(Hasher.roll.prefix(lower), start, end)
    is_plain = _in(plain, lexicon)
    # obfuscated: signs stand for letters, and marks within the word go
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    odd_flags = (_MARK | _DIGIT)[data]
    odd, letters = total(odd_flags), total(_LETTER[data])
    inside = odd[end] - odd[start]
    maybe = np.flatnonzero((inside > 0) & (letters[end] - letters[start] > 0) & (end - start <= 40))
    is_hidden = np.zeros(len(d), bool)
    if len(maybe):
        lengths = w.end[maybe] - w.start[maybe]
        cut = np.cumsum(lengths)
        at = np.arange(cut[-1]) - np.repeat(cut - lengths - w.start[maybe], lengths)
        raw = data[at]
        for table in (_LEET, K.LOWER):
            x = table[raw]
            keep = _LETTER[x] & (x >= 97)
            sizes = np.concatenate([[0], np.cumsum(keep)])
            to = sizes[cut]
            from_ = np.concatenate([[0], to[:-1]])
            y = x[keep]
            some = to > from_
            h = Hasher.roll.ranges(Hasher.roll.prefix(y), from_[some], to[some])
            is_hidden[maybe[some]] |= _in(h, lexicon)
        is_hidden &= ~is_plain
    any_ = is_plain | is_hidden
    is_second = _in(plain, second)
    seen = total(is_second)
    index = np.arange(len(d))
    near = any_ & (seen[np.minimum(index + NEAR + 1, w.bounds[d + 1])] - seen[np.maximum(index - NEAR, w.bounds[d])] > 0)
    put("plain", per(is_plain))
    put("plain_density", per(is_plain) / words)
    put("hidden", per(is_hidden))
    put("hidden_density", per(is_hidden) / words)
    hit = np.unique(np.stack([d[is_plain].astype(np.uint64), plain[is_plain]], 1), axis=0)
    put("distinct", np.bincount(hit[:, 0].astype(np.int64), minlength=n))
    put("second_density", per(is_second) / words)
    put("near", per(near))
    put("near_density", per(near) / words)
    up = total(_UPPER[data])
    size = end - start
    shouted = (up[end] - up[start] >= 2) & (up[end] - up[start] == letters[end] - letters[start])
    by_doc = lambda flags: (t := total(flags))[offsets[1:]] - t[offsets[:-1]]
    bytes_ = np.maximum(1, np.diff(offsets))
    put("capitals", by_doc(_UPPER[data]) / np.maximum(1, by_doc(_LETTER[data])))
    put("shouted", per(shouted) / words)
    put("exclaims", by_doc(data == 33) / words)
    put("questions", by_doc(data == 63) / words)
    put("marks", by_doc(_MARK[data]) / bytes_)
    put("inner_marks", per((inside > 0) & (size > 2)) / words)
    digits = total(_DIGIT[data])
    put("leet", per((digits[end] - digits[start] > 0) & (letters[end] - letters[start] > 0)) / words)
    put("symbols", by_doc(np.isin(data, np.frombuffer(b"*#$%@&", np.uint8))) / bytes_)
    put("log_words", np.log1p(np.diff(w.bounds)))
    put("word_length", np.bincount(d, size, n) / words)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: np.ndarray
    second: np.ndarray
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(features(data, offsets, self.lexicon, self.second))
        return np.clip(np.interp(raw, self.knots, self.values) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-raw)), 0, 1)


def learn_words(rows: DataFrame, most: int = LEARNED) -> list[str]:
    """Words of the labelled rows that mark label 1: by smoothed log-odds of document frequencies, at least 3 documents."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = rows.select("y", F.explode(words).alias("word")).filter(F.length("word") >= 3).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    n = rows.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).first()
    n1, n0 = (n["a"] or 0), (n["b"] or 0)
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    # over 4 standard errors from no difference, and at least e^2 times the odds
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = counts.filter(F.col("a") >= 3).withColumn("odds", odds).filter((F.col("odds") > 2) & (F.col("odds") / error > 2.5))
    return [r["word"] for r in found.orderBy(F.col("odds").desc(), "word").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = TRAIN, text: str = "text", id: str = "doc_id") -> ToxicityModel:
    rows = training_rows(docs, labels, "toxic", folds, held_out, most, text, id)
    lexicon, second = Hasher.of(sorted({*INSULTS, *learn_words(rows)})), Hasher.of(SECOND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.pieces(batch, "text"):
                x = features(data, offsets, lexicon, second)
                yield pa.RecordBatch.from_arrays([K.column(part, "doc_id"), K.column(part, "y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = rows.mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = found["y"].to_numpy().astype(float)
    x = np.array(found["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    # every fifth row calibrates trees that haven't seen it; the final trees are those same ones
    check = np.arange(len(y)) % 5 == 4
    if not (0 < y[~check].sum() < (~check).sum()) or not check.any():
        check = np.zeros(len(y), bool)
    trees = fit_trees(x[~check], y[~check])
    own = check if check.any() else ~check
    knots, values = isotonic(trees.raw(x[own]), y[own])
    return ToxicityModel(lexicon, second, trees, knots, values)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each input row.

    Null and empty texts are scored by their features, all zero.  A null id is never held out.  Without labels every
    score is 0.5.  Repeated rows get equal scores.  Only id and text of the documents are read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out, text=text, id=id, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([K.column(part, "doc_id"), pa.array(shared.value.score(data, offsets), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
