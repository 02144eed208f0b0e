"""Held-out accuracy on made-up labels, and awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.llm import boosting, quality, toxicity

from . import brute


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(0)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        bad, rude = i % 4 == 0, i % 3 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [x + " |" for x in w]
        if rude:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "M0R0N", "st.u.pid", "vexling", "Vexling,"])
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), int(rude)))
    docs += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "words without an id", None, None, None), (1002, "x " * 20000, None, None, None)]
    labels += [(None, 1, 1), (0, None, None), (5000, 1, 1), (1, 7, 7)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, label string, y bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def check(got, labels, name, folds, held):
    truth = {r.doc_id: r[name] for r in labels.collect() if r[name] in (0, 1)}
    rows = [r for r in got.collect()]
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and brute.crc_fold(r.doc_id, folds) == held) for r in rows)
    own = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    return auc, np.mean([(s >= 0.5) == y for s, y in own])


def test_quality(labelled):
    docs, labels = labelled
    auc, right = check(quality.classify(docs, labels), labels, "quality", 3, 1)
    assert auc > 0.97 and right > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 604


def test_toxicity(labelled):
    docs, labels = labelled
    auc, right = check(toxicity.classify(docs, labels), labels, "toxic", 5, 0)
    assert auc > 0.97 and right > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_documents(labelled, module):
    docs, labels = labelled
    assert {round(r.score, 3) for r in module.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert module.classify(docs.limit(0), labels).count() == 0
    one = labels.filter("doc_id is not null").withColumns({"quality": F.lit(1), "toxic": F.lit(1)})
    assert module.classify(docs, one).filter("score < 0.5").count() == 0


def test_samples_are_bounded_and_leave_the_fold_out(labelled):
    from stratalake.llm.labelled import training_rows

    docs, labels = labelled
    got = [r.doc_id for r in training_rows(docs, labels, "quality", 3, 1, 50).collect()]
    assert len(got) == 50 == len(set(got)) and all(brute.crc_fold(i, 3) != 1 for i in got)
    assert got == [r.doc_id for r in training_rows(docs.repartition(7), labels, "quality", 3, 1, 50).collect()] or set(got) == {r.doc_id for r in training_rows(docs.repartition(7), labels, "quality", 3, 1, 50).collect()}


def test_isotonic_is_monotone_and_pools():
    z, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1, 1])
    knots, values = boosting.isotonic(z, y, 0.0)
    assert (np.diff(values) >= 0).all() and np.interp(1, knots, values) == np.interp(2, knots, values) == 0.5
    assert boosting.isotonic(z[:0], y[:0])[1][0] == 0.5


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0.2)).astype(float)
    m = boosting.fit_trees(x[:1500], y[:1500])
    assert ((m.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97


def test_obfuscated_words_are_seen():
    lexicon, second = toxicity.Hasher.of(["idiot"]), toxicity.Hasher.of(["you"])
    texts = [b"You idiot!", b"an 1D10T here", b"such an i.d.i.o.t", b"idiotic idea", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x = toxicity.features(data, offsets, lexicon, second)
    at = toxicity.FEATURES.index
    assert x[:, at("plain")].tolist() == [1, 0, 0, 0, 0] and x[:, at("hidden")].tolist() == [0, 1, 1, 0, 0] and x[:, at("near")].tolist() == [1, 0, 0, 0, 0]
