import random
import zlib

import numpy as np
from helpers import docs_frame, prose

from shelfrate.llm import quality_classifier
from shelfrate.llm.quality_classifier import CUT, FEATURES, features, fit, quantile_cut, score_documents, train


def labelled(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        w = prose(rng, rng.randrange(20, 200)).split()
        if not good:
            k = i % 3
            w = ([x + "!!" for x in w] if k == 0 else [x + "###" for x in w] if k == 1 else [w[0]] * len(w))
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_folds(spark):
    rows, labels = labelled()
    docs, marks = docs_frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = score_documents(docs, train(docs, marks)).collect()
    quality = {i: q for i, q, _ in labels}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= CUT) for r in got)
    held = [r.predicted == quality[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_held_out_labels_do_not_matter(spark):
    rows, labels = labelled(200)
    docs = docs_frame(spark, rows)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert a == b


def test_edge_cases(spark):
    rows, labels = labelled(100)
    docs = docs_frame(spark, rows + [(None, "null id"), (500, None), (501, ""), (0, rows[0][1])])
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None), (1, 1, 1), labels[2]], LABELS)
    got = score_documents(docs, train(docs, marks)).collect()
    assert len(got) == 104 and all(r.score is not None for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    one_class = marks.where("quality = 1")
    assert {r.score for r in score_documents(docs, train(docs, one_class)).collect()} == {0.5}
    assert train(docs, marks.limit(0)) is None
    assert score_documents(docs.limit(0), None).count() == 0


def test_quantile_and_features():
    x = np.array([[0.0], [1.0], [0.2], [0.9]])
    model = fit(x, np.array([0, 1, 0, 1]))
    cut = quantile_cut(model, 0.5)
    assert model["bad"].max() < cut < model["good"].min()
    assert features(None) == features("") == [0.0] * len(FEATURES)
    assert all(0 <= v <= 1 for t in ("a", "A! # 9 |", "x " * 5000, "é" * 9000) for v in features(t))


def test_every_labelled_row_counts(spark, monkeypatch):
    """Pieces hold each row of both classes, and every label decides about the model."""
    monkeypatch.setattr(quality_classifier, "PIECE", 20)
    rows, labels = labelled(300)
    docs = docs_frame(spark, rows)
    used = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    frame = spark.createDataFrame([(i, q, [float(i)] * len(FEATURES)) for i, q, _ in used], "id long, label int, f array<double>")
    n_good = sum(q for _, q, _ in used)
    got = quality_classifier._pieces(frame, n_good, len(used) - n_good).collect()
    assert sorted(x for r in got for x in r.good[::len(FEATURES)]) == sorted(i for i, q, _ in used if q)
    assert {x for r in got for x in r.bad[::len(FEATURES)]} == {i for i, q, _ in used if not q}
    assert all(r.good and r.bad for r in got) and len(got) > 5
    model = train(docs, spark.createDataFrame(labels, LABELS))
    assert model == train(docs.repartition(7), spark.createDataFrame(labels, LABELS).repartition(3))
    for one in used[:3]:
        other = [x for x in labels if x != one]
        assert model != train(docs, spark.createDataFrame(other, LABELS))


def test_exact_cut_is_the_quantile(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "FEW", 5)
    monkeypatch.setattr(quality_classifier, "BINS", 3)
    rng = random.Random(8)
    for ties in (8, 10**6):
        good, bad = ([rng.randrange(ties) / 7 for _ in range(n)] for n in (90, 40))
        for share in ((40, 90), (1, 129), (129, 1), (65, 65)):
            frame = spark.createDataFrame([(x, 1) for x in good] + [(x, 0) for x in bad], "score double, label int")
            scores = frame.groupBy("score").agg({"label": "sum", "*": "count"}).selectExpr(
                "score", "`sum(label)` AS good", "`count(1)` - `sum(label)` AS bad")
            want = quantile_cut({"good": np.array(good), "bad": np.array(bad)}, share[0] / sum(share))
            assert quality_classifier.exact_cut(scores, share) == want
