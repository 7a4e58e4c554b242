"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A pair says that document i (label 1) is better than document j (label 0);
P(i over j) = sigmoid(w . (f_i - f_j)). The weights minimize logistic loss
on feature differences. The rejection threshold is a quantile of the
training scores: the share of label 0. Scores are shifted so that this
quantile maps to ``CUT``.

The fit and the quantile take every labelled row outside the held-out fold.
The rows of each class are dealt by hash into pieces of about ``PIECE``, each
piece of the larger class meets one of the other, and a Newton step adds up
the gradients of all pieces in Spark. The sums are decimal, so the model does
not change with the partitioning. The quantile is exact, by histograms that
are narrowed until few scores are left.

Edge cases: a null or empty text has a score like any other (all its
features are zero); a null id is never held out; label rows with a null id
or quality are ignored, repeated label rows count once; repeated document
rows are scored one by one; with labels of one class only, or none, every
document gets the score 0.5 (predicted 1); an empty table gives an empty
result; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.common import written
from shelfrate.llm.quality_rules import repeated_window_words

# Rows of a class in a piece, expected.
PIECE = 4000
PAIRS_PER_DOC = 8
L2 = 1e-3
CUT = 0.3
# Distinct scores the driver looks at to find the quantile, and bins of a histogram.
FEW, BINS = 4096, 1024
# Folds of crc32(id): fold 0 is held out.
FOLDS = 5
FEATURES = ("few_words", "many_words", "symbols", "pipes", "upper", "exclaim", "digits", "repeat", "same_next",
            "few_distinct", "dup_lines", "word_len", "no_stops", "long_words", "other_ascii")


def features(text: str | None) -> list[float]:
    """Fixed-length description of a text; every value lies in [0, 1]."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    symbols = int(hist[[35, 42, 36, 37, 38, 60, 62]].sum())
    punct = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    cap = lambda x: min(1.0, float(x))
    return [
        1.0 / (1.0 + n / 10.0),
        cap(np.log1p(n) / 12.0),
        cap(8.0 * symbols / n) ** 0.5,
        cap(8.0 * int(hist[124]) / n) ** 0.5,
        cap(2.0 * max(0.0, upper / max(1, upper + lower) - 0.08)) ** 0.5,
        cap(4.0 * int(hist[33]) / n) ** 0.5,
        cap(4.0 * int(hist[48:58].sum()) / len(raw)) ** 0.5,
        repeated_window_words(words) / n,
        cap(sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)) ** 0.5,
        1.0 - float(np.log1p(len(set(words))) / np.log1p(n)),
        1.0 - len(set(lines)) / len(lines),
        cap(len(raw) / n / 20.0),
        1.0 - cap(4.0 * sum(len(w) <= 3 for w in words) / n),
        cap(20.0 * sum(len(w) > 40 for w in words) / n),
        cap(2.0 * max(0, punct - symbols) / len(raw)),
    ]


def pair_differences(good: np.ndarray, bad: np.ndarray, seed: int = 17) -> np.ndarray:
    """Features of a good document minus those of a bad one, ``PAIRS_PER_DOC`` pairs for each of the larger class."""
    rng = np.random.default_rng(seed)
    n = PAIRS_PER_DOC * max(len(good), len(bad))
    return good[rng.integers(len(good), size=n)] - bad[rng.integers(len(bad), size=n)]


def loss_sums(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, negative gradient and Hessian of their logistic loss, one after the other."""
    p = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -30, 30)))
    return np.concatenate([[len(diff)], (diff * p[:, None]).sum(0), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], k: int = len(FEATURES)) -> np.ndarray:
    """Weights of k features that minimize the mean logistic loss; ``sums`` gives ``loss_sums`` over all pairs."""
    w = np.zeros(k)
    for _ in range(30):
        got = sums(w)
        n, grad, hess = got[0], got[1:k + 1], got[k + 1:].reshape(k, k)
        step = np.linalg.solve(hess / n + L2 * np.eye(k), L2 * w - grad / n)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: np.ndarray, label: np.ndarray) -> dict | None:
    """Model of rows in memory: weights and the scores of each class; None without both classes."""
    good, bad = sample[label == 1], sample[label == 0]
    if not len(good) or not len(bad):
        return None
    diff = pair_differences(good, bad)
    w = newton(lambda at: loss_sums(diff, at), sample.shape[1])
    return {"w": w, "good": good @ w, "bad": bad @ w}


def quantile_cut(model: dict, bad_share: float) -> float:
    """Quantile of the training scores, each class weighted by its true share, at the share of label 0."""
    scores = np.concatenate([model["good"], model["bad"]])
    weight = np.concatenate([np.full(len(model["good"]), (1 - bad_share) / len(model["good"])),
                             np.full(len(model["bad"]), bad_share / len(model["bad"]))])
    order = np.argsort(scores, kind="stable")
    at = 1 + int(np.searchsorted(np.cumsum(weight[order]), bad_share - 1e-9))  # so many scores lie below the cut
    at = min(at, len(order) - 1)
    return float((scores[order][at - 1] + scores[order][at]) / 2)


def held_out(id_col: Column) -> Column:
    """True for the rows whose crc32 of the id as text is 0 modulo ``FOLDS``."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "f"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _pieces(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(piece, good, bad): feature rows of both classes that are paired, from (id, label, f) with so many of each class.

    Every row of the larger class is in one piece; those of the other are in
    as many as it takes to meet all pieces.
    """
    parts = {1: -(-good // PIECE), 0: -(-bad // PIECE)}
    count = max(parts.values())
    own = F.when(F.col("label") == 1, parts[1]).otherwise(parts[0]).cast("long")
    dealt = rows.withColumn("own", own).withColumn("p", F.pmod(F.xxhash64("id", "f"), "own"))
    dealt = dealt.select("id", "label", "f", F.explode(F.expr(f"sequence(p, p + (({count} - 1 - p) div own) * own, own)")).alias("piece"))
    of = lambda k: F.flatten(F.transform(F.sort_array(F.collect_list(
        F.when(F.col("label") == k, F.struct("id", "f")))), lambda x: x["f"]))
    return written(dealt.groupBy("piece").agg(of(1).alias("good"), of(0).alias("bad")), "pieces")


def _sums(pieces: DataFrame, w: np.ndarray) -> np.ndarray:
    """``loss_sums`` over the pairs of all pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                good, bad = (_matrix(b.column(c).slice(i, 1)) for c in (1, 2))
                if len(good) and len(bad):
                    got = loss_sums(pair_differences(good, bad, 17 + b.column(0)[i].as_py()), w)
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), pa.array(got)], names=["k", "v"])

    # Decimals add up to the same in any order.
    total = pieces.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum(F.col("v").cast("decimal(28,15)")).alias("v"))
    return np.array([float(r.v) for r in total.orderBy("k").collect()])


def exact_cut(scores: DataFrame, share: tuple[int, int]) -> float:
    """``quantile_cut`` of (score, good, bad): distinct scores and their rows; ``share`` counts the labels 0 and 1."""
    n = scores.agg(F.sum("good"), F.sum("bad")).head()
    weigh = {"good": share[1] * n[1], "bad": share[0] * n[0]}  # whole numbers, so nothing is rounded
    need = share[0] * n[0] * n[1]
    weight = lambda r: r.good * weigh["good"] + r.bad * weigh["bad"]
    below, part = 0, scores
    while True:
        low, high, count = part.agg(F.min("score"), F.max("score"), F.count("score")).head()
        if count <= FEW:
            break
        bins = part.groupBy(F.floor((F.col("score") - low) / ((high - low) / BINS)).alias("bin")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in bins.orderBy("bin").collect():  # BINS + 1 rows
            if below + weight(r) >= need:
                break
            below += weight(r)
        part = scores.where(F.col("score").between(r.low, r.high))
    for r in part.orderBy("score").collect():
        if below + weight(r) >= need:
            break
        below += weight(r)
    if below + weight(r) - weigh["bad" if r.bad else "good"] >= need:
        return float(r.score)  # the next row has this score too
    after = scores.where(F.col("score") > r.score).agg(F.min("score")).head()[0]
    if after is None:  # the last row of all: between it and the one before
        before = scores.where(F.col("score") < r.score).agg(F.max("score")).head()[0]
        after = r.score if r.good + r.bad > 1 or before is None else before
    return float((r.score + after) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> dict | None:
    """Fit on all labelled rows outside the held-out fold; an id with several texts counts with each of them."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).distinct())
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    described = (texts.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
                 .mapInArrow(_feature_batches, f"id {dict(texts.dtypes)['id']}, f array<double>"))
    rows = written(described.join(known, "id").select("id", "label", "f").distinct(), "labelled")
    found = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(found) < 2:
        return None
    pieces = _pieces(rows, found[1], found[0])
    w = newton(lambda at: _sums(pieces, at))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_matrix(b.column(1)) @ w)], names=["label", "score"])

    scores = written(rows.select("label", "f").mapInArrow(scored, "label int, score double").groupBy("score").agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")), "scores")
    return {"w": w.tolist(), "cut": exact_cut(scores, (counts[0], counts[1]))}


def score_documents(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score, predicted of every row; ``carry`` names input columns to keep beside them."""
    w = np.array(model["w"]) if model else np.zeros(len(FEATURES))
    shift = float(np.log(CUT / (1 - CUT))) - model["cut"] if model else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1, len(FEATURES))
            score = 1.0 / (1.0 + np.exp(-np.clip(f @ w + shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)],
                                             names=[*b.schema.names[:-1], "_score"])

    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    src = docs.select(F.col(id_col).alias("_id"), *kept, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in src.dtypes[:-1]) + ", _score double"
    out = src.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"),
                      F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"),
                      *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c != id_col])
