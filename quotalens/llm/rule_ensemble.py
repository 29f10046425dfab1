"""Sparse rule ensemble: tree paths over text statistics as rules, weighted by a lasso logistic fit.

Trees are grown and weights fitted on a bounded, documented sample of labelled rows on the driver; the
result is a list of rules that compiles into one Spark column expression, so that scoring never leaves
the JVM.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quotalens.llm.store import saved
from quotalens.llm.text_stats import text_stats

#: At most so many labelled rows are fitted, chosen by the hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST, PENALTY, ROUNDS = 24, 3, 32, 20, 1e-3, 400


def ratios() -> dict[str, Column]:
    """The inputs of the rules: statistics that are defined for every text."""
    words, size = F.greatest("n_words", F.lit(1)), F.greatest("n_bytes", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "line_words": F.col("n_words") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "distinct": F.col("n_distinct_words") / words,
        "same_as_before": F.col("n_same_as_before") / words,
        "upper": F.col("n_upper") / size,
        "digits": F.col("n_digits") / size,
        "marks": F.col("n_marks") / words,
        "stops": F.col("n_stops") / words,
        "pipes": F.col("n_pipes") / words,
    }


@dataclass
class RuleModel:
    """Rules are tuples of (input, at_most, threshold); score = 1 / (1 + exp(-(intercept + sum of the weights of rules that hold)))."""

    intercept: float
    rules: list[tuple[tuple[str, bool, float], ...]]
    weights: list[float]

    def column(self, inputs: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = functools.reduce(operator.and_, [inputs[f] <= t if at_most else inputs[f] > t for f, at_most, t in rule])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rnd: np.random.Generator, path: tuple, depth: int, out: set):
    """Add the path to every node below the root; splits by Gini gain over a random half of the inputs."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return
    best = (1e-9, 0, 0.0)
    share, n = y.mean(), len(y)
    for f in rnd.permutation(x.shape[1])[: max(1, (x.shape[1] + 1) // 2)]:
        if not len(cuts[f]):
            continue
        slot = np.searchsorted(cuts[f], x[:, f])  # rows of slot s have x <= cuts[s]
        size = np.cumsum(np.bincount(slot, minlength=len(cuts[f]) + 1))[:-1]
        ones = np.cumsum(np.bincount(slot, weights=y, minlength=len(cuts[f]) + 1))[:-1]
        good = (size >= LEAST) & (n - size >= LEAST)
        if not good.any():
            continue
        left, right = np.where(good, ones / np.maximum(size, 1), 0), np.where(good, (y.sum() - ones) / np.maximum(n - size, 1), 0)
        gain = np.where(good, share * (1 - share) - (size * left * (1 - left) + (n - size) * right * (1 - right)) / n, 0)
        s = int(np.argmax(gain))
        if gain[s] > best[0]:
            best = (gain[s], f, cuts[f][s])
    if best[0] <= 1e-9:
        return
    _, f, t = best
    low = x[:, f] <= t
    for side, at_most in ((low, True), (~low, False)):
        _grow(x[side], y[side], cuts, rnd, (*path, (int(f), at_most, float(t))), depth - 1, out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic loss with an absolute penalty on standardised rules, by accelerated proximal steps."""
    mean, spread = z.mean(0), np.maximum(z.std(0), 1e-3)
    z = (z - mean) / spread
    n, k = z.shape
    step = 4 * n / max(np.linalg.norm(z, 2) ** 2, n)
    w = v = np.zeros(k)
    b = vb = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30))) - y
        new = v - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = vb - step * error.mean()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / following * (new - w), new_b + (t - 1) / following * (new_b - b)
        w, b, t = new, new_b, following
    return float(b - (w * mean / spread).sum()), w / spread


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7, penalty: float = PENALTY) -> RuleModel:
    """Rules and weights from a sample.  Without rows the score is 0.5; with one class it is constant."""
    if not len(y):
        return RuleModel(0.0, [], [])
    if y.min() == y.max():
        return RuleModel(3.0 if y[0] else -3.0, [], [])
    order = np.lexsort((*x.T, y))  # the order in which rows arrive doesn't matter
    x, y = x[order], y[order]
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(x.shape[1])]
    rnd, found = np.random.default_rng(seed), set()
    # the rare class counts as much as the common one while trees grow
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(TREES):
        m = min(len(ones), len(zeros))
        rows = np.concatenate([rnd.choice(ones, max(m, LEAST)), rnd.choice(zeros, max(m, LEAST))])
        _grow(x[rows], y[rows], cuts, rnd, (), DEPTH, found)
    rules = sorted(found)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), [], [])
    held = np.column_stack([np.logical_and.reduce([x[:, f] <= t if at_most else x[:, f] > t for f, at_most, t in r]) for r in rules]).astype(float)
    intercept, weights = _lasso(held, y, penalty)
    kept = [(tuple((names[f], a, t) for f, a, t in r), float(w)) for r, w in zip(rules, weights) if w]
    return RuleModel(intercept, [r for r, _ in kept], [w for _, w in kept])


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score every document.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns are ignored and never
    enter a score.  Returns per row doc_id, held_out, score (0 to 1) and predicted (1 from
    ``threshold`` on).  A null text is scored as an empty one; equal texts get equal scores.  Rows with
    a null id or label teach nothing; without labels every score is 0.5.  Repeated rows are scored one by
    one.  An empty table gives an empty table.
    """
    names = list(ratios())
    stats = saved(text_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]).withColumnRenamed("key_0", "doc_id"), "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id")))
    rows = (
        stats.join(known, "doc_id").select("doc_id", "label", *[c.alias(n) for n, c in ratios().items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(sample_rows).toPandas()
    )
    model = fit_rules(rows[names].to_numpy(float), rows["label"].to_numpy(float), names)
    inputs = {n: F.col(f"in_{n}") for n in names}
    scored = stats.select("doc_id", *[c.alias(f"in_{n}") for n, c in ratios().items()]).withColumn("score", model.column(inputs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
