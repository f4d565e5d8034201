"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on labelled rows. Each path of a tree is a rule, a conjunction of comparisons. A logistic
regression with an L1 penalty keeps the rules that count, and they are compiled to one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": [32, 9], "line_feed": [10], "high": range(128, 256), "bang": [33],
    "symbol": b"#*$%&|<>", "stop": b".,;:?", "bracket": b"()[]{}\"'", "other": b"+-/=@\\^_`~",
}
STATS = [*(f"share_{x}" for x in CLASSES), "log_bytes", "mean_word", "distinct_words", "distinct_lines", "mean_line", "plain_words", "distinct_starts"]
MEMBERS = np.zeros((256, len(CLASSES)))
for _k, _v in enumerate(CLASSES.values()):
    MEMBERS[list(_v), _k] = 1.0


def statistics(text: str | None) -> list[float]:
    """The values of STATS; all are 0 for null and empty texts."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(STATS)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ MEMBERS / len(data)
    words, lines = data.split(), data.split(b"\n")
    n = max(1, len(words))
    plain = sum(map(bytes.isalpha, words))
    return [
        *shares, np.log1p(len(data)), sum(map(len, words)) / n, len(set(words)) / n, len(set(lines)) / len(lines), len(data) / len(lines), plain / n, len({x[:2] for x in words}) / n,
    ]


Rule = tuple[tuple[int, bool, float], ...]


def grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: Rule, out: dict[Rule, None], values: np.ndarray) -> None:
    """Split rows where the gain is greatest; every path on the way is added to out, values gets the leaves' steps."""
    best = (1e-6, None, None)
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for f in features if depth else ():
        n = len(cuts[f]) + 1
        sums = np.cumsum(np.bincount(bins[rows, f], g[rows], n))[:-1], np.cumsum(np.bincount(bins[rows, f], h[rows], n))[:-1], np.cumsum(np.bincount(bins[rows, f], minlength=n))[:-1]
        if not len(sums[0]):
            continue
        gain = sums[0] ** 2 / (sums[1] + 1.0) + (g[rows].sum() - sums[0]) ** 2 / (h[rows].sum() - sums[1] + 1.0) - base
        gain[(sums[2] < 8) | (len(rows) - sums[2] < 8)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], f, at)
    if path:
        out[path] = None
    if best[1] is None:
        values[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
        return
    _, f, at = best
    low = bins[rows, f] <= at
    for side, part in ((True, rows[low]), (False, rows[~low])):
        grow(bins, cuts, g, h, part, features, depth - 1, (*path, (int(f), side, float(cuts[f][at]))), out, values)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, seed: int = 7) -> list[Rule]:
    """Rules from boosted trees, each grown on a part of the statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    raw, out = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        features = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        step = np.zeros(len(y))
        grow(bins, cuts, y - p, p * (1 - p), np.arange(len(y)), features, depth, (), out, step)
        raw += 0.5 * step
    return list(out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= t) if low else (x[:, f] > t) for f, low, t in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty on the weights, by accelerated proximal steps."""
    n, k = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    step = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        new = v - step * (a.T @ (1 / (1 + np.exp(-a @ v)) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def logit(self, stat: Column) -> Column:
        """The rules as one expression over a struct of STATS."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            parts = [stat[STATS[f]] <= t if low else stat[STATS[f]] > t for f, low, t in rule]
            is_met = parts[0]
            for part in parts[1:]:
                is_met = is_met & part
            total = total + F.when(is_met, weight).otherwise(0.0)
        return total

    def text(self) -> list[str]:
        """The rules in words, heaviest first."""
        lines = [(w, " and ".join(f"{STATS[f]} {'<=' if low else '>'} {t:.4g}" for f, low, t in r)) for r, w in zip(self.rules, self.weights, strict=True)]
        return [f"{w:+.3f} if {r}" for w, r in sorted(lines, key=lambda x: -abs(x[0]))]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleModel:
    """A model of the labels y (0 or 1); with labels of one class or none it gives their share, 0.5 for none."""
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return RuleModel(float(np.log(share / (1 - share))), [], [])
    rules = tree_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso(z, y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-4)
    return RuleModel(intercept, [rules[i] for i in kept], [float(weights[i]) for i in kept])


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in STATS]))
def stats_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in text], columns=STATS, dtype="float64")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> RuleModel:
    """Fit on at most max_rows labelled documents that are not held out, taken in the order of a hash of their ids.

    Several labels of one id count as 1 if their mean is at least 0.5; null labels and ids are left out.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~is_held_out("_id"))
    taken = usable.groupBy("_id").agg((F.avg("_label") >= 0.5).cast("double").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(taken), "_id")
    found = rows.select("_id", "_label", stats_of("_text").alias("_s")).select("_id", "_label", "_s.*").orderBy(F.xxhash64("_id"), "_id", *STATS).limit(max_rows).toPandas()
    return fit_rules(found[STATS].to_numpy(float), found["_label"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: better) and predicted; columns of these names are replaced.

    The score depends on the text alone: null counts as empty, and equal texts have equal scores.
    """
    stats = free_name(docs, "_stats")
    scored = docs.withColumn(stats, stats_of(text_col))
    score = 1 / (1 + F.exp(-model.logit(F.col(stats))))
    scored = scored.withColumns({"held_out": is_held_out(id_col), "score": score})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(stats)
