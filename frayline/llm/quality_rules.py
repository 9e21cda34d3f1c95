"""Quality classifier: a sparse rule ensemble over text statistics (operator 3).

1. ``statistics``: shares and lengths of a whole text, from its bytes, words and lines.
2. Small boosted trees on a bounded sample of labelled rows (``SAMPLE``, picked by a hash of the id) propose rules: every
   path from the root to a node is a conjunction of thresholds.
3. A lasso logistic regression weighs the rules; its penalty is chosen on a part of the sample, and most weights are 0.
4. The rules left are compiled into one Spark column expression, which scores any number of rows.

Rows: null text counts as empty and is scored like it; null or repeated ids do not matter for scores; labels that are
null, or without a document, are not learned from; rows with a null id are not held out; repeated labels count each time; without labels of both kinds the
score is their share of ones (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frayline.llm.common import batched, sampled, unused, word_bounds, word_hashes

SAMPLE = 20_000
CUT = 0.3
STATISTICS = [
    "log_words", "mean_word", "distinct_words", "one_byte_words", "upper", "digits", "marks", "commas_stops", "bangs", "bars",
    "symbols", "non_ascii", "mean_line", "distinct_lines", "top_word", "bare_ends", "capital_words", "longest_word",
]
_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_SYMBOLS = np.array([ord(c) for c in "#$%&*+<=>@\\^_`{}~"])
_STOPS = np.array([ord(c) for c in ".,;:?"])
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def text_statistics(text: str | None) -> np.ndarray:
    """The values of ``STATISTICS``; all 0 for a text without words."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, ends = word_bounds(data)
    n = len(starts)
    out = np.zeros(len(STATISTICS))
    if not n:
        return out
    counts = np.bincount(data, minlength=256)
    sizes = ends - starts
    letters = int(sizes.sum())
    _, often = np.unique(word_hashes(data, starts, ends), return_counts=True)
    lines = (text or "").split("\n")
    full = [x for x in lines if x.strip()]
    heads, tails = data[starts], data[ends - 1]
    out[:] = (
        np.log1p(n), letters / n, len(often) / n, (sizes == 1).mean(), counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / letters,
        counts[_MARKS].sum() / letters, counts[_STOPS].sum() / letters, counts[33] / letters, counts[124] / letters,
        counts[_SYMBOLS].sum() / letters, counts[128:].sum() / letters, n / max(1, len(full)), len(set(full)) / max(1, len(full)),
        often.max() / n, np.isin(tails, _MARKS).mean(), ((heads >= 65) & (heads <= 90)).mean(), np.log1p(sizes.max()),
    )
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pd.Series) -> pd.Series:
    return texts.map(text_statistics)


@dataclass(frozen=True)
class Rule:
    """A conjunction: statistic index, whether it must be above the threshold, threshold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, t in self.conditions:
            out &= (x[:, k] > t) == above
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for k, above, t in self.conditions:
            out = out & (stats[k] > t if above else stats[k] <= t)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self, stats: Column) -> Column:
        """Probability of label 1 as one column expression."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, features: np.ndarray, cuts: list[np.ndarray]) -> tuple | None:
    """The (feature, threshold) with the largest gain, or None."""
    best, base = (1e-6, None), grad.sum() ** 2 / (hess.sum() + 1)
    for k in features:
        t = cuts[k]
        if not len(t):
            continue
        bin_ = np.searchsorted(t, x[:, k], side="left")
        g = np.cumsum(np.bincount(bin_, grad, len(t) + 1))[:-1]
        h = np.cumsum(np.bincount(bin_, hess, len(t) + 1))[:-1]
        gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - base
        gain[(h < 2) | (hess.sum() - h < 2)] = -1
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (int(k), float(t[i])))
    return best[1]


def _grow(x, grad, hess, rng, cuts, depth, path, at, rules, margin, rate) -> None:
    """Grow one tree below ``path`` on the rows ``at``; note its paths and add its leaf values to ``margin``."""
    cut = None
    if depth and len(at) >= 20:
        some = rng.choice(x.shape[1], max(4, x.shape[1] // 2), replace=False)
        cut = _split(x[at], grad[at], hess[at], np.sort(some), cuts)
    if cut is None:
        margin[at] += rate * grad[at].sum() / (hess[at].sum() + 1)
        return
    k, t = cut
    for above in (False, True):
        below = at[(x[at, k] > t) == above]
        conditions = (*path, (k, above, t))
        rules.append(Rule(conditions))
        _grow(x, grad, hess, rng, cuts, depth - 1, conditions, below, rules, margin, rate)


def proposed_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """Distinct paths of boosted trees (logistic loss), by what they hold on."""
    rng, rules = np.random.default_rng(seed), []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        _grow(x, y - p, p * (1 - p), rng, cuts, depth, (), np.arange(len(y)), rules, margin, rate)
    seen, kept = set(), []
    for rule in rules:
        held = rule.holds(x)
        key = np.packbits(held).tobytes()
        if key not in seen and 0.002 < held.mean() < 0.998:
            seen.add(key)
            kept.append(rule)
    return kept


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic regression, by accelerated proximal gradient."""
    n, m = z.shape
    size = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    b = bb = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    w, v, t = np.zeros(m), np.zeros(m), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(bb + z @ v))) - y
        new_b = bb - size * r.mean()
        new = v - size * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bb, w, b, t = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b), new, new_b, t_new
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray, penalties: tuple[float, ...] = (0.02, 0.01, 0.005, 0.002, 0.001)) -> RuleEnsemble:
    """Rules on the rows outside ``check``; the penalty with the least loss on ``check``; weights on all rows."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    own = ~check if check.any() and (~check).sum() > 1 and y[~check].min() != y[~check].max() else np.ones(len(y), dtype=bool)
    rules = proposed_rules(x[own], y[own])
    z = np.column_stack([r.holds(x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    losses = []
    for penalty in penalties:
        b, w = lasso(z[own], y[own], penalty)
        p = np.clip(1 / (1 + np.exp(-(b + z[check] @ w))), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)) if check.any() else 0.0)
    b, w = lasso(z, y, penalties[int(np.argmin(losses))])
    return RuleEnsemble(b, tuple((float(a), r) for a, r in zip(w, rules) if abs(a) > 1e-4))


def fold(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5


def trained(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Learned from at most about ``sample`` labelled rows outside the held-out fold 0; fold 1 of them picks the penalty."""
    own = labels.filter(f"{label} is not null and doc_id is not null").filter(fold() != 0).select("doc_id", F.col(label).alias("_label"))
    # an id that stands on many rows counts once per label, so that a share of the ids is a share of what is broadcast
    own = own.distinct()
    own = own.filter(sampled(min(1.0, sample / max(1, own.count())), "doc_id"))
    # about ``sample`` rows of two numbers: small enough to broadcast, whatever the corpus
    rows = batched(documents).select("doc_id", "text").join(F.broadcast(own), "doc_id")
    # a picked id may stand on any number of documents; only then is there more to thin out
    there = documents.select("doc_id").join(F.broadcast(own), "doc_id").count()
    if there > 2 * sample:
        rows = rows.distinct().filter(sampled(2 * sample / there, "doc_id", "text"))
    found = rows.select("doc_id", fold().alias("fold"), "_label", statistics("text").alias("stats")).toPandas()
    found = found.assign(order=found["stats"].map(lambda s: tuple(s))).sort_values(["doc_id", "order", "_label"], kind="stable")
    x = np.stack(found["stats"].to_list()) if len(found) else np.zeros((0, len(STATISTICS)))
    return fit(x, found["_label"].to_numpy(dtype=float), found["fold"].to_numpy() == 1)


def scored(documents: DataFrame, model: RuleEnsemble, out: str = "score") -> DataFrame:
    """``documents`` with the score of each text."""
    stats = unused(documents, "stats")
    return batched(documents).withColumn(stats, statistics("text")).withColumn(out, model.score(F.col(stats))).drop(stats)


def quality_scores(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = scored(documents.select("doc_id", "text"), trained(documents, labels))
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_low_quality(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``documents`` whose score is at least ``cut``."""
    score = unused(documents, "score")
    rows = scored(documents, trained(documents, labels), score)
    return rows.filter(F.col(score) >= cut).select(*documents.columns)
