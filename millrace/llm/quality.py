"""Quality classifier as a sparse ensemble of rules.

Boosted small trees over text statistics give their paths as conjunctive rules; lasso logistic regression keeps few of
them, and those become one Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from millrace.llm.fertility import repeated_words
from millrace.llm.folds import FIT_ROWS, fit_sample
from millrace.llm.texts import Slots, map_texts, plain

PREDICTED_FROM = 0.3
STATISTICS = ("n_words", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share", "letter_share", "distinct_share", "top_word_share", "repeat_share", "dup_line_share", "line_words", "stop_share", "end_share")
# Frequent small words of English, German, French and Spanish.
STOP_WORDS = frozenset("the of and to in is that for it with as was on are by this der die und das den von mit ist des im le la les et des en un une du que qui est dans el los las de y en un una por con para".split())

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_LETTER = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_SYMBOL, _MARK = b"#$%&*+/<=>@[\\]^_{|}~", b"!?"
_STOP = frozenset(w.encode() for w in STOP_WORDS)


def statistics(raw: bytes | None) -> tuple[float, ...]:
    """STATISTICS of a whole text; zeros for null, empty and blank texts. Shares are of the bytes that aren't space."""
    words = raw.split() if raw else []
    if not words:
        return (0.0,) * len(STATISTICS)
    solid, n = b"".join(words), len(words)
    size = len(solid)
    share = lambda kind: (size - len(solid.translate(None, kind))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = repeated_words(Slots().numbers(words)) if n > 8 else 0
    stops = sum(v for w, v in counts.items() if w.lower().strip(b".,;:!?") in _STOP)
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return (float(n), size / n, share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(_LETTER), len(counts) / n, max(counts.values()) / n, repeated / n, 1 - len(set(lines)) / len(lines), n / len(lines), stops / n, ends / len(lines))


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def make() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            rows = [statistics(t) for t in texts]
            return dict(zip(STATISTICS, map(list, zip(*rows, strict=True)), strict=True))

        return run

    return map_texts(docs, [StructField(n, DoubleType()) for n in STATISTICS], make, text, keep)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether greater, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (plain(n) > t if greater else plain(n) <= t for n, greater, t in self.conditions))

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = [STATISTICS.index(n) for n, _, _ in self.conditions]
        return np.logical_and.reduce([x[:, i] > t if greater else x[:, i] <= t for i, (_, greater, t) in zip(at, self.conditions, strict=True)])


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    offset: float

    def column(self) -> Column:
        """The score from 0 to 1 as an expression over the statistics."""
        total = reduce(lambda a, b: a + b, (F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules), F.lit(self.offset))
        return 1 / (1 + F.exp(-total))


def _tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, paths: list, leaves: list) -> None:
    """Grows a tree by second-order gain on binned statistics; notes every path and each leaf's rows and value."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * least:
        for j in range(bins.shape[1]):
            n = len(cuts[j]) + 1
            own = bins[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(own, w, n)) for w in (grad[rows], hess[rows], None))
            gs, hs, ns = gs[:-1], hs[:-1], ns[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            if len(gain) and (k := int(np.argmax(gain))) >= 0 and gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        leaves.append((rows, -g / (h + 1)))
        return
    left = bins[rows, j] <= k
    for greater, part in ((False, rows[left]), (True, rows[~left])):
        longer = (*path, (STATISTICS[j], greater, float(cuts[j][k])))
        paths.append(longer)
        _tree(bins, cuts, grad, hess, part, depth - 1, least, longer, paths, leaves)


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2) -> list[tuple]:
    """The distinct paths of boosted trees, from roots to inner nodes and leaves."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    f, paths, least = np.zeros(len(y)), [], max(5, len(y) // 500)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(np.random.default_rng(t).random(len(y)) < 0.7)
        leaves: list = []
        _tree(bins, cuts, p - y, p * (1 - p) + 1e-9, rows, depth, least, (), paths, leaves)
        for own, value in leaves:
            f[own] += rate * value
    return list(dict.fromkeys(tuple(sorted(p)) for p in paths))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the mean log loss and penalty * sum of |weights|, by accelerated proximal steps."""
    design = np.column_stack([x, np.ones(len(x))])
    size = 4.0 / (np.linalg.norm(design, 2) ** 2 / len(x))
    b = look = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ look, -30, 30)))
        moved = look - size * (design.T @ (p - y) / len(y))
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(abs(moved[:-1]) - size * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        b, look = moved, moved + (before - 1) / t * (moved - b)
    return b[:-1], float(b[-1])


def learn(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> Ensemble:
    """Rules from statistics and labels. With one label alone, or no rows, there are no rules and the score is its share."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble((), float(np.log(share / (1 - share))))
    found = [Rule(p) for p in tree_paths(x, y)]
    held = np.column_stack([r.holds(x) for r in found]).astype(float)
    _, first = np.unique(held, axis=1, return_index=True)
    found, held = [found[i] for i in sorted(first)], held[:, sorted(first)]
    weights, offset = lasso_logistic(held, y, penalty)
    return Ensemble(tuple(Rule(r.conditions, float(w)) for r, w in zip(found, weights, strict=True) if abs(w) > 1e-6), offset)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text: str = "text") -> Ensemble:
    """Learns from at most `rows` labelled documents whose crc32 remainder by 5 isn't 0."""
    sample = fit_sample(docs, labels, "quality", 5, 0, rows, text)
    seen = sorted(map(tuple, with_statistics(sample, text, ["label"]).collect()))  # in an order that no partition decides
    got = np.array(seen, float).reshape(len(seen), len(STATISTICS) + 1)
    return learn(got[:, 1:], (got[:, 0] == 1).astype(float))


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", keep: list[str] | None = None, threshold: float = PREDICTED_FROM) -> DataFrame:
    """Adds the statistics, score and predicted.

    Null and empty texts have statistics of 0 and the score of those. Repeated rows are each scored; input columns
    named like an added one give way.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    return with_statistics(docs, text, kept).withColumn("score", ensemble.column()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
