"""Quality classifier: tree paths as rules, lasso logistic weights, rules as column expressions."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import read_table

from .text import let_go, slices

STATS = ("n_bytes", "n_words", "word_len", "upper", "digit", "symbol", "bang", "pipe", "stop", "comma", "high", "distinct", "top", "again", "lines", "line_words", "line_again", "ends_odd")
#: The most labelled rows that the classifier learns from, by the least hashes of their ids.
SAMPLE = 8000
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.array([ord(c) for c in "#$%&*@^~<>{}[]\\_+="])


def text_stats(t: bytes) -> tuple:
    """Statistics of a whole text; zeros for an empty one."""
    if not t:
        return (0.0,) * len(STATS)
    n = len(t)
    b = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    w = t.split()
    k = max(1, len(w))
    counts = Counter(w)
    lines = [x for x in t.split(b"\n") if x.strip()] or [b""]
    letters = max(1, b[_UPPER].sum() + b[_LOWER].sum())
    odd = sum(c for x, c in counts.items() if not (x[-1:].isalnum() or x[-1] in b".,;:?)\"'" or x[-1] > 127))
    return (
        float(n), float(len(w)), n / k, b[_UPPER].sum() / letters, b[_DIGIT].sum() / n, b[_SYMBOLS].sum() / n, b[33] / n, b[124] / n, b[46] / k, b[44] / k, b[128:].sum() / n,
        len(counts) / k, max(counts.values(), default=0) / k, sum(x == y for x, y in zip(w, w[1:])) / k, float(len(lines)), len(w) / len(lines), 1 - len(set(lines)) / len(lines), odd / k,
    )


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` and a struct column __stats; null texts are empty ones."""
    from pyspark.sql.functions import arrow_udf

    kind = ", ".join(f"{s} double" for s in STATS)

    @arrow_udf(kind)
    def stats(texts: pa.Array) -> pa.Array:
        let_go()
        rows = []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            rows += [text_stats(t) for t in part.column(0).to_pylist()]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [()] * len(STATS))], list(STATS))

    return df.withColumn("__stats", stats(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold)


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, cuts: list[np.ndarray]) -> list[Rule]:
    """The paths to all nodes of a tree grown on squared error over a random part of the statistics."""
    rules: list[Rule] = []

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 20 or np.ptp(y[rows]) == 0:
            return
        best = (1e-9, None, None)
        total, n = y[rows].sum(), len(rows)
        for j in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
            if not len(cuts[j]):
                continue
            bins = np.searchsorted(cuts[j], x[rows, j])  # bin b: above the first b cuts
            size = np.cumsum(np.bincount(bins, minlength=len(cuts[j]) + 1))[:-1]
            part = np.cumsum(np.bincount(bins, weights=y[rows], minlength=len(cuts[j]) + 1))[:-1]
            ok = (size >= 5) & (n - size >= 5)
            gain = np.where(ok, part**2 / np.maximum(size, 1) + (total - part) ** 2 / np.maximum(n - size, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, cuts[j][k])
        if best[1] is not None:
            above = x[rows, best[1]] > best[2]
            grow(rows[~above], (*path, (int(best[1]), False, float(best[2]))))
            grow(rows[above], (*path, (int(best[1]), True, float(best[2]))))

    grow(np.arange(len(y)), ())
    return rules


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > c) == above for j, above, c in rule])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4, steps: int = 600, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules with weights other than zero.

    Boosted trees (each on a random half, shrunk) give the rules; accelerated
    proximal gradient steps fit their weights under an L1 penalty.
    """
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(y) < 20 or y.min() == y.max():
        return float(np.log(rate / (1 - rate))), []
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 60), method="lower")) for c in x.T]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        half = rng.choice(len(y), max(20, len(y) // 2))
        rest = y - 1 / (1 + np.exp(-margin))
        grown = tree_rules(x[half], rest[half], rng, depth, cuts)
        for r in grown:
            on = fires(r, x)
            if 5 <= on.sum() <= len(y) - 5:
                rules.setdefault(on.tobytes(), (r, on))
        leaves = [r for r in grown if not any(len(q) == len(r) + 1 and q[: len(r)] == r for q in grown)]
        for r in leaves:
            on = fires(r, x)
            margin += on * np.clip(rest[on].mean() * 2, -2, 2) * 0.5 if on.any() else 0
    kept = list(rules.values())
    m = np.array([on for _, on in kept], float).T
    mean, scale = m.mean(0), m.std(0)
    z = (m - mean) / scale
    step = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w = v = np.zeros(z.shape[1] + 1)
    t = 1.0
    design = np.hstack([np.ones((len(y), 1)), z])
    step = 1 / (1 / step + 0.25)
    for _ in range(steps):
        g = design.T @ (1 / (1 + np.exp(-(design @ v))) - y) / len(y)
        u = v - step * g
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = u + (s - 1) / t * (u - w), u
    weights = w[1:] / scale
    return float(w[0] - (weights * mean).sum()), [(r, float(k)) for (r, _), k in zip(kept, weights) if k]


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The probability as one expression over __stats."""
    test = lambda j, above, c: F.col(f"__stats.{STATS[j]}") > c if above else F.col(f"__stats.{STATS[j]}") <= c
    terms = [F.when(reduce(lambda a, b: a & b, [test(*c) for c in rule]), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in rules]

    def tree_sum(xs: list[Column]) -> Column:
        return xs[0] if len(xs) == 1 else tree_sum(xs[: len(xs) // 2]) + tree_sum(xs[len(xs) // 2 :])

    return F.lit(1.0) / (F.lit(1.0) + F.exp(-tree_sum([F.lit(bias), *terms])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, label_id: str = "doc_id") -> Column:
    """Learn from labelled rows whose crc32(id as text) mod 4 is not 2, `sample` of them at most; null labels don't count, repeated rows count once."""
    key = F.col(label_id)
    known = labels.filter(F.col("quality").isNotNull() & key.isNotNull() & (F.crc32(key.cast("string")) % 4 != 2)).select(key.alias("__id"), F.col("quality").cast("double").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__y").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known.distinct()), "__id").dropDuplicates(["__id", "__y"])
    data = np.array([[y, *s] for y, s in with_stats(rows, "__text").orderBy("__id", "__y").select("__y", "__stats").collect()], float).reshape(-1, 1 + len(STATS))
    return compiled(*fit_rules(data[:, 1:], data[:, 0]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from the threshold on).

    Null and empty texts are scored as texts without words. Without usable
    labels, or with those of one class, every text has the labels' rate (0.5
    if there are none). Repeated rows have equal scores. Columns of `docs`
    named score, predicted or __stats are replaced.
    """
    probability = fit(docs, labels, id_col, text_col)
    return with_stats(docs, text_col).withColumn("score", probability).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__stats")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")
