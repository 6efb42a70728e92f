"""Quality classifier: a sparse ensemble of rules over text statistics (Friedman and Popescu 2008).

Small boosted trees propose rules: each path from the root to a node is a conjunction of
conditions on statistics. A lasso logistic regression weighs them and leaves few. The
result is compiled to one Spark column expression over statistics that are
themselves columns, so scoring needs no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import WORD, id_remainder, whole_text

#: Most labelled rows that the model is fitted to; chosen by the hash of their id.
SAMPLE = 12_000
FOLDS, HELD_FOLD = 4, 2
ACCEPT = 0.7
TREES, DEPTH, SHRINK, EDGES, LEAST_ROWS = 30, 3, 0.2, 32, 20
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)

#: Statistics of a text as SQL over ``text`` and the arrays ``w`` (words) and ``l`` (lines with a word).
_COUNTED = {
    "n_words": "size(w)",
    "n_distinct": "size(array_distinct(w))",
    "n_echoes": "size(filter(w, (x, i) -> i > 0 AND x = w[i - 1]))",
    "n_lines": "size(l)",
    "n_distinct_lines": "size(array_distinct(l))",
    "n_all": "length(text)",
    "n_symbols": "regexp_count(text, '[#*$%&<>]')",
    "n_bars": "regexp_count(text, '[|]')",
    "n_calls": "regexp_count(text, '[!?]')",
    "n_capitals": r"regexp_count(text, '\\p{Lu}')",
    "n_digits": "regexp_count(text, '[0-9]')",
    "n_stops": "regexp_count(text, '[.,;:]')",
}
STATISTICS = {
    "log_words": "ln(1 + n_words)",
    "word_length": "n_all / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "richness": "ln(1 + n_distinct) / ln(2 + n_words)",
    "echoes": "n_echoes / greatest(n_words, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
    "distinct_lines": "n_distinct_lines / greatest(n_lines, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "calls": "n_calls / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(n_all, 1)",
    "digits": "n_digits / greatest(n_all, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
}


class Condition(NamedTuple):
    statistic: int
    above: float  # value > above
    upto: float  # value <= upto


Conditions = tuple[Condition, ...]


class RuleModel(NamedTuple):
    intercept: float
    rules: tuple[tuple[Conditions, float], ...]

    def column(self) -> Column:
        """The score as an expression over the columns of ``STATISTICS``."""
        names, terms = list(STATISTICS), [f"{self.intercept!r}D"]
        for conditions, weight in self.rules:
            tests = []
            for c in conditions:
                tests += [f"{names[c.statistic]} > {c.above!r}D"] if np.isfinite(c.above) else []
                tests += [f"{names[c.statistic]} <= {c.upto!r}D"] if np.isfinite(c.upto) else []
            terms.append(f"CASE WHEN {' AND '.join(tests)} THEN {weight!r}D ELSE 0D END")
        return F.expr(f"1 / (1 + exp(-({' + '.join(terms)})))")

    def scores(self, values: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests."""
        total = np.full(len(values), self.intercept)
        for conditions, weight in self.rules:
            total += weight * _holds(conditions, values)
        return 1 / (1 + np.exp(-total))


def _holds(conditions: Conditions, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for c in conditions:
        out &= (values[:, c.statistic] > c.above) & (values[:, c.statistic] <= c.upto)
    return out


def _narrowed(conditions: Conditions, statistic: int, above: float, upto: float) -> Conditions:
    old = {c.statistic: c for c in conditions}
    now = old.get(statistic, Condition(statistic, -np.inf, np.inf))
    old[statistic] = Condition(statistic, max(now.above, above), min(now.upto, upto))
    return tuple(old[k] for k in sorted(old))


def _tree(bins: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray) -> Iterator[tuple[Conditions, float, bool]]:
    """Nodes below the root: conditions, mean residual, whether a leaf."""
    level = [((), rows)]
    for depth in range(DEPTH):
        following = []
        for conditions, inside in level:
            best = (1e-9, None)
            total, count = residual[inside].sum(), len(inside)
            for k in range(bins.shape[1]):
                n = np.bincount(bins[inside, k], minlength=EDGES + 1)[:-1].cumsum()
                s = np.bincount(bins[inside, k], residual[inside], EDGES + 1)[:-1].cumsum()
                allowed = (n >= LEAST_ROWS) & (count - n >= LEAST_ROWS)
                gain = np.where(allowed, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(count - n, 1), 0)
                cut = int(gain.argmax())
                if allowed[cut] and gain[cut] - total**2 / count > best[0]:
                    best = (gain[cut] - total**2 / count, (k, cut))
            if best[1] is None:
                if conditions:
                    yield conditions, float(residual[inside].mean()), True
                continue
            k, cut = best[1]
            left = bins[inside, k] <= cut
            for part, low, high in ((inside[left], -np.inf, edges[k][cut]), (inside[~left], edges[k][cut], np.inf)):
                node = _narrowed(conditions, k, float(low), float(high))
                yield node, float(residual[part].mean()), depth == DEPTH - 1
                following.append((node, part))
        level = following


def propose(values: np.ndarray, labels: np.ndarray, seed: int = 1) -> list[Conditions]:
    """Paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(values[:, k], np.linspace(0, 1, EDGES + 1)[1:-1])) for k in range(values.shape[1])]
    edges = [np.append(e, np.full(EDGES - len(e), np.inf)) for e in edges]
    bins = np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    total = np.full(len(labels), np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    found: dict[Conditions, None] = {}
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-total))
        rows = np.flatnonzero(rng.random(len(labels)) < 0.5)
        for node, mean, leaf in _tree(bins, edges, labels - chance, rows):
            found[node] = None
            if leaf:
                inside = _holds(node, values)
                total[inside] += SHRINK * mean / max(1e-3, float((chance * (1 - chance))[inside].mean()))
    return list(found)


def lasso(hits: np.ndarray, labels: np.ndarray, penalty: float, start: np.ndarray, steps: int = 150) -> np.ndarray:
    """Logistic weights (intercept first, not penalised) by accelerated proximal gradient."""
    step = 4.0 / (hits.shape[1] + 1)  # the largest eigenvalue is at most the number of columns / 4
    step = max(step, 4.0 / max(1.0, _largest(hits)))
    weight, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        slack = 1 / (1 + np.exp(-(ahead[0] + hits @ ahead[1:]))) - labels
        grad = np.append(slack.mean(), hits.T @ slack / len(labels))
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, weight, t = new + (t - 1) / t_new * (new - weight), new, t_new
    return weight


def _largest(hits: np.ndarray) -> float:
    """Bound of the largest eigenvalue of the (intercept and) rule columns' mean square."""
    x = np.ones(hits.shape[1] + 1)
    for _ in range(20):
        y = x[0] + hits @ x[1:]
        x = np.append(y.mean(), hits.T @ y / len(hits))
        size = float(np.linalg.norm(x))
        x /= size or 1.0
    return 1.1 * size


def fit(values: np.ndarray, labels: np.ndarray, seed: int = 1) -> RuleModel:
    """Rules and weights; with one class only, its smoothed share; without rows, a score of one half or more."""
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 9) / (len(labels) + 10)
        return RuleModel(float(np.log(share / (1 - share))), ())
    labels = labels.astype(float)
    rules = propose(values, labels, seed)
    hits = np.stack([_holds(r, values) for r in rules], axis=1).astype(float) if rules else np.zeros((len(labels), 0))
    share = hits.mean(axis=0)
    useful = np.flatnonzero((share > 0.002) & (share < 0.998))
    _, first = np.unique(hits[:, useful], axis=1, return_index=True)
    useful = useful[np.sort(first)]
    hits, rules = hits[:, useful], [rules[i] for i in useful]
    inner = np.random.default_rng(seed).random(len(labels)) < 0.8
    if not 0 < labels[inner].sum() < inner.sum():
        inner[:] = True
    start, losses = np.zeros(hits.shape[1] + 1), []
    start[0] = np.log(labels.mean() / (1 - labels.mean()))
    weight, test = start, ~inner if not inner.all() else inner
    for penalty in PENALTIES:
        weight = lasso(hits[inner], labels[inner], penalty, weight)
        chance = 1 / (1 + np.exp(-(weight[0] + hits[test] @ weight[1:])))
        chance = np.clip(chance, 1e-6, 1 - 1e-6)
        losses.append(-np.mean(labels[test] * np.log(chance) + (1 - labels[test]) * np.log(1 - chance)))
    weight = start
    for penalty in PENALTIES[: int(np.argmin(losses)) + 1]:
        weight = lasso(hits, labels, penalty, weight)
    kept = [(rules[i], float(w)) for i, w in enumerate(weight[1:]) if w]
    return RuleModel(float(weight[0]), tuple(kept))


# ---------------------------------------------------------------- on Spark


def text_statistics(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) and the columns of ``STATISTICS``, never null."""
    text = docs.select(F.struct("*").alias("row"), whole_text(F.col("text")).alias("text"))
    parts = text.select(
        "row",
        "text",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("l"),
    )
    counted = parts.select("row", *(F.expr(sql).alias(name) for name, sql in _COUNTED.items()))
    return counted.select("row", *(F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fit to at most ``sample`` labelled rows outside the held-out fold; a document with a label 0 is of class 0."""
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where(id_remainder(F.col("doc_id"), FOLDS) != HELD_FOLD)
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    rows = text_statistics(labelled).select("row.doc_id", "row.quality", *STATISTICS)
    rows = rows.orderBy("doc_id", *STATISTICS).limit(sample).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), rows["quality"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``row`` (all columns of ``docs``), ``score`` and ``predicted`` (1 if the score is ``ACCEPT`` or more)."""
    model = train(docs, labels.select("doc_id", "quality"), sample)
    out = text_statistics(docs).select("row", model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of class 1.

    The row number keeps the filter above the scores: pushed below, it would compute
    the statistics anew for every condition of every rule.
    """
    out = scored(docs, labels, sample).withColumn("n", F.monotonically_increasing_id())
    return out.where("predicted = 1 AND n >= 0").select("row.*")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels with ``crc32(doc_id as text) mod FOLDS == HELD_FOLD`` are never learnt from. Null and empty
    texts are scored by their statistics, all zero. Rows that repeat a doc_id are
    scored each; only ``doc_id, text`` and ``doc_id, quality`` are read; an empty
    table gives no rows, and without labels every document scores 0.9.
    """
    out = scored(docs.select("doc_id", "text"), labels, sample)
    held = id_remainder(F.col("row.doc_id"), FOLDS) == HELD_FOLD
    return out.select("row.doc_id", held.alias("held_out"), "score", "predicted")
