"""Mixing documents to target weights by iterative proportional fitting (raking).

Documents are counted by cell (source, language, topic). The cells' token weights are scaled to the
target share of each value of one column after the other, over and over, until all three
marginals hold. A cell's weight over its share of the tokens is the rate at which its
documents are wanted; divided by the largest rate it is the probability with which each
is kept, so the expected tokens of the sample have the raked marginals and no document is
repeated. With a token budget (the pipeline) rates are scaled to it instead and cut at 1, so
that no tiny cell decides how much is kept. Built-in functions only.
"""

from __future__ import annotations

import logging
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import WORD, stored, whole_text
from weirmark.operators.joins import lookup_join

NONE = "none"
#: Rounds of ``op8_mixing``; the pipeline tests its marginals after every so many, up to ``MAX_ROUNDS``.
ROUNDS, MAX_ROUNDS = 8, 96
#: Relative error of a marginal at which the pipeline's raking ends.
TOLERANCE = 0.001
SEED = "mix-1"
LOG = logging.getLogger(__name__)
ADDED = ("_text", "_source", "_lang", "_topic", "_tokens", "_rate", "_p", "_kept")


class Target(NamedTuple):
    """Share of a value: its tokens to the power ``temper``, times its preference (1 if not named)."""

    column: str
    temper: float
    preference: tuple[tuple[str, float], ...] = ()


TARGETS = (
    Target("source", 0.7),
    Target("lang", 0.8, (("en", 1.2),)),
    Target("topic", 0.9, (("legal", 0.5), ("contact", 0.7))),
)

#: Topic of a text with ``n_tokens`` words, as SQL.
TOPIC = """CASE
  WHEN text RLIKE '[Ll]icen[sc]e|[Cc]opyright|[Rr]ights reserved' THEN 'legal'
  WHEN text RLIKE '@' THEN 'contact'
  WHEN text RLIKE '://' THEN 'web'
  WHEN n_tokens < 100 THEN 'brief'
  WHEN n_tokens < 1000 THEN 'article'
  ELSE 'long' END"""


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_source, _lang, _topic`` (never null) and ``_tokens``."""
    text = docs.withColumn("_text", whole_text(F.col("text")))
    text = text.withColumn("_tokens", F.regexp_count("_text", F.lit(WORD)).cast("long"))
    topic = TOPIC.replace("n_tokens", "_tokens").replace("text ", "_text ")
    return text.withColumns(
        {
            "_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
            "_topic": F.expr(topic),
        }
    ).drop("_text")


def shares(cells: DataFrame, target: Target) -> DataFrame:
    """The target share of each value of the column: value and ``t``."""
    wish = F.lit(1.0)
    for value, times in target.preference:
        wish = F.when(F.col(target.column) == value, F.lit(float(times))).otherwise(wish)
    by_value = cells.groupBy(target.column).agg(F.sum("tokens").cast("double").alias("n"))
    by_value = by_value.select(target.column, (F.pow("n", F.lit(target.temper)) * wish).alias("t"))
    whole = by_value.agg(F.sum("t")).first()[0]
    return by_value.select(target.column, (F.col("t") / F.lit(whole)).alias("t"))


def marginals(cells: DataFrame, weight: str, targets: tuple[Target, ...] = TARGETS) -> DataFrame:
    """``column, value, target, share``: of each value its target share, and its share of the sum of ``weight``."""
    parts = None
    for target in targets:
        now = cells.groupBy(target.column).agg(F.sum(weight).alias("s")).join(shares(cells, target), target.column)
        now = now.select(F.lit(target.column).alias("column"), F.col(target.column).alias("value"), F.col("t").alias("target"), "s")
        parts = now if parts is None else parts.union(now)
    whole = cells.agg(F.sum(weight)).first()[0]
    return parts.select("column", "value", "target", (F.col("s") / F.lit(whole)).alias("share"))


def largest_error(report: DataFrame) -> float:
    """The largest relative error of rows of ``marginals``."""
    return report.agg(F.max(F.abs(F.col("share") / F.col("target") - 1))).first()[0] or 0.0


def rake(
    cells: DataFrame, targets: tuple[Target, ...] = TARGETS, rounds: int = ROUNDS, tolerance: float | None = None
) -> DataFrame:
    """``cells`` (one row each, ``tokens`` over zero) with their raked weight ``w``; the weights add up to one.

    With a ``tolerance`` the rounds go on until no marginal is further off; if it no longer
    falls or ``MAX_ROUNDS`` do not suffice, the targets can hardly be met together, and the remaining error is logged.
    """
    out, error = cells.withColumn("w", F.col("tokens").cast("double")), None
    # every cell carries its target shares, so a round joins each column once; small joins fill the driver, too
    for target in targets:
        out = out.join(shares(cells, target).withColumnRenamed("t", f"_t_{target.column}"), target.column)
    out, kept = stored(out, "shares"), [f"_t_{target.column}" for target in targets]
    for turn in range(rounds if tolerance is None else max(rounds, MAX_ROUNDS)):
        if tolerance is not None and turn >= rounds and turn % rounds == 0:
            before, error = error, largest_error(marginals(out, "w", targets))
            if error <= tolerance:
                return out.drop(*kept)
            if before and error > 0.999 * before:
                break
        for target in targets:
            now = out.groupBy(target.column).agg(F.sum("w").alias("s"), F.max(f"_t_{target.column}").alias("t"))
            factor = now.select(target.column, (F.col("t") / F.col("s")).alias("factor"))
            out = out.join(factor, target.column).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        out = stored(out, "raked")
    if tolerance is not None and (error := largest_error(marginals(out, "w", targets))) > tolerance:
        LOG.warning("raking: a marginal stays off by %.3g of its target", error)
    return out.drop(*kept)


def scale_to(rates: DataFrame, budget: float) -> float:
    """The number by which to multiply each ``_rate``, at most 1 each, so that ``budget`` of all tokens are expected.

    What cells at 1 cannot give is taken from the others in proportion to their rates.
    """
    whole = rates.agg(F.sum("tokens").cast("double")).first()[0]
    if not whole:
        return 1.0
    scale = 0.0
    while True:
        full = F.col("_rate") * F.lit(scale) >= 1
        sums = F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("_rate") * F.col("tokens")))
        sure, open_ = rates.agg(*sums).first()
        if not open_:
            return scale
        better = (budget * whole - float(sure)) / open_
        if better <= scale * (1 + 1e-12):
            return scale
        scale = better


def _chance(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def probabilities(
    marked: DataFrame, targets: tuple[Target, ...] = TARGETS, rounds: int = ROUNDS, budget: float | None = None
) -> DataFrame:
    """``_source, _lang, _topic, _rate, _p`` of each cell with tokens, from rows of ``with_cells``.

    Without a ``budget``, ``rounds`` rounds and rates over the largest one, as the SQL of ``op8_mixing``
    has it. With one, raking to ``TOLERANCE``, and probabilities of at most 1 that
    are expected to keep this share of the tokens; the marginals that result are logged.
    """
    names = [t.column for t in targets]
    cells = marked.where("_tokens > 0").groupBy(*(F.col(f"_{c}").alias(c) for c in names))
    cells = stored(cells.agg(F.sum("_tokens").alias("tokens")), "cells")
    raked = rake(cells, targets, rounds, None if budget is None else TOLERANCE)
    whole = cells.agg(F.sum("tokens").cast("double")).first()[0]
    rates = raked.withColumn("_rate", F.col("w") * F.lit(whole) / F.col("tokens"))
    if budget is not None:
        rates = stored(rates, "rates")
        sure = rates.withColumn("_p", F.least(F.lit(1.0), F.col("_rate") * F.lit(scale_to(rates, budget))))
        report = stored(marginals(sure.withColumn("kept", F.col("_p") * F.col("tokens")), "kept", targets), "marginals")
        off = report.orderBy(F.desc(F.abs(F.col("share") / F.col("target") - 1))).limit(10).collect()
        LOG.info("expected marginals furthest from their targets: %s", [tuple(r) for r in off])
        if off and abs(off[0]["share"] / off[0]["target"] - 1) > 10 * TOLERANCE:
            LOG.warning("%s %s: target %.6g, expected %.6g of the tokens", *off[0])
        return sure.select(*(F.col(c).alias(f"_{c}") for c in names), "_rate", "_p")
    rates = stored(rates.select(*(F.col(c).alias(f"_{c}") for c in names), "_rate"), "rates")
    most = rates.agg(F.max("_rate")).first()[0]
    return rates.withColumn("_p", F.col("_rate") / F.lit(most))


def mixed(
    docs: DataFrame,
    targets: tuple[Target, ...] = TARGETS,
    rounds: int = ROUNDS,
    only: list[str] | None = None,
    budget: float | None = None,
) -> DataFrame:
    """``docs`` (or the columns ``only``) with ``_source, _lang, _topic, _tokens, _rate, _p`` and ``_kept``.

    A null source or language is the value ``none``. A text without a word has no tokens,
    so nothing wants it: its probability is 0. The draw depends on doc_id alone: rows
    that share one are drawn alike, and a run can be repeated. An empty table gives no rows.
    Columns of ``docs`` with one of the added names are replaced.
    """
    docs = docs.drop(*ADDED)
    marked = with_cells(docs)
    slim = stored(marked.select("_source", "_lang", "_topic", "_tokens"), "marked")
    table = probabilities(slim, targets, rounds, budget)
    rows = marked.select(*(only or docs.columns), "_source", "_lang", "_topic", "_tokens")
    out = lookup_join(rows, table, ["_source", "_lang", "_topic"], "left")
    sure = F.when(F.col("_tokens") > 0, F.coalesce("_p", F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumn("_p", sure).withColumn("_kept", _chance(F.col("doc_id")) < F.col("_p"))
