"""Quality rules whose cutoffs limit the false rejection of good documents.

Each rule rejects a document if a statistic is over the cutoff of its stratum
(language). Labelled documents are the holdout: for a cutoff that rejects k of a
stratum's n good documents, ``P(Binomial(n, risk) <= k)`` is the exact p-value of
"the rule rejects more than ``risk`` of the good ones". A cutoff is taken only if
that is at most ``error``, shared out over all rules and strata (Bonferroni).
Cutoffs are tried from the most lenient on; as k can only grow, this
fixed sequence needs no further correction. So with probability ``1 - error`` no
rule rejects more than ``risk`` of the good documents of any stratum.

Built-in functions only.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import WORD, stored, whole_text

#: Strata; every other language, and null, is the last one. This bounds the table of cutoffs.
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
RISK = 0.005
ERROR = 0.05
WINDOW = 5


class Rule(NamedTuple):
    """Rejects where ``share`` (per thousand, whole numbers) is over the chosen cutoff."""

    name: str
    share: str
    cutoffs: tuple[int, ...]


#: Shares in thousandths of words or lines, so that every engine compares whole numbers.
RULES = (
    Rule("symbols", "n_symbols * 1000 DIV greatest(n_words, 1)", (5000, 2000, 1000, 700, 500, 350, 250, 150)),
    Rule("repeats", "n_repeat_words * 1000 DIV greatest(n_words, 1)", (180, 160, 140, 120, 100, 80, 60, 40)),
    Rule("lines", "n_dup_lines * 1000 DIV greatest(n_lines, 1)", (900, 700, 500, 400, 300, 200, 150, 100)),
    Rule("width", "word_chars * 1000 DIV greatest(n_words, 1)", (40000, 30000, 20000, 15000, 12000, 10000, 9000, 8000)),
)


def _repeated(words: str) -> Column:
    """Words that lie in a window found twice or more.

    Windows are compared by 64-bit hashes; the sorting is done only for
    texts in which some hash occurs twice.
    """
    cells = ", ".join(f"{words}[i + {k}]" for k in range(WINDOW))
    grams = f"transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64({cells}))"
    return F.expr(f"CASE WHEN size({words}) >= {WINDOW} THEN {grams} ELSE array() END")


def text_statistics(docs: DataFrame, *also: str) -> DataFrame:
    """Whole-number statistics of each document's whole text, beside ``doc_id`` and ``also``."""
    same = "(e.h <=> get(s, k - 1).h) OR (e.h <=> get(s, k + 1).h)"
    step = f"least({WINDOW}, coalesce(get(p, k + 1), x + {WINDOW}) - x)"
    out = docs.select("doc_id", *also, whole_text(F.col("text")).alias("text"))
    out = out.select(
        "doc_id",
        *also,
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("l"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
    )
    out = out.select(
        "doc_id",
        *also,
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated("w").alias("g"),
    )
    sort = "CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (h, i) -> struct(h, i))) END"
    out = out.withColumn("s", F.expr(sort)).drop("g")
    out = out.withColumn("p", F.expr(f"sort_array(transform(filter(s, (e, k) -> {same}), e -> e.i))")).drop("s")
    covered = f"aggregate(transform(p, (x, k) -> {step}), 0, (a, x) -> a + x)"
    return out.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0)").cast("long")).drop("p")


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit(OTHER))


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def _tail(risk: float) -> Column:
    """log P(Binomial(n, risk) <= k), summed term by term; for k of at most ``risk * n``."""
    odds = log(risk) - log(1 - risk)
    start = f"n * {log(1 - risk)!r}D"
    term = f"a.t + ln((n - j + 1) / CAST(j AS DOUBLE)) + {odds!r}D"
    add = f"greatest(a.s, {term}) + ln(1 + exp(-abs(a.s - ({term}))))"
    return F.expr(
        f"aggregate(CASE WHEN k > 0 THEN sequence(1L, k) ELSE array() END, named_struct('t', {start}, 's', {start}),"
        f" (a, j) -> named_struct('t', {term}, 's', {add}), a -> a.s)"
    )


def cutoffs(
    stats: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """One row per stratum with labels and a column ``cut_<rule>`` each (null: no safe cutoff).

    A document counts as good if none of its labels is 0. Documents that fail the
    fixed checks take no part.
    """
    good = labels.select("doc_id", "quality").where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    held = stats.where(~base_failed()).join(good.where("q = 1").select("doc_id"), "doc_id", "left_semi")
    counts = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(cut).cast("long").alias("cut"),
            F.sum(F.expr(f"CAST(({rule.share}) > {cut} AS BIGINT)")).alias("k"),
        )
        for rule in rules
        for cut in rule.cutoffs
    ]
    tests = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*counts).alias("c"))
    tests = tests.select("stratum", "n", F.inline("c")).where(F.expr(f"k <= {risk!r}D * n"))
    allowed = log(error / (len(rules) * (len(STRATA) + 1)))
    safe = tests.where(_tail(risk) <= F.lit(allowed))
    return safe.groupBy("stratum").agg(
        *(F.min(F.when(F.col("rule") == rule.name, F.col("cut"))).alias(f"cut_{rule.name}") for rule in rules)
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """One row per document: its statistics, ``base_failed``, ``rejected_by`` and ``kept``.

    Null and empty texts have no words and fail the fixed checks. A document whose
    stratum has too few labels is judged by the fixed checks alone. Rows that share a
    doc_id are judged each by its own text; an empty table gives no rows. Only
    ``doc_id, text, lang`` and ``doc_id, quality`` are read.
    """
    stats = stored(text_statistics(docs.select("doc_id", "text", stratum(F.col("lang")).alias("stratum")), "stratum"), "statistics")
    cuts = cutoffs(stats, labels, rules, risk, error)  # a row for each of STRATA and OTHER at most
    failing = [F.when(F.expr(f"({rule.share}) > cut_{rule.name}"), F.lit(rule.name)) for rule in rules]
    judged = stats.join(F.broadcast(cuts), "stratum", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        F.array_compact(F.array(*failing)).alias("rejected_by"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
