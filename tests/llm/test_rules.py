"""Quality rules, URL rules, rule ensemble."""

import fnmatch
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from weirmark.llm import quality_rules as quality
from weirmark.llm import rule_ensemble as ensemble
from weirmark.llm.oracle import ORACLE
from weirmark.llm.queries import QUERIES
from weirmark.llm.url_rules import Automaton, GlobRule, HostRule, url_verdicts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_agrees(spark, name):
    left = compare.spark_rows(QUERIES[name](spark, SF))
    assert compare.difference(left, compare.duck_rows(compare.connect(SF), ORACLE[name])) is None


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 10, 500, 3000) for k in (0, 1, 5, 40) if k <= 0.05 * n or k == 0]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality._tail(0.05).alias("t")).collect()
    for r in rows:
        exact = sum(comb(r["n"], j) * 0.05**j * 0.95 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert abs(np.exp(r["t"]) - exact) < 1e-9 + 1e-9 * exact


def test_cutoffs_hold_their_risk(spark):
    """A cutoff is chosen only where few good documents lose, and the strictest such one."""
    n = 4000
    stats = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("stratum"),
        *(F.lit(x).cast("long").alias(c) for c, x in {"n_words": 1000, "n_lines": 10, "n_dup_lines": 0, "n_repeat_words": 0, "word_chars": 5000}.items()),
        # one in ten German documents has 300 symbols a thousand words, no English one
        F.when(F.col("id") % 20 == 1, 300).otherwise(0).cast("long").alias("n_symbols"),
    )
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    cuts = {r["stratum"]: r.asDict() for r in quality.cutoffs(stats, labels).collect()}
    assert cuts["en"]["cut_symbols"] == 150
    assert cuts["de"]["cut_symbols"] == 350
    few = quality.cutoffs(stats.where("doc_id < 200"), labels).collect()
    assert few == []  # too few labels to be sure of anything


def test_quality_rules_odd(spark, clashing, no_docs, sf_labels):
    odd = sf_labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None), (5, 0)], "doc_id long, quality int"))
    found = quality.quality_rules(clashing, odd).collect()
    assert len(found) == 10
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["n_words"] == by_id[3]["n_words"] == 0 and by_id[2]["base_failed"]
    assert by_id[9]["n_repeat_words"] == by_id[9]["n_words"] == 1200 and by_id[9]["n_dup_lines"] == 599
    assert not any(r["base_failed"] and r["kept"] for r in found)
    assert quality.quality_rules(no_docs, sf_labels).count() == 0


def test_automaton():
    globs = ["net/**", "*.net/**", "**.jpg", "a*b?c", "**", "", "x\\*y", "*"] + [f"host{i}.*/p{i}/**" for i in range(40)]
    urls = ["net/", "a.net/b", "a/b.net/", "x/y.jpg", "ab?c", "aqqb?c", "a/b?c", "", "x*y", "xzy", "host7.org/p7/q", "host7.org/p8/q", "é.net/"]
    found = Automaton(globs).matches([u.encode() for u in urls])

    def plain(glob, url):
        if not glob:
            return not url
        if glob.startswith("**"):
            return any(plain(glob[2:], url[i:]) for i in range(len(url) + 1))
        if glob[0] == "*":
            stop = min([i for i, c in enumerate(url) if c in "/?#"] or [len(url)])
            return any(plain(glob[1:], url[i:]) for i in range(stop + 1))
        glob = glob[1:] if glob[0] == "\\" else glob
        return bool(url) and url[0] == glob[0] and plain(glob[1:], url[1:])

    for u, url in enumerate(urls):
        assert found[u].tolist() == [plain(g, url) for g in globs], url
    assert fnmatch.fnmatchcase("net/x", "net/*")


def test_url_verdicts(spark):
    urls = {
        1: "http://A.Example.NET/en/x?y#z",
        2: "https://example.net/EN/",
        3: "http://net",
        4: "http://net/",
        5: None,
        6: "no scheme/net/",
        7: "http://x.org/fr/login",
        8: "http://x.org/login",
        9: "",
        10: "http://com.net.au/q.net/",
        11: "http://h.au?next=http://a.net/",
        12: "http://example.com/de/" + "x" * 50_000,
        13: "http://user@net:80/",
    }
    pages = spark.createDataFrame(list(urls.items()) + [(1, urls[1])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r["page_id"]: r for r in url_verdicts(pages).collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"]) == ("a.example.net", "/en/x", "example.net/en/")
    rules = {i: (r["rule"], r["verdict"]) for i, r in rows.items()}
    assert rules[2] == rules[4] == ("net/", "block")
    assert rules[3] == rules[5] == rules[6] == rules[9] == rules[10] == rules[11] == rules[13] == (None, "allow")
    assert rules[7] == ("org/fr/", "allow") and rules[8] == (None, "block") and rules[12] == ("example.com/de/", "block")
    assert url_verdicts(pages).count() == 14 and url_verdicts(pages.limit(0)).count() == 0
    own = url_verdicts(pages, (HostRule("org", "/", "block"),), (GlobRule("**", "block"),)).where("verdict = 'allow'")
    assert own.count() == 0


def test_rule_ensemble_learns():
    rng = np.random.default_rng(5)
    values = rng.random((3000, len(ensemble.STATISTICS)))
    labels = ((values[:, 1] > 0.3) & (values[:, 4] <= 0.8)).astype(float)
    model = ensemble.fit(values[:2000], labels[:2000])
    scores = model.scores(values[2000:])
    assert ((scores >= 0.5) == labels[2000:]).mean() > 0.97
    assert len(model.rules) < 150


def test_compiled_rules_agree(spark):
    rng = np.random.default_rng(6)
    values = rng.random((500, len(ensemble.STATISTICS)))
    model = ensemble.fit(values, (values[:, 2] > 0.4).astype(float))
    frame = spark.createDataFrame(values.tolist(), ", ".join(f"{n} double" for n in ensemble.STATISTICS))
    found = np.array([r[0] for r in frame.select(model.column()).collect()])
    assert np.allclose(found, model.scores(values))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = ensemble.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_do_not_matter(spark, sf_docs, sf_labels):
    held = ensemble.id_remainder(F.col("doc_id"), 4) == 2
    other = sf_labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [
        {r["doc_id"]: r["score"] for r in ensemble.quality_scores(sf_docs, some).collect()} for some in (sf_labels, other)
    ]
    assert scores[0] == scores[1]


def test_ensemble_odd(clashing, no_docs, sf_labels):
    rows = ensemble.quality_scores(clashing, sf_labels).collect()
    assert len(rows) == 10 and all(r["score"] is not None for r in rows)
    assert ensemble.quality_scores(no_docs, sf_labels).count() == 0
    unlabelled = ensemble.quality_scores(clashing, sf_labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in unlabelled} == {0.9}
    assert ensemble.accepted(clashing, sf_labels).columns == clashing.columns
