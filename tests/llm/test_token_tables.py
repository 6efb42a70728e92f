"""Token counts and alignment against the libraries on whole texts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weirmark.llm import alignment, token_counts
from weirmark.llm.common import ByteCache, heaviest, slices_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "a", "▁", "\n", "é", "the", "<|endoftext|>", "<s>", "\0", "日本", "　", "\x85", "\t", "x" * 70, "'s", "don't", "123", "…", "\x1c", " of", "."]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def strange():
    random.seed(3)
    return ["".join(random.choices(ODD, k=random.randint(0, 14))) for _ in range(1500)]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


# ---------------------------------------------------------------- counts


def test_counter_equals_library(model, strange):
    counter = token_counts.TokenCounter(B)
    assert counter.splits
    for _ in range(2):  # the second time from the cache
        assert counter.count(strange) == [len(model.encode(t)) for t in strange]


def test_first_tier_equals_second(model, strange):
    words = sorted({w for t in strange for w in token_counts.pre_tokens(t) if w})
    import numpy as np

    packed = b"".join(w.encode() for w in words), np.cumsum([len(w.encode()) for w in words]), np.array([len(model.encode(w)) for w in words])
    counter = token_counts.TokenCounter(B, packed)
    assert counter.count(strange) == [len(model.encode(t)) for t in strange] and not counter.cache.young


@pytest.mark.parametrize("counted", [1 << 17, 3])
def test_counts_of_tables(spark, model, odd_docs, sf_docs, monkeypatch, counted):
    monkeypatch.setattr(token_counts, "COUNTED", counted)
    for docs in (odd_docs, sf_docs):
        found = token_counts.document_counts(docs, B).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        want = Counter((i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts)
        assert Counter(map(tuple, found)) == want


def test_frequent_words_reach_the_table(spark, sf_docs):
    frequent = {r["word"]: r["n"] for r in token_counts.frequent_pre_tokens(sf_docs).collect()}
    exact = Counter(w for r in sf_docs.select("text").collect() for w in token_counts.pre_tokens(r["text"] or ""))
    for word, n in exact.most_common(50):
        assert frequent[word] == n


def test_columns_are_handed_through(spark, make_docs):
    """Ids beyond 2^53 beside null ones, microseconds, NaN, binary, arrays and structs; a column of the output's name goes."""
    docs = spark.createDataFrame([(9007199254740993, "a b"), (None, None), (-9223372036854775807, "")], "doc_id long, text string").withColumns(
        {
            "at": F.expr("timestamp '2024-01-02 03:04:05.123456'"),
            "x": F.expr("double('NaN')"),
            "raw": F.expr("X'00ff'"),
            "list": F.expr("array(1L, null)"),
            "pair": F.expr("struct(9007199254740993L AS big, cast(null as string) AS s)"),
            "n_tokens": F.lit("clash"),
        }
    )
    found = token_counts.token_counts(docs, B)
    assert found.columns == [*[c for c in docs.columns if c != "n_tokens"], "n_tokens"]
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {9007199254740993: 2, None: 0, -9223372036854775807: 0}
    assert found.drop("n_tokens").exceptAll(docs.drop("n_tokens")).isEmpty()


def test_empty_tables(spark, no_docs, clashing):
    assert token_counts.document_counts(no_docs, B).isEmpty()
    assert alignment.document_alignment(no_docs, A, B).isEmpty()
    assert token_counts.document_counts(clashing, B).count() == alignment.document_alignment(clashing, A, B).count() == 10


# ---------------------------------------------------------------- alignment


def spelled(aligner, text):
    """Ids of both sides and bytes of each token, by the libraries on the whole text; None where bytes change."""
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    sides = [[table[i] for i in ids] for ids, table in ((a, aligner.bytes_a), (b, aligner.bytes_b))]
    return (a, b, *sides) if text and all(b"".join(s) == (" " + text).encode() for s in sides) else None


def brute(aligner, text):
    """Tokens of both sides, groups and linked pairs of ids, by comparing all tokens."""
    found = spelled(aligner, text)
    if not found:
        return 0, 0, [], []
    a, b, side_a, side_b = found
    spans = []
    for side in (side_a, side_b):
        ends = [sum(map(len, side[: k + 1])) for k in range(len(side))]
        spans.append([(e - len(t), e) for e, t in zip(ends, side)])
    links = [(x, y) for x, s in zip(a, spans[0]) for y, t in zip(b, spans[1]) if max(s[0], t[0]) < min(s[1], t[1])]
    groups, before = [], 0
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        parts = [",".join(str(i) for i, (_, e) in zip(ids, span) if before < e <= end) for ids, span in zip((a, b), spans)]
        groups.append("|".join(parts))
        before = end
    return len(a), len(b), groups, links


def test_texts_equal_brute_force(aligner, strange):
    for _ in range(2):
        for text, found in zip(strange, aligner.texts(strange)):
            n_a, n_b, groups, links = brute(aligner, text)
            assert (found.n_a, found.n_b, found.n_groups, found.n_links) == (n_a, n_b, len(groups), len(links)), repr(text)
            assert found.groups == "".join(g + ";" for g in groups)


def expected(aligner, texts):
    """What the contract says of each text of a corpus."""
    all_links = [brute(aligner, t or "") for t in texts]
    counts = Counter(pair for *_, links in all_links for pair in links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    for n_a, n_b, groups, links in all_links:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(counts[p] == top[p[1]] for p in links)
        yield n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), sha


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_documents_equal_brute_force(spark, aligner, make_docs, strange, frequent):
    texts = strange[:300] + ["the same text of several words."] * 150 + [None, "", "Wor▁d"] + strange[:40]
    docs = make_docs(*texts).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id") + 2**53)).repartition(6)
    found = alignment.document_alignment(docs, A, B, frequent).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    ids = [i + 2**53 if i else None for i in range(len(texts))]
    want = Counter((i, *row) for i, row in zip(ids, expected(aligner, texts)))
    assert Counter(tuple(r[c] for c in names) for r in found) == want


def test_long_text(spark, make_docs, aligner):
    texts = ["x" * 30_000, "word " * 20_000, "\n" * 3000]
    found = {r["doc_id"]: r for r in alignment.document_alignment(make_docs(*texts), A, B).collect()}
    for i, text in enumerate(texts):
        assert (found[i]["n_a"], found[i]["n_b"]) == (len(aligner.a.encode(" " + text, add_special_tokens=False).ids), len(aligner.b.encode(text)))


def test_real_outputs(spark, make_docs, aligner):
    texts = ["The cat sat.", "The cat sat.", "Another one"]
    aligned = alignment.aligned_texts(make_docs(*texts), A, B, keep_groups=True)
    found = {r["copies"]: r for r in aligned.collect()}
    assert found[2]["groups"] == ";".join(brute(aligner, texts[0])[2])
    counts = {(r["a"], r["b"]): r["count"] for r in alignment.pair_counts(aligned).collect()}
    assert counts == Counter(p for t in texts for p in brute(aligner, t)[3])


# ---------------------------------------------------------------- helpers


def test_cache_is_bounded_and_forgets_the_oldest():
    cache = ByteCache(100)
    for k in range(30):
        cache.add({k: k}, 10)
        assert cache.find({0})[0] == {0: 0}  # asked for again and again, so it stays
    assert len(cache.young) + len(cache.old) <= 10 and cache.find({29, 3}) == ({29: 29}, [3])
    cache.add({"large": 1}, 51)
    assert cache.find({"large"})[1] == ["large"]


def test_heaviest_rows(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 3, 5, 9, 900])], "id int, n long")
    for limit in range(9):
        head, tail = heaviest(counts, "n", limit)
        kept = sorted(r["n"] for r in head.collect())
        rest = sorted(r["n"] for r in tail.collect()) if tail is not None else []
        assert len(kept) <= limit and sorted(kept + rest) == [1, 1, 2, 3, 5, 9, 900]
        assert not kept or not rest or min(kept) > max(rest)
    assert heaviest(counts.limit(0), "n", 5)[1] is None


def test_slices():
    assert list(slices_of([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)] and list(slices_of([], 5)) == []
