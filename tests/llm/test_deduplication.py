"""SimHash groups and repeated passages against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weirmark.llm import hashing, simhash
from weirmark.llm.repeats import repeated_bytes_removed


def plain_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))
    ]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(rows, bits=3):
    """component by row, for (id, fingerprint) rows."""
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= bits:
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        least[r] = key if least.get(r) is None else min(least[r], key if key is not None else least[r])
    return [least[root(i)] for i in range(len(rows))]


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removal(docs, length=200):
    done = repeated_bytes_removed(docs, length).withColumn("sha", F.sha2("kept", 256))
    return [tuple(r) for r in done.select("doc_id", "n_bytes", "n_removed", "n_spans", "sha").collect()]


def test_vectorised_hash():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, np.uint8).tobytes()
    starts, lengths = rng.integers(0, 4900, 400), rng.integers(0, 60, 400)
    found = hashing.xxh64_slices(data, starts, lengths, 42)
    assert found.tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, lengths)]


@pytest.mark.parametrize("bits", [3, 7])
def test_trie_finds_all_links(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 60)  # several nodes
    rng = np.random.default_rng(bits)
    keys = rng.integers(0, 1 << 63, 150, np.uint64) * np.uint64(2)
    for _ in range(2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, bits + 3), False)) for _ in keys], np.uint64)
        keys = np.unique(np.concatenate([keys, keys ^ flips]))
    values = keys.view("<i8").tolist()
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fingerprint long")
    found = {r["doc_id"]: r["component_id"] for r in simhash.grouped(prints, max_bits=bits).collect()}
    wanted = plain_groups(list(enumerate(keys.tolist())), bits)
    assert [found[i] for i in range(len(values))] == wanted
    assert len(set(wanted)) < len(values)


def test_simhash_query(spark, sf_docs):
    rows = [(r["doc_id"], plain_print(r["text"])) for r in sf_docs.select("doc_id", "text").collect()]
    wanted = {(i, f"{p:016x}", c) for (i, p), c in zip(rows, plain_groups(rows))}
    assert {tuple(r) for r in simhash.simhash_groups(sf_docs).collect()} == wanted


def test_simhash_odd(clashing, no_docs):
    found = simhash.simhash_groups(clashing).collect()
    rows = [(r["doc_id"], plain_print(r["text"])) for r in clashing.select("doc_id", "text").collect()]
    wanted = [(i, f"{p:016x}", c) for (i, p), c in zip(rows, plain_groups(rows))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    assert simhash.simhash_groups(no_docs).count() == 0


def test_deduplicated_keeps_one_of_each(clashing, no_docs, make_docs):
    kept = simhash.deduplicated(clashing)
    assert kept.columns == [c for c in clashing.columns if c != "_row"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 4, 5, None, 8, 9], key=str)
    assert simhash.deduplicated(no_docs).count() == 0
    text = " ".join(f"w{i}" for i in range(4000))
    near = make_docs((7, text.replace("w77 ", "other "), "en", "a"), (3, text, "en", "a"), (9, text.upper() + " ", "en", "a"))
    assert [r["doc_id"] for r in simhash.deduplicated(near).collect()] == [3]


def test_deduplicated_equals_groups(sf_docs):
    """Of each component of the query the document that names it stays."""
    wanted = {r["component_id"] for r in simhash.simhash_groups(sf_docs).collect()}
    kept = [r["doc_id"] for r in simhash.deduplicated(sf_docs).collect()]
    assert set(kept) == wanted and len(kept) == len(wanted) < sf_docs.count()


def test_large_ids_beside_null_ones(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big + 1, "a b c d"), (None, "a b c d"), (big, "a b c d"), (-(2**63) + 1, "x y z")], "doc_id long, text string").coalesce(1)
    found = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert found == {(big + 1, big), (None, big), (big, big), (-(2**63) + 1, -(2**63) + 1)}


def test_repeats_query(sf_docs):
    rows = sf_docs.select("doc_id", "text").collect()
    wanted = [(r["doc_id"], *x) for r, x in zip(rows, plain_removal([r["text"] for r in rows], 200))]
    assert sorted(removal(sf_docs.select("doc_id", "text"))) == sorted(wanted)
    assert sum(x[2] for x in wanted) > 0


@pytest.mark.parametrize("length", [1, 2, 7, 64, 200])
def test_repeats_lengths(make_docs, length):
    rng = np.random.default_rng(length)
    word = lambda n: "".join(rng.choice(list("abé"), n))
    shared = [word(n) for n in (250, 400, 199, 200)]
    texts = [None, "", "a" * 500]
    for k in range(30):
        texts.append(word(rng.integers(0, 300)) + shared[k % 4] + word(rng.integers(0, 50)) + shared[(k * 7) % 3])
    texts += texts[3:6]
    found = sorted(removal(make_docs(*texts), length))
    assert found == [(i, *x) for i, x in enumerate(plain_removal(texts, length))]


def test_repeats_odd(clashing, no_docs):
    done = repeated_bytes_removed(clashing, as_text=True)
    assert set(clashing.columns) - {"text"} | {"kept", "n_bytes", "n_removed", "n_spans"} == set(done.columns)
    rows = clashing.collect()
    wanted = Counter((r["doc_id"], *x[:3]) for r, x in zip(rows, plain_removal([r["text"] for r in rows], 200)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in done.collect()) == wanted
    assert repeated_bytes_removed(no_docs).count() == 0


def test_cut_characters_vanish(make_docs):
    shared = "é" * 150
    texts = ["a" + shared + "b", "\xe9"[0] + "c" + shared]
    kept = [r["kept"] for r in repeated_bytes_removed(make_docs(*texts), 201, as_text=True).orderBy("doc_id").collect()]
    assert all("�" not in k for k in kept)
