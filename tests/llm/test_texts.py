"""Token files, pieces, Lempel-Ziv fingerprints, language model, mixing, pipeline."""

import hashlib
import math
import zlib
from collections import Counter
from random import Random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_deduplication import plain_groups, plain_print
from weirmark.llm import language_model as lm
from weirmark.llm import lz_prints as lz
from weirmark.llm import mixing, pieces, token_files
from weirmark.llm.common import fresh_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ token files


def test_pieces_of_text_encode_as_the_whole():
    whole = Tokenizer.from_file(WORDS)
    texts = [
        "It's  THE\tbest x y\n\n don't 're '", "é ́e", "a<|endoftext|>b <|startoftext|>",
        "Σας ΣΑΣ İi", " \n ", "", "12,345.67!! ½ ²", "日本語 テスト。", "a\u0085b\x1cc\x0bd", "x" * 5000,
        "The end. THE END! Été, ÉTÉ; J\u030c, Ab.Cd a_. 9. x|. <|EndOfText|>! don'T. ºª. ①, ſ!",
    ]
    encoder = token_files._Encoder(WORDS)
    for text, ids in zip(texts, encoder.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def plain_tokens(docs):
    whole, start, out = Tokenizer.from_file(WORDS), 0, []
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r in rows:
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark, sf_docs):
    found = token_files.token_digests(spark, sf_docs, WORDS).collect()
    assert sorted(tuple(r)[:4] for r in found) == sorted(plain_tokens(sf_docs))


def test_token_files_odd(spark, clashing, no_docs):
    found = token_files.token_digests(spark, clashing, WORDS).collect()
    assert sorted((tuple(r)[:4] for r in found), key=lambda r: r[1]) == plain_tokens(clashing)
    assert token_files.token_digests(spark, no_docs, WORDS).count() == 0


def test_single_documents_are_read_alone(tmp_path):
    path = str(tmp_path / "a.ids.zst")
    writer = token_files.TokenFileWriter(path, frame_ids=100)
    ids = {i: np.arange(i * 7, i * 7 + i % 90, dtype="<u4") for i in range(200)}
    for i, some in ids.items():
        writer.add(i, some.tobytes())
    writer.close()
    reader, opened = token_files.TokenFileReader(path), []
    plain = reader.frame
    reader.frame = lambda k: opened.append(k) or plain(k)
    found = dict(reader.documents([3, 150, 151]))
    assert all(np.frombuffer(found[i], "<u4").tolist() == ids[i].tolist() for i in (3, 150, 151))
    assert len(reader.frames) > 50 and len(opened) <= 3
    assert {k: v.tolist() for k, v in token_files.read_documents([path], {0, 199}).items()} == {0: [], 199: ids[199].tolist()}
    import zstandard

    with open(path, "rb") as file:
        whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole == b"".join(x.tobytes() for x in ids.values())


def test_damage_is_found(tmp_path):
    path = str(tmp_path / "a.ids.zst")
    writer = token_files.TokenFileWriter(path)
    writer.add(1, np.arange(50, dtype="<u4").tobytes())
    writer.close()
    reader = token_files.TokenFileReader(path)
    reader.frames = reader.frames.copy()
    reader.frames["check"] += 1
    with pytest.raises(ValueError, match="damaged"):
        reader.frame(0)


# ------------------------------------------------------------------ pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(PIECES)


def all_paths(vocabulary, chunk):
    edges = [[(start, score, ids) for _, start, score, ids in ends] for ends in vocabulary.lattice(chunk)]

    def back(place, score, ids):
        if not place:
            yield score, ids
        for start, s, some in edges[place]:
            yield from back(start, score + s, some + ids)

    return sorted(back(len(chunk), 0.0, ()), key=lambda p: -p[0])


@pytest.mark.parametrize("chunk", [" hello", "  wörld", " the▁x", " a\0c", "    ", " 日本語x", "in", " ananan"])
def test_best_paths(vocabulary, chunk):
    every, found = all_paths(vocabulary, chunk), vocabulary.best(chunk, 6)
    assert [p.score for p in found] == [s for s, _ in every[:6]]
    assert len(set(found)) == len(found) and all(tuple(p) in every for p in found)


def test_forward_scores(vocabulary, sf_docs):
    chunks = {c for r in sf_docs.limit(60).collect() for c in pieces._CHUNKS.findall(" " + r["text"])}
    chunks |= {" ", "\n", "▁▁", "日本", " \0", "    x", "x" * 60}
    ordered = sorted(chunks)
    for chunk, (score, loss, ids) in zip(ordered, vocabulary.forward(ordered)):
        paths = vocabulary.best(chunk, 2)
        assert (score, tuple(np.frombuffer(ids, "<u4").tolist())) == tuple(paths[0]), chunk
        assert loss == (paths[0].score - paths[1].score if len(paths) > 1 else np.inf), chunk


@pytest.mark.parametrize("text", ["hello big  world", "a b c", "x", " ", "no no no", "▁ é\n"])
def test_best_paths_of_texts(vocabulary, text):
    encoder = pieces.Encoder(vocabulary, 5)
    found = encoder.encode(encoder.learn([text, "other words"])[0])
    assert [s for s, _ in found] == [s for s, _ in all_paths(vocabulary, " " + text)[:5]]
    assert len({i for _, i in found}) == len(found)
    assert all(vocabulary.decode(np.frombuffer(i, "<u4")) == text for _, i in found)


def test_pieces_odd(clashing, no_docs, sf_docs):
    rows = pieces.encoded(clashing, PIECES).collect()
    assert len(rows) == 10 and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(s == sorted(s, reverse=True) and len(s) == len(r["others"]) + 1 for r in rows for s in [r["scores"]])
    assert pieces.encoded(no_docs, PIECES).count() == 0
    assert pieces.segmentation_digests(sf_docs, PIECES).where("NOT round_trip OR n_paths < 1").count() == 0
    again = pieces.decoded(pieces.encoded(clashing, PIECES), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in again)


# ------------------------------------------------------------------ fingerprints


def plain_phrases(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaaaa", "abcabcabcabc", "é日é日é日", "the cat the cat the dog" * 9])
def test_phrases(text):
    ends = lz.phrase_ends(text)
    parts = [text[a:b] for a, b in zip([0, *ends], ends)]
    assert set(parts) == plain_phrases(text) and len(set(parts)) == len(parts)
    cut = len(text) // 2
    known = [e for e in ends if e <= cut]
    other = text[:cut] + "zebra" * 3
    assert lz.phrase_ends(other, list(known)) == lz.phrase_ends(other)


def test_smallest_hashes_may_be_equal():
    rnd = np.random.default_rng(4)
    for most in (3, 90, 1 << 31):
        for n in (0, 1, 70, 5000):
            hashes = rnd.integers(0, most, n).astype("<u4")
            assert lz.smallest(hashes, 64).tolist() == sorted(set(hashes.tolist()))[:64]


def test_an_edited_text_is_parsed_on_from_the_cut():
    for text, after in (("abab" * 40, "日本 abab" * 9), ("é" * 7, ""), ("", "x"), ("a", "b"), ("日a日b" * 11, "zz" * 50)):
        here, following = lz._Parsed(1, text, 16), lz._Parsed(2, after, 16)
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row, plain = here.row(following), lz.signature(edited, lz.phrase_ends(edited), 16)
        assert row[4] == lz._text(plain) and row[5] == lz.likeness(lz.signature(text, lz.phrase_ends(text), 16), plain, 16)
        assert (here.hashes == lz.phrase_hashes(text, lz.phrase_ends(text))).all() and here.same <= len(here.ends)



def test_likeness_of_short_texts_is_exact():
    a, b = "one two three", "one two four"
    signs = [lz.signature(t, lz.phrase_ends(t)) for t in (a, b)]
    one, two = plain_phrases(a), plain_phrases(b)
    assert lz.likeness(*signs) == len(one & two) / len(one | two)
    assert lz.likeness(signs[0], signs[0]) == 1 and lz.likeness(signs[0], signs[0][:0]) == 0


def check_prints(docs, found):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = {}
    for r in found:
        got.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    assert len(found) == len(rows)
    for at, (i, text) in enumerate(rows):
        text, following = text or "", rows[(at + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        signs = [lz.signature(t, lz.phrase_ends(t)) for t in (text, edited, following)]
        wanted = (hashlib.sha256(edited.encode()).hexdigest(), lz.likeness(*signs[:2]), lz.likeness(signs[0], signs[2]))
        assert wanted in [(r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got[i, len(text)]]


def test_lz_query(sf_docs):
    check_prints(sf_docs, lz.edited_likeness(sf_docs).collect())


def test_lz_odd(clashing, no_docs, make_docs):
    check_prints(clashing, lz.edited_likeness(clashing).collect())
    assert lz.edited_likeness(no_docs).count() == 0
    alone = lz.edited_likeness(make_docs("abcabcabc")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


# ------------------------------------------------------------------ language model


def plain_base(docs):
    rows = docs.select("doc_id", "text").collect()
    split = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for i, text in rows:
        if not held(i):
            counts.update(split(text))
    total, size = sum(counts.values()), len(counts)
    for i, text in rows:
        words = split(text)
        base = sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in words)
        yield (i, held(i), len(words), sum(counts[w] > 0 for w in words), total), base


def check_scores(docs, found):
    got = Counter((*tuple(r)[:5], round(r["base_score"], 5)) for r in found)
    assert got == Counter((*row, round(base, 5)) for row, base in plain_base(docs))
    assert all(r["score"] is not None and r["score"] < 0 for r in found)


def test_language_model_query(sf_docs):
    found = lm.language_scores(sf_docs).collect()
    check_scores(sf_docs, found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_with_a_small_head(sf_docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 200)
    monkeypatch.setattr(lm, "COUNTED", 1000)
    check_scores(sf_docs, lm.language_scores(sf_docs).collect())


def test_language_model_odd(clashing, no_docs):
    check_scores(clashing, lm.language_scores(clashing).collect())
    assert lm.language_scores(no_docs).count() == 0


def test_class_model_is_normalised_and_learns():
    counts = np.zeros((lm.CLASSES + 1, lm.CLASSES + 1, lm.CLASSES), np.int64)
    for near in range(lm.CLASSES):
        counts[:, near, (near + 1) % lm.CLASSES] = 50
        counts[:, near, 0] += 10
    model = lm.fit(counts)
    far, near = np.arange(100), np.arange(100)
    table = model.log10(far, near)
    assert np.allclose((10**table).sum(axis=1), 1)
    assert (table[np.arange(1, 100), np.arange(2, 101)] > np.log10(0.3)).mean() > 0.9


# ------------------------------------------------------------------ mixing


def test_marginals_hold(spark):
    rng = np.random.default_rng(2)
    cells = [(f"s{i}", lang, t, int(rng.integers(50, 5000))) for i in range(5) for lang in ("en", "de") for t in ("x", "y", "z")]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    raked = mixing.rake(frame, rounds=12)
    for target in mixing.TARGETS:
        now = {r[0]: r[1] for r in raked.groupBy(target.column).agg(F.sum("w")).collect()}
        wanted = {r[0]: r[1] for r in mixing.shares(frame, target).collect()}
        assert now.keys() == wanted.keys() and all(abs(now[k] - wanted[k]) < 1e-6 for k in now)


def test_a_round_of_raking_joins_each_column_once(spark, monkeypatch):
    rows = [(a, b, c, 1 + len(a + b + c)) for a in ("web", "book") for b in ("en", "de") for c in ("x", "yy")]
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    plans = []
    stored = mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), stored(df, name))[1])
    raked = mixing.rake(frame, rounds=2)
    # the plan of a column holds that of the one before twice: 1, 3, 7; with the shares joined in each round it was 14
    assert [plan.count("Join Inner") for name, plan in plans if name == "raked"] == [2 ** len(mixing.TARGETS) - 1] * 2
    assert set(raked.columns) == {"source", "lang", "topic", "tokens", "w"}


def test_mixing_odd(clashing, no_docs):
    found = mixing.mixed(clashing).collect()
    assert len(found) == 10
    empty = [r for r in found if r["_tokens"] == 0]
    assert len(empty) == 3 and not any(r["_kept"] or r["_p"] for r in empty)
    assert max(r["_p"] for r in found) == 1
    same = {r["_kept"] for r in found if r["doc_id"] == 5}
    assert len(same) == 1
    assert mixing.mixed(no_docs).count() == 0


def test_raking_goes_on_until_marginals_hold(spark):
    """Sources mostly in one language: 8 rounds leave a marginal 1.8 % off."""
    frame = spark.createDataFrame(
        [(f"s{i}", lang, t, n * (i + 1)) for i in range(4) for lang, n in (("en" if i % 2 else "de", 80_000), ("fr", 20_000)) for t in ("x", "y")],
        "source string, lang string, topic string, tokens long",
    )
    error = lambda w: mixing.largest_error(mixing.marginals(w, "w"))
    assert error(mixing.rake(frame)) > 0.01
    assert error(mixing.rake(frame, tolerance=0.001)) <= 0.001


def test_a_tiny_cell_leaves_the_budget(sf_docs, spark):
    tiny = spark.createDataFrame([(10**9, "mot " * 50, "xx", "rare", 200)], sf_docs.schema)
    marked = mixing.with_cells(sf_docs.union(tiny))
    table = mixing.probabilities(marked, budget=0.5)
    cells = marked.join(table, ["_source", "_lang", "_topic"]).agg(F.sum(F.expr("_p * _tokens")), F.sum("_tokens"), F.max("_p")).first()
    assert abs(cells[0] / cells[1] - 0.5) < 1e-6 and cells[2] <= 1
    assert corpus_pipeline.mixing(spark, sf_docs.union(tiny), "").count() > 0.35 * sf_docs.count()


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < 200 and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["decoded"] == r["text"] for r in rows)


def test_each_stage_with_odd_rows(spark, clashing, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, "/root/testdata/sf0.001")
        assert out.columns[:5] == corpus_pipeline.COLUMNS and out.count() <= 10
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0


def test_stages_match_brute_force(spark, make_docs, tmp_path):
    """Copies, near copies and shared passages in a small corpus whose result is known."""
    words = lambda seed, n=300: " ".join(f"w{x}" for x in Random(seed).choices(range(5000), k=n))
    passage = words(99, 80)
    docs = make_docs(
        (0, words(1), "en", "a"),
        (1, words(1), "en", "a"),
        (2, words(1) + " changed", "en", "b"),
        (3, words(2) + " " + passage + " " + words(3), "en", "b"),
        (4, words(4) + " " + passage + " " + words(5), "en", "b"),
        (5, words(6), "de", "b"),
    )
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    rows = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_groups(rows))) == [0, 3, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, kept, "").collect()}
    assert cut[0] == words(1) and cut[5] == words(6)
    # the repeat may run on for the few characters that the neighbours happen to share
    assert passage[5:-5] not in cut[3] and passage[5:-5] not in cut[4]
    assert cut[3].startswith(words(2)[:-8]) and cut[4].endswith(words(5)[8:])
