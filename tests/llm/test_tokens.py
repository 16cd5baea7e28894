"""BPE, wavelet shards, fertility and language identification."""

import random
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, fertility, langid, wavelet

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(BYTE)
TEXTS = ["", " ", "a", "x  y\n\n z\t", "a \nb", "<|endoftext|> hi<|endoftext|>", "it's we'LL", "=-" * 700, "\x1c a\x1d", "\x85 \xa0b", "é" * 400, "ab" * 999, "日本語 " * 40, "́a", "🙂‍🙂"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab thern.,'=-*0 \n\té🙂")), max_size=200) | st.text(max_size=60))
def test_encoding_equals_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    model = bpe.load(BYTE)
    ids = [*chain.from_iterable(model.encode(text))]
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    back = model.decoder()
    assert "".join(back.push([i]) for i in ids) + back.end() == text


@pytest.mark.parametrize("text", TEXTS)
def test_transducer_on_every_piece(text):
    model = bpe.load(BYTE)
    for piece in bpe.PIECES.findall(text):
        stream = bpe.Transducer(model)
        got = [*stream.push(piece.encode()), *stream.end()]
        assert got == LIBRARY.encode(piece, add_special_tokens=False).ids or "endoftext" in text
        assert len(stream.last) <= 3 * model.lookahead


def test_every_character_is_split_as_the_library_does():
    model = bpe.load(BYTE)
    points = [c for c in chain(range(0x10000), range(0x10000, 0x110000, 17)) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 32):
        text = "".join(f"ab {chr(c)}9{chr(c)}a {chr(c)} {chr(c)}{chr(c)}\n{chr(c)}  x" for c in points[k : k + 32])
        assert [*chain.from_iterable(model.encode(text))] == LIBRARY.encode(text, add_special_tokens=False).ids, hex(points[k])


def test_all_bytes_pass_the_transducer():
    model, rng = bpe.ByteBPE(BYTE), random.Random(5)
    pieces = {" " + "".join(rng.choice("abdeéнst") for _ in range(rng.randrange(1, 30))) for _ in range(500)}
    assert LIBRARY.encode("".join(pieces), add_special_tokens=False).ids == [*chain.from_iterable(model.encode("".join(pieces)))]
    assert model.pushed == sum(len(p.encode()) for p in pieces)


@pytest.mark.parametrize("unit", ["a", "xyz", "日本", "aB", "nothing"])
def test_memory_does_not_grow_with_a_piece(unit):
    model, text = bpe.load(BYTE), unit * (30_000 // len(unit))
    stream, ids = bpe.Transducer(model), []
    for k in range(0, len(text), 500):
        ids += stream.push(text[k : k + 500].encode())
        assert len(stream.held) <= 6 * model.lookahead and len(stream.last) == len(stream.held) + 1
    assert ids + stream.end() == [*chain.from_iterable(model.encode(text))] == LIBRARY.encode(text, add_special_tokens=False).ids
    long_ = (unit + "1") * 60_000  # no space to cut at
    assert [*chain.from_iterable(model.encode(long_))] == LIBRARY.encode(long_, add_special_tokens=False).ids


def test_decoder_on_any_ids():
    model, rng = bpe.load(BYTE), random.Random(1)
    ids = [rng.randrange(50257) for _ in range(4000)]
    back = model.decoder()
    assert "".join(back.push([i]) for i in ids) + back.end() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_windows_of_long_texts():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "c", " ", " ", "\n", "  "]) for _ in range(150_000))
    assert [*chain.from_iterable(bpe.load(BYTE).encode(text))] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_tables(spark):
    rows = [(k, t, "x") for k, t in enumerate([None, *TEXTS])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode_texts(df, BYTE, carry=("doc_id",))
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(coded, BYTE).collect()} == {k: t or "" for k, t, _ in rows}
    sums = {r["doc_id"]: r for r in bpe.digests(df, BYTE).collect()}
    assert sums[0]["n_tokens"] == 0 and len(sums) == len(rows)
    assert bpe.digests(df.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 512, 513, 3000])
def test_wavelet_matrix(n):
    v = np.random.default_rng(n).zipf(1.4, n) % 3000
    shard = wavelet.Shard(wavelet.pack_shard(v.astype(np.uint16), np.array([n]), pa.array([None], pa.int64())))
    assert (shard.read() == v).all() and (shard.document(0) == v).all() and shard.doc_ids.null_count == 1
    for lo, hi in ((0, n // 2), (n // 3, n), (n // 2, n // 2), (n // 4, n // 4 + n // 7), (max(n - 1, 0), n)):
        assert (shard.read(lo, hi) == v[lo:hi]).all()
    for i in range(0, n, 97):
        assert shard.access(i) == v[i]
    for token in {1, 2, 2999, *v[:3].tolist()}:
        assert list(shard.occurrences(token)) == np.flatnonzero(v == token).tolist()
        assert shard.count(token, n // 3, n) == int((v[n // 3 :] == token).sum())
    with pytest.raises(ValueError, match="shard"):
        wavelet.Shard(b"none")


def test_word_encoder_equals_the_library():
    library, rng = Tokenizer.from_file(WORD), random.Random(3)
    texts = [*TEXTS, "İ ΑΣ ΑΣΑ", "Á éx", "ǅ Ⅷ 1²", "꟎ \U00010940"] + ["".join(rng.choice("abÉ é'sT,.9\n") for _ in range(80)) for _ in range(200)]
    ids, ends = wavelet.encoder(WORD).encode(pa.array([None, *texts], pa.string()), 1)
    parts = np.split(ids, ends[:-1])
    assert [p.tolist() for p in parts] == [[1]] + [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_shards_in_spark(spark):
    rng, library = random.Random(4), Tokenizer.from_file(WORD)
    rows = [(k, " ".join(rng.choice(["the", "red", "bolt", "x9", "Ünder"]) for _ in range(rng.randrange(0, 60))), "p") for k in range(300)] + [(300, None, "p"), (301, "", "p")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(5)
    shards = wavelet.write_shards(df, WORD, shard_tokens=500, chunk=400)
    assert shards.count() > 5
    got = sorted(map(tuple, wavelet.read_documents(wavelet.shard_starts(shards), tokens=100).collect()))
    start, want = 0, []
    for k, text, _ in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c")], "doc_id long, text string")
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in wavelet.read_documents(wavelet.shard_starts(wavelet.write_shards(same, WORD))).collect())
    assert got == [(0, 3, None), (3, 3, None), (6, 2, 7)]
    assert wavelet.read_documents(wavelet.shard_starts(wavelet.write_shards(same.limit(0), WORD))).count() == 0


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    often, cover, seen, lines = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set(), set(), 0
    for k in range(len(w) - 4):
        if often[tuple(w[k : k + 5])] > 1:
            cover |= set(range(k, k + 5))
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), lines, len(cover)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\x0b #é")), max_size=120))
def test_base_counts(text):
    assert fertility.measure(text, fertility.pieces(PIECE))[:5] == brute_counts(text)


def test_fertility_verdicts(spark):
    rng = random.Random(5)
    vocab = ["river", "stone", "early", "morning", "people", "walk", "under", "green", "hill", "with"]
    clean = [" ".join(rng.choice(vocab) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(20, 200))) for _ in range(300)]
    junk = " ".join("".join(rng.choice("qxzjkvw#~^0123456789") for _ in range(12)) for _ in range(150))
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(900, junk, "en"), (901, "words " * 100, "en"), (902, None, "en"), (903, "", None), (904, "short text", "xx"), (905, clean[0], None), (906, "Привет мир " * 3 + clean[1], None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, entropy double")
    got = {r["doc_id"]: r for r in fertility.judge(df, PIECE).collect()}
    assert len(got) == len(rows)
    assert sum(not got[k]["kept"] for k in range(300)) <= 3
    assert not got[900]["kept"] and not got[900]["base_failed"]
    assert all(got[k]["base_failed"] for k in (901, 902, 903, 904))
    assert got[905]["kept"] and got[905]["band"] == "script:latin"
    assert fertility.judge(df.limit(0), PIECE).count() == 0


def test_every_text_has_a_band(spark):
    rng = random.Random(11)
    vocab = ["river", "stone", "early", "morning", "people", "walk", "under", "green", "hill", "with"]
    other = ["река", "камень", "утро", "люди", "холм", "зелёный", "рано", "идти", "дом", "лес"]
    text = lambda v: " ".join(rng.choice(v) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(60, 200)))
    junk = lambda: " ".join("".join(rng.choice("qxzjkvw#~^0123456789") for _ in range(12)) for _ in range(150))
    clean = [(k, text(vocab), "en") for k in range(150)] + [(200 + k, text(other), "ru") for k in range(12)] + [(300, text(vocab), "yy")]
    odd = [(400, junk(), "zz"), (401, junk(), None), (402, junk(), "ru")]
    schema = "doc_id long, text string, lang string"
    for rows in (clean + odd, clean[:20] + odd[:1]):  # also where no group has 100 texts
        got = {r["doc_id"]: r["kept"] for r in fertility.judge(spark.createDataFrame(rows, schema), PIECE).collect()}
        assert len(got) == len(rows) and sum(not got[k] for k in got if k < 400) <= 2
        assert not any(got[k] for k in got if k >= 400)


def test_language_identification(spark):
    rng = random.Random(6)
    sounds = {"aa": "ka ta mi no ra".split(), "bb": "sch ung ber ein öst".split(), "cc": "çon éau ment ille à".split()}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30))
    rows = [(k, text(lang), lang) for k, lang in enumerate(rng.choice(list(sounds)) for _ in range(400))]
    rows += [(500, None, "aa"), (501, "123 !?", "aa"), (502, "", None), (503, text("bb"), None), (None, text("cc"), "cc"), (504, text("bb") * 400, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    held = [(k, lang) for k, _, lang in rows if k is not None and k < 400 and zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] for k, _ in held)
    assert sum(got[k]["lang_pred"] == lang for k, lang in held) >= 0.97 * len(held)
    assert [got[k]["lang_pred"] for k in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "bb", "bb", "cc"]
    assert got[500]["score"] == 0.0 and not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got.values())
    alone = df.filter("doc_id = 503")
    assert [r["lang_pred"] for r in langid.identify(alone).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0


def test_runs_of_windows_agree(monkeypatch):
    rng = np.random.default_rng(7)
    texts = pa.array(["", "abc", None, "é" * 50, "a", "some words here " * 20])
    table = rng.normal(size=((1 << 10) + 1, 3)).astype(np.float32)
    table[-1] = 0
    whole = langid.class_sums(texts, table, 10)
    monkeypatch.setattr(langid, "RUN", 7)
    parts = langid.class_sums(texts, table, 10)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_short_pieces_share_their_prefixes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    model, rng = bpe.ByteBPE(BYTE), random.Random(7)
    stems = ["".join(rng.choice("abdeéнst") for _ in range(12)) for _ in range(8)]
    often, text = "ordinarily ", ""
    for k in range(600):
        text += often + stems[k % 8] + rng.choice("abcd") + rng.choice(["", "ing,", "'s\n", "9.x"]) + str(k) + " "
    asked, plain = [], model._end
    monkeypatch.setattr(model, "_end", lambda data: asked.append(data) or plain(data))
    windows = [text[k : k + 400] for k in range(0, len(text), 400)]
    assert [[*chain.from_iterable(model.encode(w))] for w in windows] == [LIBRARY.encode(w, add_special_tokens=False).ids for w in windows]
    assert len(model.ends) <= 40 + bpe.SHORT
    assert asked.count(b" ordinarily") <= 2  # what is asked for again comes back from the table before
    known = model.remembered
    assert all(len(t) <= 20 + 400 for t in (known, known.older, known.spaced, known.spaced.older))
    known.clear()
    assert not (known or known.older or known.spaced or known.spaced.older)
