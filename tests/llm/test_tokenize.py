import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import tokenize

ENCODER = tokenize.Encoder(tokenize.rank_file())

ALPHABET = list("ab'sT12 .,-\n\r\t ") + ["\n\n", "\r\n", "  ", "'ll", "'re", "é", "ß", "я", "日", "本", "🎬", "\xa0", "　", " ", "\x85", " ", "​", "\x1c", "…", "00:01:02,003 --> 00:01:05,006\n"]


def whole(text):
    return ENCODER.bpe.encode_ordinary(text) if text else []


def split(counts, ids):
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join), st.text(max_size=40)), max_size=6))
def test_equals_encoding_whole_texts(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    assert split(*ENCODER.encode(pa.array(texts, pa.string()))) == [whole(t) for t in texts]


def test_sliced_arrays_and_long_texts():
    rnd = random.Random(0)
    long = "".join(rnd.choice(ALPHABET) for _ in range(60000))
    for text in (long, "x" * 20000, "日本" * 5000, " " * 3000, "\n" * 3000, "abc " * 4000):
        array = pa.array(["skipped", text, None, "", "tail"]).slice(1)
        assert split(*ENCODER.encode(array)) == [whole(text), [], [], whole("tail")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab'sT1.l-é日я…") + ["'ll", "　", "\u2003", "\x85", "word", "'re", "日本語", " " * 9, "🎬"]), min_size=30, max_size=300).map("".join))
def test_joins_without_exact_points_are_repaired(text):
    text = text.replace("🎬", "") if len(text) % 3 else text
    assert split(*ENCODER.encode(pa.array([text]))) == [whole(text)]


def test_repairs_happen_and_chunks_are_shared_within_stretches():
    rnd = random.Random(2)
    e = tokenize.Encoder(tokenize.rank_file())
    unit = "".join(rnd.choice("abcdefgh'日本語のя") for _ in range(400))
    texts = [rnd.choice("xyz") * rnd.randrange(1, 9) + unit * 3 for _ in range(20)]
    assert split(*e.encode(pa.array(texts))) == [whole(t) for t in texts]
    assert e.repaired > 100 and e.encoded < e.seen / 3


@pytest.mark.parametrize("width", [8, 16, 64])
def test_windows_of_any_size(monkeypatch, width):
    monkeypatch.setattr(tokenize, "LONG", width)
    rnd = random.Random(width)
    for _ in range(200):
        text = "".join(rnd.choice(["'", "l", "'ll", "s", "ab", "日", "　", "\u2003\u2003", "1", ".", "…", "\x85"]) for _ in range(rnd.randrange(200)))
        assert split(*ENCODER.encode(pa.array([text]))) == [whole(text)]


def test_a_small_dictionary_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenize, "MAX_CHUNKS", 5)
    e = tokenize.Encoder(tokenize.rank_file())
    for i in range(6):
        texts = [f"line {j}\nline {j + 1}\nother {i}\n" for j in range(20)]
        assert split(*e.encode(pa.array(texts))) == [whole(t) for t in texts]


def test_a_full_dictionary_keeps_what_is_used_most(monkeypatch):
    monkeypatch.setattr(tokenize, "MAX_CHUNKS", 60)
    e = tokenize.Encoder(tokenize.rank_file())
    often = [f"common line {j}\n" for j in range(5)]
    for i in range(8):
        e.encode(pa.array(["".join(often) + f"rare {i} {k}\n" for k in range(30)]))
    e._shrink()
    assert 0 < len(e.chunks) <= 30 and any(b"common" in c for c in e.chunks)
    texts = ["".join(often), "rare 7 29\nnew"]
    before = e.encoded
    assert split(*e.encode(pa.array(texts))) == [whole(t) for t in texts]
    assert e.encoded - before < 8


def test_equal_chunks_are_encoded_once():
    e = tokenize.Encoder(tokenize.rank_file())
    e.encode(pa.array([f"same line here\nand another one\nonly {i}\nsame line here\n" for i in range(100)]))
    assert e.encoded < e.seen / 2
    before = e.encoded
    e.encode(pa.array(["same line here\nand another one\nonly 5\nsame line here\n"] * 3))
    assert e.encoded == before


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_spark(spark, name):
    rows = [(1, "Hello world\n\nagain"), (2, None), (3, ""), (4, " \n\t"), (None, "null id"), (1, "Hello world\n\nagain"), (5, "x" * 5000), (6, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, 7, [1]) for i, t in rows], "doc_id long, text string, tokens int, ids array<int>")
    path = tokenize.rank_file(name)
    plain = tokenize.Encoder(path).bpe
    want = sorted(((i, plain.encode_ordinary(t) if t else []) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in tokenize.token_ids(df, path=path).collect()), key=str) == want
    counts = tokenize.token_counts(df, ["doc_id"], path=path).collect()
    assert sorted(((r.doc_id, r.tokens) for r in counts), key=str) == sorted(((i, len(x)) for i, x in want), key=str)
    assert tokenize.token_ids(df.limit(0), path=path).count() == 0


def test_reuse_is_reported(spark):
    df = spark.createDataFrame([(f"the same line\nagain the same\n{i % 3}\n",) for i in range(200)], "text string").coalesce(1)
    r = tokenize.reuse(df).first()
    assert r.texts == 200 and r.chunks > 500 and r.encoded < 20


def test_against_the_other_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in tokenize.token_ids(docs).collect():
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids
