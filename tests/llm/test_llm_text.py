"""Encoding, token counts and chat formatting against the public libraries."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sentrel.llm import bpe, chat, token_counts
from sentrel.llm.common import read_ranks
from sentrel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = "byte_bpe_multi_50k.tiktoken"
ODD = ["", " ", "  \n\t x", "a" * 3000, "the the  the\n\nThe's", "<|endoftext|>", "日本語😀 é", "\x1c\x85​", None]


@pytest.fixture(scope="module")
def library():
    ranks = read_ranks(P.path(RANKS))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    codec = bpe.codec(RANKS)
    library = test_any_text_encodes_as_the_library_does.__dict__.setdefault(
        "library",
        tiktoken.Encoding(
            "own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(RANKS)), special_tokens={}
        ),
    )
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_tokens_beside_one_another(library):
    codec, rnd = bpe.codec(RANKS), random.Random(5)
    tokens = [t.decode() for t in read_ranks(P.path(RANKS)) if t.isascii()]
    for _ in range(3000):
        text = "".join(rnd.choices(tokens, k=rnd.randint(1, 6)))
        assert codec.encode(text) == library.encode_ordinary(text)


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec = bpe.Codec(read_ranks(P.path(RANKS)), P.PATTERN)
    for text in ODD[:-1] * 2:
        assert codec.encode(text) == library.encode_ordinary(text)


def test_round_trip_digests(spark, docs_of, library):
    docs = docs_of([(i, t) for i, t in enumerate(ODD)] + [(0, ""), (None, "again")], ["n_tokens", "__text"])
    rows = bpe.round_trip(docs.drop("__text"), RANKS).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = ("again" if r.doc_id is None else ODD[r.doc_id]) or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_encode_and_decode_keep_columns(docs_of):
    docs = docs_of([(1, "one two"), (2, None)], ["token_ids", "other"])
    out = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert out.columns == [*[c for c in docs.columns if c != "token_ids"], "token_ids", "decoded"]
    assert {r.doc_id: bytes(r.decoded) for r in out.collect()} == {1: b"one two", 2: b""}
    checked = bpe.encode_checked(docs, RANKS).collect()
    assert all(r.ok and r.other == "kept" and r.n_tokens == len(r.token_ids) for r in checked)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, docs_of, tmp_path, name):
    docs = docs_of([(i, t) for i, t in enumerate(ODD)] + [(0, "twice"), (0, "twice"), (None, "x y")], ["n_tokens"])
    got = token_counts.measure(docs, name, str(tmp_path / "c"), limit=5).collect()
    assert len(got) == len(ODD) + 3
    if name.endswith("json"):
        count = lambda t: len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(t))
    want = sorted((str(i), len((t or "").encode()), count(t or "")) for i, t in [*enumerate(ODD), (0, "twice"), (0, "twice"), (None, "x y")])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)


def test_cache_is_used_and_only_misses_are_added(spark, docs_of, tmp_path):
    path, name = str(tmp_path / "c"), "byte_bpe_50k.json"
    token_counts.count_tokens(docs_of([(1, "a b"), (2, "a b"), (3, None)]), name, path).collect()
    assert spark.read.parquet(path).count() == 2
    # A stored count wins over encoding, so a changed cache shows that it was read.
    version = token_counts.tokenizer_version(name)
    fake = [(version, hashlib.sha256(b"planted").digest(), 99)]
    spark.createDataFrame(fake, token_counts.CACHE_SCHEMA).write.mode("append").parquet(path)
    out = token_counts.count_tokens(docs_of([(1, "planted"), (2, "new"), (3, "a b")]), name, path)
    assert {r.doc_id: r.n_tokens for r in out.collect()}[1] == 99
    assert spark.read.parquet(path).count() == 4
    assert token_counts.count_tokens(docs_of([]), name, path).count() == 0


def _expected(turns):
    all_turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(all_turns), len(loss), sha(loss)


def test_chat_case_of_control_strings(spark):
    row = chat.digests(chat.format_chats(chat.control_case(spark), "byte_bpe_50k.json")).first()
    said = "</s>[INST] ok [/INST]"
    assert row[:5] == (-7, *_expected([("user", said), ("assistant", said)]))


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["user", "assistant", "system", "<|end|>", ""]),
            st.lists(
                st.sampled_from(["<", "|", "\\", "[", "INST]", "/", "s>", "<<SYS>>", "é😀", " ", "<|text|>", "</s>", "x"]),
                max_size=8,
            ).map("".join),
        ),
        max_size=5,
    )
)
def test_masks_cover_trained_texts_exactly(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    encoded = chat._tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    on = chat.mask(offsets, spans, np.array([r == "assistant" for r, _ in turns], bool))
    assert "".join(map(chat.unescape, chat.masked_texts(text, offsets, on))) == "".join(
        t for r, t in turns if r == "assistant"
    )
    for role_or_said in (x for turn in turns for x in turn):
        assert not any(c in chat.escape(role_or_said) for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chat_rows(spark):
    rows = [
        (1, 1, "assistant", "second", "x"), (1, 0, "user", "first", "x"), (2, 0, None, None, "x"),
        (3, 0, "assistant", "b", "x"), (3, 0, "assistant", "a", "x"), (3, 0, "assistant", "a", "x"),
        (None, None, "assistant", "lost " * 5000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_chats(df, "byte_bpe_50k.json")).collect()}
    assert got == {
        1: _expected([("user", "first"), ("assistant", "second")]),
        2: _expected([(None, None)]),
        3: _expected([("assistant", "a"), ("assistant", "a"), ("assistant", "b")]),
        None: _expected([("assistant", "lost " * 5000)]),
    }
    assert chat.format_chats(df.limit(0), "byte_bpe_50k.json").count() == 0


def test_chat_query_against_rows(spark):
    want = {}
    for conv, _, role, text in duckdb.sql(
        f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn, role, text"
    ).fetchall():
        want.setdefault(conv, []).append((role, text))
    rows = QUERIES["op1_chat_formatting"](spark, SF).collect()
    assert {r.conv_id for r in rows} == {*want, -7} and len(rows) == len(want) + 1
    assert all(tuple(r)[1:5] == _expected(want[r.conv_id]) for r in rows if r.conv_id != -7)
