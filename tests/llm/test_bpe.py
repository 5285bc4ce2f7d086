import hashlib
import struct
import unicodedata

import pytest
from tokenizers import Tokenizer

from atoflow.llm import bpe, queries

from .helpers import ROWS, awkward, empty

PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_split_equals_the_library_on_every_character(tok):
    split = bpe.Splitter(bpe.special_tokens(open(PATH).read()))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Co", "Cn")]
    for at in range(0, len(chars), 2000):
        text = "".join(f"a{c}{c} {c}1{c} b  {c}" for c in chars[at:at + 2000])
        want = [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
        assert split(text) == want


@pytest.mark.parametrize("blocks", [dict(), dict(shares=3, block_chars=5000)])
def test_digests_equal_the_library(spark, tok, blocks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, PATH, **blocks).collect()}
    assert got == {r.doc_id: expected(tok, r.text) for r in docs.collect()}


NASTY = ["<|endoftext|>", "<|endoftext|><|endoftext|> x", "a<|endoftext|>", "<|endoftext|", " <|endoftext|>\n\n", "\x00\x1c\x1d\x85\u2028 \u3000x",
         "it's we'll I'M 's''s", "  two  spaces   ", "\t\t\n\r\n x", "ﬀ①²½x५", "🙂👨‍👩‍👧 flags 🇩🇪", "a" * 5000, "\u00a0\u1680\u180e\u200b", "é e\u0301"]


def test_nasty_texts(spark, tok):
    df = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, PATH, shares=5).collect()}
    assert got == {i: expected(tok, t) for i, t in enumerate(NASTY)}


def test_ids_and_decode_join(spark, tok):
    df = spark.createDataFrame(list(enumerate([*NASTY, None, ""])), "doc_id long, text string")
    ids = bpe.encode(df, PATH)
    assert {r.uid: r.ids for r in ids.collect()} == {
        i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate([*NASTY, None, ""])}
    pieces = spark.createDataFrame(list(enumerate(map(bytearray, bpe.piece_table(open(PATH, encoding="utf-8").read())))), "piece_id int, bytes binary")
    assert {r.uid: r.text for r in bpe.decode(ids, pieces).collect()} == {i: t or "" for i, t in enumerate([*NASTY, None, ""])}


def test_awkward_rows(spark, tok):
    got = sorted(map(repr, (tuple(r) for r in bpe.encode_digests(awkward(spark), PATH).collect())))
    assert got == sorted(repr((i, *expected(tok, t))) for i, t in ROWS)


def test_each_distinct_word_is_encoded_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocabulary = open(PATH, encoding="utf-8").read()
    blocks = bpe.split_blocks(bpe.numbered(docs, "doc_id", "text"), vocabulary, shares=4, block_chars=50_000).collect()
    words = {}
    for b in blocks:
        if b.share >= 0:
            lens = bpe._unpack(bytes(b.lens), "u4").tolist()
            raw = bpe.zstandard.ZstdDecompressor().decompress(bytes(b.body))
            own = []
            for n in lens:
                own.append(raw[:n])
                raw = raw[n:]
            assert len(set(own)) == len(own)
            for w in own:
                words.setdefault(w, set()).add(b.share)
    assert all(len(s) == 1 for s in words.values())


def test_empty_table(spark):
    assert bpe.encode_digests(empty(spark), PATH).count() == 0
