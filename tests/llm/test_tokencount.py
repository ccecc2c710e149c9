import functools

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cardlake.llm import bytebpe, queries, tokencount
from cardlake.session import table
from tests.conftest import SF_SMALL

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "  two  spaces ", "it's 'S don't they'll ’s\n\n x\t\ty ", "a  b   c　d",
    "x <|endoftext|> y<|endoftext|>  <|endoftext|>", "<|endoftext", "héllo wörld ½ ⅷ １２ 日本語 🎉🎉",
    "word " * 20_000, "a" * 50_000, "ab" * 9_000 + " " + "ba" * 9_000, " " * 40_000, "\n \n" * 9_000, "é" * 20_000,
    ("x <|endoftext|> y's  " * 3_000), "1" * 30_000 + " .. " * 9_000,
]


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def want(text):
    return len(library().encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk, overlap", [(16_384, 256), (1000, 16), (64, 4), (9, 2)])
def test_counts_equal_the_library(chunk, overlap):
    count = tokencount.counter(PATH, chunk, overlap)
    for t in TEXTS:
        if len(t or "") <= 20_000 or chunk > 500:
            assert count(t or "") == want(t), (t or "")[:40]


def test_rank_merges_equal_the_library():
    """Every code point in letter, digit, space and sign contexts splits and merges alike."""
    bpe = bytebpe.load(PATH)
    for block in range(0, 0x30000, 0x800):
        if 0xD800 <= block < 0xE000:
            continue
        texts = ["a%s a%s1%s.%s%s  %sz" % ((chr(c),) * 6) for c in range(block, block + 0x800, 7)]
        for t, e in zip(texts, library().encode_batch(texts, add_special_tokens=False)):
            assert [i for w in bytebpe.PATTERN.findall(t) for i in bpe.merge(w.encode())] == e.ids


def test_long_words_merge_like_short_ones():
    bpe = bytebpe.load(PATH)
    for w in ("abcabd" * 30, "the" * 100, "ő" * 200, "aaaa" * 64 + "b", "q" * 65):
        assert bpe.merge(w.encode()) == library().encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_use_their_library(name):
    count = tokencount.counter(P.path(name))
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        assert count("Hello, wörld of words") == len(m.encode("Hello, wörld of words"))
    else:
        t = Tokenizer.from_file(P.path(name))
        assert count("Hello, wörld of words") == len(t.encode("Hello, wörld of words", add_special_tokens=False).ids)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i if i % 3 else None, t, 7) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, id int")
    got = sorted(map(tuple, tokencount.count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted([(i if i % 3 else None, len((t or "").encode()), want(t), want(t) > 512)
                          for i, t in enumerate(TEXTS)] * 2, key=str)
    assert tokencount.count_tokens(docs.where("false"), PATH).count() == 0


def test_query_matches_library(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    df = queries.QUERIES["op5_token_counts"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()}
    assert got == {i: (len(t.encode()), want(t), want(t) > 512) for i, t in docs.items()}
