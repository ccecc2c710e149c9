import functools
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cardlake.llm import bpe, bytebpe, lexicon, queries
from cardlake.session import table
from tests.conftest import SF_SMALL
from tests.llm.test_tokencount import TEXTS

PATH = P.path("byte_bpe_50k.json")


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def want(text):
    return library().encode(text or "", add_special_tokens=False).ids


def random_words(n, seed=1):
    r = random.Random(seed)
    return sorted({bytes(r.choice(b"abc\xc3\xa9") for _ in range(r.randint(1, 9))) for _ in range(n)})


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_lexicon_is_exact(scratch, n):
    words = random_words(n)
    entries = {w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(words)}
    path = f"{scratch}/lex.bin"
    with open(path, "wb") as f:
        f.write(lexicon.build((w, np.array(x, "<u4").tobytes()) for w, x in entries.items()))
    lex = lexicon.Lexicon(path)
    probes = words + random_words(3000, 2) + [b"", b"\xff", b"abc" * 30]
    numbers = lex.numbers(probes)
    for w, k, ids in zip(probes, numbers.tolist(), lex.ids_of(numbers)):
        assert (k >= 0) == (w in entries)
        if k >= 0:
            assert np.frombuffer(ids, "<u4").tolist() == entries[w]


def test_lexicon_is_minimal(scratch):
    """Words that share their endings share states: 2 x 26 x 3 words of one ending need
    one state per position."""
    words = [bytes([a, b]) + b"tion" + s for a in b"xy" for b in range(97, 123) for s in (b"", b"s", b"al")]
    path = f"{scratch}/lex.bin"
    with open(path, "wb") as f:
        f.write(lexicon.build((w, bytes(4)) for w in words))
    lex = lexicon.Lexicon(path)
    assert len(lex.final) == 9  # start, 2 letters, t-i-o, after n, a, end
    assert lex.numbers(sorted(words)).tolist() == list(range(len(words)))


def test_units_give_the_tokens_of_the_text():
    vocab = bytebpe.load(PATH)
    texts = [t for t in TEXTS if t and len(t) < 20_000] + [" lead", "trail ", "a\n b", "a \nb", "a  b", " ", "  ", "x  y", "'s 's"]
    for t in texts:
        got = []
        for part, i in bytebpe.split_special(t, vocab.special):
            if i is not None:
                got.append(i)
                continue
            first, rest = bpe.units(part)
            for u in first + [" " + r for r in rest]:
                got += [x for w in bytebpe.PATTERN.findall(u) for x in vocab.merge(w.encode())]
        assert got == want(t), t[:40]


@pytest.mark.parametrize("size", [0, 3, 100_000])
def test_round_trip_and_edge_rows(spark, monkeypatch, size):
    monkeypatch.setattr(bpe, "HELD", 50)
    rows = [(i if i % 3 else None, t, 1, "x") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, TOKEN_ids string")
    out = bpe.encode_decode(docs, PATH, size=size)
    assert out.columns == ["doc_id", "text", "n", "token_ids", "decoded_text"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want(r.text)
        assert r.decoded_text == library().decode(want(r.text), skip_special_tokens=False) == (r.text or "")
    assert bpe.encode_decode(docs.where("false"), PATH).count() == 0


def test_broken_sequences_decode_like_the_library(spark, scratch):
    path = f"{scratch}/lex.bin"
    with open(path, "wb") as f:
        f.write(lexicon.build([]))
    enc = bpe.Encoder(bytebpe.load(PATH), lexicon.Lexicon(path))
    for ids in ([126], [157, 254], [50256, 126, 64], [8582, 236]):
        assert enc.decode(np.array(ids, "<u4").tobytes()) == library().decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("size, kept", [(100, [{"often", " often", " twice"}]), (2, [{"often", " often"}]), (1, [{"often"}, {" often"}]), (0, [set()])])
def test_lexicon_takes_the_most_frequent_words(spark, size, kept):
    docs = spark.createDataFrame([("often often often twice",)] * 2 + [("often",), ("often",), ("once",)], "text string")
    lex = bpe._mapped(bpe.compile_lexicon(docs, PATH, size=size))
    words = ["often", " often", " twice", "once"]
    assert {w for w, k in zip(words, lex.numbers([w.encode() for w in words])) if k >= 0} in kept


def test_lexicon_fills_its_last_class(spark):
    """One class of 5,000 equally frequent words, of which only some fit."""
    docs = spark.createDataFrame([(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)),)] * 2, "text string")
    for size in (100, 4000):
        n = len(bpe._mapped(bpe.compile_lexicon(docs, PATH, size=size)).starts) - 1
        assert size - 40 <= n <= size


def test_merging_together_equals_merging_alone():
    vocab, r = bytebpe.load(PATH), random.Random(4)
    words = [bytes(r.choices("theaion éß日".encode() + bytes(range(256)) * (i % 2), k=r.randint(1, 80))) for i in range(3000)] + [b"", b"a", b"a" * 500]
    assert vocab.merge_many(words) == [np.array(vocab.merge(w), "<u4").tobytes() for w in words]
    assert vocab.merge_many([]) == []


def test_word_split_short_cut_is_the_pattern():
    """Over all code points: alone, after a space, between letters and before closing signs."""
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        for t in (c, " " + c, f"a{c}b", f" a{c}.,"):
            assert bytebpe.split_words(t) == bytebpe.PATTERN.findall(t), hex(ord(c))
    for t in ("", " ", ".", " .", "it's", "it's.", "a..", "a b.", "  a", "a.!b", "\n.", "x1."):
        assert bytebpe.split_words(t) == bytebpe.PATTERN.findall(t), t


def test_word_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([("a b  a\nb a",), (None,), ("a b",)], "text string")
    got = {r.word: r.n for r in bpe.word_counts(docs, PATH).collect()}
    assert got == {"a": 2, " b": 2, " ": 1, " a": 2, "\n": 1, "b": 1}


def test_query_matches_library(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    df = queries.QUERIES["op4_bpe"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {i: (len(want(t)), sha(np.array(want(t), "<u4").tobytes()),
                       sha(library().decode(want(t), skip_special_tokens=False).encode())) for i, t in docs.items()}
