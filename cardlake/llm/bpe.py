"""BPE encoding and decoding of whole texts with a lexicon of the corpus's frequent words.

One job counts the words of all texts and keeps the most frequent ones; the driver merges
those once and compiles them into a transducer file in the shared folder, which every
task memory-maps.  A second job encodes: each distinct word of a slice of texts that its
task does not remember is looked up in the transducer, the words it lacks are merged
exactly, all together, and every text is put together from its words' ids.  The lexicon
changes the speed only, never the ids.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from cardlake.llm import bytebpe, lexicon
from cardlake.llm.schemas import extended
from cardlake.session import checkpoint_dir, cut

#: entries of the lexicon, and bytes of its longest word
LEXICON_SIZE = 131_072
WORD_BYTES = 48
#: hash slots in which the last class of frequency is taken
SLOTS = 1_024
#: characters of a text handled at once, and of a slice of texts whose words are looked up together
PIECE = 1 << 20
SLICE = 1 << 21
#: distinct space-separated units a counting task holds before it passes its counts on
HELD = 1 << 20
#: distinct units whose ids an encoding task remembers from slice to slice
KNOWN = 1 << 18

#: white space before a space: the only place where splitting at single spaces is not exact
RUN = re.compile(r"\s ")


def units(text: str) -> tuple[list[str], list[str]]:
    """(as they stand, after a space): parts of ``text`` whose tokens, each second one with
    its space in front, are together the tokens of ``text``.  One of the lists orders the
    text: either the first holds one part followed by all of the second, or it holds all."""
    if RUN.search(text):
        return bytebpe.PATTERN.findall(text), []
    parts = text.split(" ")
    return parts[:1], parts[1:]


def _pieces(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    for part, i in bytebpe.split_special(text, special):
        if i is not None:
            yield part, i
        else:
            yield from ((p, None) for p in bytebpe.stable_pieces(part, PIECE))


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of the split pattern occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = bytebpe.load(path).special
        plain: Counter[str] = Counter()
        spaced: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for counts, space in ((plain, ""), (spaced, " ")):
                for unit, n in counts.items():
                    for w in bytebpe.split_words(space + unit):
                        words[w] += n
                counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for s in b.column(0):
                for piece, i in _pieces(s.as_py() or "", special):
                    if i is None:
                        first, rest = units(piece)
                        plain.update(first)
                        spaced.update(rest)
                        if len(plain) + len(spaced) > HELD:
                            yield flush()
        if plain or spaced:
            yield flush()

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file to the shared checkpoint folder; its path."""
    jvm, path = spark.sparkContext._jvm, f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i:i + (1 << 20)]))
    finally:
        out.close()
    return path


def compile_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_SIZE) -> str:
    """Name of the lexicon file of the most frequent words of ``docs``, at most ``size``,
    written to the shared folder and handed to every executor.  What comes to the driver
    is bounded by ``size`` words of at most ``WORD_BYTES`` bytes."""
    spark, bpe = docs.sparkSession, bytebpe.load(path)
    # words in classes of about equal frequency, the more frequent classes whole and the last
    # one in slots by the words' hash, as far as both fit.  A word that occurs once is not worth an entry
    counts = cut(word_counts(docs, path, text_col).where((F.octet_length("word") <= WORD_BYTES) & (F.col("n") > 1))
                 .select("word", F.floor(F.log2("n") * 16).alias("class"), F.pmod(F.xxhash64("word"), F.lit(SLOTS)).alias("slot")))
    room, last = size, None
    for r in counts.groupBy("class").count().orderBy(F.desc("class")).collect():  # at most 16 x 63 classes
        if r["count"] > room:
            last = r["class"]
            break
        room -= r["count"]
    whole = F.col("class") > F.lit(-1 if last is None else last)
    if last is not None:
        full = SLOTS
        for r in counts.where(F.col("class") == last).groupBy("slot").count().orderBy("slot").collect():  # at most SLOTS
            room -= r["count"]
            if room < 0:
                full = r["slot"]
                break
        whole |= (F.col("class") == last) & (F.col("slot") < full)
    top = [w.encode() for w in counts.where(whole).select("word").toPandas()["word"]]
    data = lexicon.build(zip(top, bpe.merge_many(top), strict=True))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_shared(spark, name, data))
    return name


@lru_cache(maxsize=2)
def _mapped(name: str) -> lexicon.Lexicon:
    return lexicon.Lexicon(SparkFiles.get(name))


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: bytebpe.ByteBpe, lex: lexicon.Lexicon):
        self.bpe, self.lex = bpe, lex
        #: ids of recent units, as they stand and after a space
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _learn(self, units: Iterable[str], known: dict[str, bytes], space: str) -> None:
        """Remember the ids of units, from those of their words."""
        plain, split = [], {}
        for u in units:
            if u.isalpha():
                plain.append(u)
            else:
                split[u] = bytebpe.split_words(space + u)
        words = [space + u for u in plain]
        words += {w for ws in split.values() for w in ws}
        raw = [w.encode("utf-8", "replace") for w in words]
        numbers = self.lex.numbers(raw)
        ids = self.lex.ids_of(numbers)
        unseen = np.flatnonzero(numbers < 0).tolist()
        for i, merged in zip(unseen, self.bpe.merge_many([raw[i] for i in unseen]), strict=True):
            ids[i] = merged
        known.update(zip(plain, ids))
        of = dict(zip(words[len(plain):], ids[len(plain):], strict=True)).__getitem__
        known.update((u, b"".join(map(of, ws))) for u, ws in split.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list[tuple[list[str], list[str]] | bytes]] = []
        found: tuple[set[str], set[str]] = set(), set()
        for t in texts:
            own: list[tuple[list[str], list[str]] | bytes] = []
            for piece, i in _pieces(t, self.bpe.special):
                if i is not None:
                    own.append(i.to_bytes(4, "little"))
                    continue
                own.append(units(piece))
                found[0].update(own[-1][0])
                found[1].update(own[-1][1])
            parts.append(own)
        for known, new, space in zip(self.known, found, ("", " "), strict=True):
            if len(known) > KNOWN:
                known.clear()
            self._learn(new.difference(known), known, space)
        first, rest = (known.__getitem__ for known in self.known)
        return [b"".join(p if isinstance(p, bytes) else b"".join((*map(first, p[0]), *map(rest, p[1]))) for p in own) for own in parts]

    def decode(self, ids: bytes) -> str:
        """The bytes of all tokens, special ones included; broken sequences become U+FFFD."""
        got = np.frombuffer(ids, "<u4")
        table = self.bpe.tokens.__getitem__
        return b"".join(b"".join(map(table, got[i:i + PIECE].tolist())) for i in range(0, len(got), PIECE)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids",
                  decoded_col: str | None = "decoded_text", size: int = LEXICON_SIZE) -> DataFrame:
    """``docs`` with ``ids_col``, the token ids of the whole text as little-endian unsigned
    32-bit integers (binary), and ``decoded_col`` (unless None), the text decoded from them.

    Ids are those of the byte-level vocabulary ``path`` without added special tokens;
    special strings inside a text become their token.  Null and empty texts give no ids and
    an empty decoded text.  Other columns pass through unchanged, nulls, ties and repeated
    rows included; columns that already bear the new names are replaced.  An empty table
    gives no rows."""
    name = compile_lexicon(docs, path, text_col, size)
    new = [c for c in (ids_col, decoded_col) if c]
    kept = [c for c in docs.columns if c.lower() not in {c.lower() for c in new}]
    text_at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(bytebpe.load(path), _mapped(name))
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, chars = [], 0
                while lo + len(texts) < b.num_rows and chars < SLICE:
                    texts.append(b.column(text_at)[lo + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                ids = enc.encode(texts)
                cols = [pa.array(ids, pa.binary())] + ([pa.array(map(enc.decode, ids), pa.string())] if decoded_col else [])
                yield pa.RecordBatch.from_arrays(b.slice(lo, len(texts)).columns + cols, names=kept + new)
                lo += len(texts)

    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    return rows.mapInArrow(run, extended(rows.schema, (ids_col, BinaryType()), *([(decoded_col, StringType())] if decoded_col else [])))
