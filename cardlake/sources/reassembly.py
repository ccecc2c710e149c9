"""Frames put together from a byte stream cut at any place (L4).

A stream arrives as numbered pieces of bytes; a cut may fall inside a frame, inside a
character or inside the blank line that ends a frame.  Each piece is split at the blank
lines it holds: what lies between two of them is a whole frame and stays where it is; the
piece's head continues the frame open before it and its tail opens the next one.  A running
count of blank lines numbers the frames, and heads and tails with one number meet in a
group as large as one frame.

No stream is collected: the running count is made in two levels, within chunks of pieces
and over the chunks' sums, so a stream that holds a third of all pieces is spread like
any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.session import cut

#: pieces numbered together
CHUNK = 4096

#: bytes are handled as characters of the same number, so that nothing is decoded before it is whole
BYTES = "ISO-8859-1"


def reassemble(pieces: DataFrame, stream: str = "stream", n: str = "n", data: str = "data", chunk: int = CHUNK) -> DataFrame:
    """``(stream, frame, value)``: the frames of each stream in UTF-8, numbered in order from
    0 (numbers of empty frames are left out), without line feeds around them.

    ``pieces`` are ``(stream, n, data)`` with non-negative integers ``n`` that are distinct within a
    stream; gaps in ``n`` are of no account.  Null and empty pieces are ignored.  A run of line feeds
    counts as one blank line; the end of a stream ends its last frame, complete or not."""
    text = F.decode(F.col(data), BYTES)
    rows = pieces.select(F.col(stream).alias("stream"), F.col(n).cast("long").alias("n"), text.alias("t")).where("t <> ''")
    bare = F.regexp_replace("t", r"^\n+", "")
    marks = cut(rows.select(
        "stream", "n", F.floor(F.col("n") / chunk).alias("chunk"), F.col("t").startswith("\n").alias("opens"), F.col("t").endswith("\n").alias("closes"),
        (F.size(F.split("t", r"\n{2,}", -1)) - 1).cast("long").alias("inner"), F.size(F.split(bare, r"\n{2,}", -1)).cast("long").alias("inner_after")))
    in_chunk = Window.partitionBy("stream", "chunk").orderBy("n")
    chunks = marks.groupBy("stream", "chunk").agg(F.max_by("closes", "n").alias("closes"))
    before = chunks.select("stream", "chunk", F.lag("closes", 1, False).over(Window.partitionBy("stream").orderBy("chunk")).alias("closed"))
    # a blank line lies between a piece that ends with a line feed and one that starts with one
    joined = marks.join(before, ["stream", "chunk"]).withColumn(
        "split", F.col("opens") & F.coalesce(F.lag("closes").over(in_chunk), F.col("closed")))
    counted = cut(joined.select("stream", "chunk", "n", "split", F.when(F.col("split"), F.col("inner_after")).otherwise(F.col("inner")).alias("breaks")))
    sums = counted.groupBy("stream", "chunk").agg(F.sum("breaks").alias("breaks"))
    over = Window.partitionBy("stream").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("stream", "chunk", F.coalesce(F.sum("breaks").over(over), F.lit(0)).alias("offset"))
    earlier = F.coalesce(F.sum("breaks").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counted.join(offsets, ["stream", "chunk"]).select(
        "stream", "n", "split", (F.col("offset") + earlier + F.col("split").cast("long")).alias("first"))
    body = F.when(F.col("split"), bare).otherwise(F.col("t"))
    parts = rows.join(numbered, ["stream", "n"]).select("stream", "n", "first", F.split(body, r"\n{2,}", -1).alias("parts"))
    each = parts.select("stream", "n", "first", (F.size("parts") - 1).alias("last"), F.posexplode("parts").alias("k", "t")).select(
        "stream", "n", (F.col("first") + F.col("k")).alias("frame"), ((F.col("k") > 0) & (F.col("k") < F.col("last"))).alias("whole"), "t")
    ends = (each.where("not whole").groupBy("stream", "frame")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda p: p["t"]), "").alias("t")))
    frames = each.where("whole").select("stream", "frame", "t").unionAll(ends)
    clean = F.encode(F.regexp_replace("t", r"^\n+|\n+$", ""), BYTES).cast("string")
    return frames.select("stream", "frame", clean.alias("value")).where("value <> ''")
