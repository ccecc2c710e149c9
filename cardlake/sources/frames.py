"""Event frames ``data: {json}\\n\\n``.

Reading splits files on the blank line that ends every frame; a frame may carry the
``data: `` prefix; frames that are not valid JSON (a truncated last frame, noise) parse
to NULL and are dropped, as the browser client ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.streaming.fold import EVENT_SCHEMA

FRAME_SEP = "\n\n"


def parse_frames(raw: DataFrame, schema: str = EVENT_SCHEMA) -> DataFrame:
    """``value`` column of frame texts -> event rows."""
    body = F.regexp_replace(F.col("value"), r"^\n*data: ", "")
    ev = raw.select(F.from_json(body, schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return ev.where(F.col("type").isNotNull())


def read_frames(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return parse_frames(spark.read.option("lineSep", FRAME_SEP).text(path), schema)


def read_frames_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return parse_frames(spark.readStream.option("lineSep", FRAME_SEP).text(path), schema)


def encode_frames(events: DataFrame, fields: tuple[str, ...] = ("type", "text"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Events -> one ``value`` per frame, JSON payload, non-ASCII kept as is; ``keep``
    columns ride along unencoded."""
    return events.select(*keep, F.concat(F.lit("data: "), F.to_json(F.struct(*fields))).alias("value"))


def write_frames(events: DataFrame, path: str, fields: tuple[str, ...] = ("msg_id", "seq", "type", "text")) -> None:
    encode_frames(events, fields).write.mode("overwrite").option("lineSep", FRAME_SEP).text(path)
