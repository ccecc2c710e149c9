"""Answer-event folding (L1-L4, E12) for batch and Structured Streaming.

A message's events ``(msg_id, seq, type, text)`` fold into its displayed text:
``delta`` appends, ``done`` replaces, ``error`` replaces with a fixed prefix, any other
type is ignored; a delta after done appends again.  The fold is one aggregate: the
message's events are collected, de-duplicated, ordered by ``seq`` and folded with
``aggregate`` - JVM only, and the same expression serves a streaming aggregation in
``update`` mode, so events arriving out of order across micro-batches fold right.
State is one small list per message (bounded by the message's events).  As the events
carry no event time, a plain streaming aggregate keeps that state for the life of the
query; :func:`fold_stream_expiring` keeps it in ``applyInPandasWithState`` and drops a
message after an idle processing-time timeout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cardlake.functions.text import bound

# Fixed value: prefix shown for an error event.
ERROR_PREFIX = "Désolé, une erreur est survenue : "

EVENT_SCHEMA = "msg_id long, seq long, type string, text string"

# Fixed value: the event types that change a message's text; any other type is ignored.
FOLDED_TYPES = ("delta", "done", "error")


EVENTS_JSON = "array<struct<seq: bigint, type: string, text: string>>"


def fold_expr(events: Column) -> Column:
    """Fold an ``array<struct<seq, type, text>>`` (any order) into the final text;
    NULL when no delta/done/error occurred."""
    def folded(o: Column) -> Column:
        last = F.array_max(F.transform(o, lambda e, i: F.when(e["type"].isin("done", "error"), i)))
        return bound(F.coalesce(last, F.lit(-1)), lambda at: after(o, at))

    def after(o: Column, at: Column) -> Column:
        """The last replacing event's text, then the deltas behind it in one join."""
        e = F.get(o, at)
        base = F.when(e["type"] == "error", F.concat(F.lit(ERROR_PREFIX), F.coalesce(e["text"], F.lit("")))).when(
            e["type"] == "done", F.coalesce(e["text"], F.lit("")))
        tail = F.transform(F.filter(o, lambda d, i: (i > at) & (d["type"] == "delta")), lambda d: F.coalesce(d["text"], F.lit("")))
        return bound(tail, lambda t: F.when((at >= 0) | (F.size(t) > 0), F.concat(F.coalesce(base, F.lit("")), F.array_join(t, ""))))

    return bound(F.sort_array(F.array_distinct(F.coalesce(events, F.array().cast(EVENTS_JSON)))), folded)


def fold_events(events: DataFrame, key: str = "msg_id") -> DataFrame:
    """``(key, seq, type, text)`` -> ``(key, text)`` (L1).  Event types the fold ignores
    are left out inside the partial aggregate (``collect_list`` skips the NULLs)."""
    event = F.struct(F.col("seq").cast("long").alias("seq"), "type", "text")
    packed = F.collect_list(F.when(F.col("type").isin(*FOLDED_TYPES), event))
    return events.groupBy(key).agg(fold_expr(packed).alias("text"))


def concat_chunks(chunks: DataFrame, key: str = "msg_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Ordered concatenation of answer chunks per message."""
    from cardlake.operators.nest import ordered_list

    return chunks.groupBy(key).agg(F.array_join(ordered_list([seq], [text], scalar=True), "").alias("answer"))


def answer_events(chunks: DataFrame, finals: DataFrame, key: str = "msg_id") -> DataFrame:
    """Producer side (L2): every chunk becomes a ``delta``; each message then gets one
    ``done`` with its final (grounded) text, or one ``error`` when ``error`` is set.
    ``chunks``: ``(key, seq, text)``; ``finals``: ``(key, final_text, error)``."""
    deltas = chunks.select(key, F.col("seq").cast("long").alias("seq"), F.lit("delta").alias("type"), "text")
    last = chunks.groupBy(key).agg(F.max("seq").cast("long").alias("_last"))
    closing = finals.join(last, key, "left").select(
        key, (F.coalesce(F.col("_last"), F.lit(-1)) + 1).alias("seq"),
        F.when(F.col("error").isNotNull(), "error").otherwise("done").alias("type"),
        F.coalesce(F.col("error"), F.col("final_text")).alias("text"))
    return deltas.unionByName(closing)


def first_context(chunks: DataFrame, key: str = "msg_id") -> DataFrame:
    """Context carried by a mixed chunk stream (L3): the first one by ``seq``."""
    return chunks.where(F.col("context").isNotNull()).groupBy(key).agg(
        F.min_by("context", "seq").alias("context"))


def fold_stream(spark: SparkSession, path: str, fmt: str = "json", key: str = "msg_id") -> DataFrame:
    """Streaming fold over files arriving in ``path`` (update mode)."""
    src = spark.readStream.schema(EVENT_SCHEMA).format(fmt).load(path)
    return fold_events(src, key)


def _keep_events(timeout_ms: int):
    """State function: a message's distinct events as JSON text, extended with each
    micro-batch's events and re-armed with an idle timeout; a timed-out message is
    forgotten (its last emitted text stands)."""
    import json

    import pandas as pd

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        events = json.loads(state.get[0]) if state.exists else []
        seen = {tuple(e) for e in events}
        for pdf in pdfs:
            part = pdf[["seq", "type", "text"]].astype(object)
            for rec in part.where(part.notna(), None).itertuples(index=False, name=None):
                rec = (None if rec[0] is None else int(rec[0]), rec[1], rec[2])
                if rec not in seen:
                    seen.add(rec)
                    events.append(list(rec))
        text = json.dumps([{"seq": e[0], "type": e[1], "text": e[2]} for e in events], ensure_ascii=False)
        state.update((json.dumps(events, ensure_ascii=False),))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"msg_id": [key[0]], "events_json": [text]})

    return fn


def fold_stream_expiring(stream: DataFrame, idle_timeout_ms: int, key: str = "msg_id") -> DataFrame:
    """Streaming fold whose state is dropped after ``idle_timeout_ms`` without events
    for a message (processing-time timeout), so a long-running stream keeps state only
    for live messages.  Output mode ``update``: each micro-batch emits the current text
    of every message that received events, so the last text before the timeout is already
    out.  Choose a timeout longer than any pause within a message.  The fold itself is :func:`fold_expr`, the
    same expression as the batch fold; an event arriving after its message expired
    starts the message afresh.  Run it with a processing-time trigger: timeouts are
    checked by (empty) micro-batches, which an as-fast-as-possible trigger would run
    back to back."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kept = stream.withColumnRenamed(key, "msg_id").groupBy("msg_id").applyInPandasWithState(
        _keep_events(idle_timeout_ms), "msg_id long, events_json string", "events string", "Update",
        GroupStateTimeout.ProcessingTimeTimeout)
    return kept.select(F.col("msg_id").alias(key), fold_expr(F.from_json("events_json", EVENTS_JSON)).alias("text"))


def start_fold(stream: DataFrame, sink: str, checkpoint: str, query_name: str | None = None,
               mode: str = "update") -> DataStreamWriter:
    """Writer for the folded stream; the checkpoint folder must be on shared storage."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if sink == "memory":
        w = w.format("memory").queryName(query_name or "folded")
    else:
        w = w.format(sink)
    return w
