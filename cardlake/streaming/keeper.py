"""Answer-event folding with incremental per-message state (L1).

The state of a message is its last replacing event (``done`` or ``error``), the deltas
behind it as the keys of a map, and the text shown.  An event is looked up and stored on
its own, so a batch costs its own events: deltas in order are appended to the text, and
only a delta that comes late, or a new replacing event, orders the message's deltas
again.  Events before the last replacing one cannot change the text any more and are not
stored.  Repeated events are found in the map.

With ``idle_ms`` a processing-time timer forgets a message after that time without events
(its last emitted text stands); an event that comes later starts it afresh.  Without, there
are no timers, and a run over what is available ends by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cardlake.streaming.fold import ERROR_PREFIX, FOLDED_TYPES

EVENT = "seq long, type string, text string"
#: the state store that map states and timers need
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(event: tuple) -> tuple:
    """Sort key of ``(seq, type, text)``, nulls first, as the batch fold orders events."""
    seq, kind, text = event
    return (seq is not None, seq or 0, kind, text is not None, text or "")


def opening(event: tuple | None) -> str:
    """Text that a replacing event leaves."""
    if event is None:
        return ""
    return (ERROR_PREFIX if event[1] == "error" else "") + (event[2] or "")


class MessageFold(StatefulProcessor):
    """State keeper of one message; emits ``(msg_id, version, text)`` whenever the text may have changed."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", f"version long, {EVENT}, shown string")
        self.base = handle.getValueState("base", EVENT)
        self.tail = handle.getMapState("tail", EVENT, "held boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.head.exists()
        version, *last, shown = self.head.get() if known else (0, None, None, None, None)
        base = tuple(self.base.get()) if self.base.exists() else None
        after = in_order(base) if base else ()
        new = sorted({(r.seq, r.type, r.text) for r in rows if r.type in FOLDED_TYPES}, key=in_order)
        new = [e for e in new if in_order(e) > after and not self.tail.containsKey(e)]
        replacing = [e for e in new if e[1] != "delta"]
        if replacing:
            base = replacing[-1]
            after = in_order(base)
            self.base.update(base)
            kept = [e for e in map(tuple, self.tail.keys()) if in_order(e) > after] if self.tail.exists() else []
            self.tail.clear()
            new = sorted(kept + [e for e in new if in_order(e) > after], key=in_order)
        for e in new:
            self.tail.updateValue(e, (True,))
        if replacing:
            shown = opening(base) + "".join(e[2] or "" for e in new)
        elif new and (last[1] is None or in_order(new[0]) > in_order(tuple(last))):
            shown = (shown or "") + "".join(e[2] or "" for e in new)
        elif new:
            new = sorted(map(tuple, self.tail.keys()), key=in_order)
            shown = opening(base) + "".join(e[2] or "" for e in new)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if new or replacing or not known:
            last = (new or [base or (None, None, None)])[-1]
            self.head.update((version + 1, *last, shown))
            yield Row(msg_id=key[0], version=version + 1, text=shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.head, self.base, self.tail):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_incrementally(stream: DataFrame, idle_ms: int | None = None, key: str = "msg_id") -> DataFrame:
    """``(key, seq, type, text)`` stream -> ``(key, version, text)``: the text of every message
    that a micro-batch may have changed, versions counting up per message.  For output mode
    ``append``, so any sink takes it; :func:`latest` reads the current texts.  The session that
    starts the query must use the state store ``STORE``."""
    kind = stream.schema[key].dataType
    events = stream.select(F.col(key).alias("msg_id"), F.col("seq").cast("long").alias("seq"), "type", "text")
    out = StructType([StructField("msg_id", kind), StructField("version", LongType()), StructField("text", StringType())])
    texts = events.groupBy("msg_id").transformWithState(
        MessageFold(idle_ms), out, "Append", "None" if idle_ms is None else "ProcessingTime")
    return texts.withColumnRenamed("msg_id", key)


def fold_available(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 1000, stores: int | None = None,
                   schema: str = "msg_id long, " + EVENT) -> None:
    """One run over all events that have arrived in the Parquet folder ``source`` since the run
    before (``checkpoint`` remembers them and the state), ``files`` files a micro-batch; texts are
    appended to the Parquet folder ``sink``.  All three folders must be shared.  ``stores`` is the number
    of state stores (default: the session's shuffle partitions); the first run of a checkpoint fixes it."""
    # a query takes the session's settings as it starts
    settings = {"spark.sql.streaming.stateStore.providerClass": STORE}
    if stores:
        settings["spark.sql.shuffle.partitions"] = str(stores)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        run = (fold_incrementally(stream).writeStream.outputMode("append").format("parquet").option("path", sink)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    run.awaitTermination()


def latest(spark: SparkSession, sink: str, kind: str = "long") -> DataFrame:
    """``(msg_id, text)``: the last text of every message in ``sink``; a null text counts too."""
    texts = spark.read.schema(f"msg_id {kind}, version long, text string").parquet(sink)
    return texts.groupBy("msg_id").agg(F.max_by(F.struct("text"), "version")["text"].alias("text"))
