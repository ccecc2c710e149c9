"""Answer-event folding in batch and in a stream; frame encoding and parsing.

Operators: A24, A25, E12, H25, L1-L4.
"""

import json
import os

from pyspark.sql import functions as F

from cardlake.sources import frames
from cardlake.streaming import fold

EVENTS = [
    (1, 0, "delta", "Bon"), (1, 1, "delta", "jour"), (1, 2, "done", "Bonjour !"),
    (2, 0, "done", "X"), (2, 1, "delta", "Y"),
    (3, 0, "error", "boom"),
    (4, 2, "delta", "c"), (4, 0, "delta", "a"), (4, 1, "delta", "b"),
    (5, 0, "delta", "a"), (5, 0, "delta", "a"),
    (6, 0, "prompt", "ignored"),
]
WANT = {1: "Bonjour !", 2: "XY", 3: fold.ERROR_PREFIX + "boom", 4: "abc", 5: "a", 6: None}


def test_fold_batch(spark):
    df = spark.createDataFrame(EVENTS, fold.EVENT_SCHEMA)
    assert {r.msg_id: r.text for r in fold.fold_events(df).collect()} == WANT


def test_concat_and_producer(spark):
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "msg_id long, seq long, text string")
    assert fold.concat_chunks(chunks).first().answer == "ab"
    finals = spark.createDataFrame([(1, "AB", None), (2, None, "err")], "msg_id long, final_text string, error string")
    ev = fold.answer_events(chunks, finals)
    assert {r.msg_id: r.text for r in fold.fold_events(ev).collect()} == {1: "AB", 2: fold.ERROR_PREFIX + "err"}


def test_frames_round_trip(spark, scratch):
    df = spark.createDataFrame(EVENTS, fold.EVENT_SCHEMA)
    path = os.path.join(scratch, "frames")
    frames.write_frames(df, path)
    with open(os.path.join(path, "zz-noise.txt"), "w") as f:
        f.write('data: {"type": "delta", "te\n\n')  # a truncated frame is dropped
    back = frames.read_frames(spark, path)
    assert back.count() == len(EVENTS)
    assert {r.msg_id: r.text for r in fold.fold_events(back).collect()} == WANT


def test_fold_stream_out_of_order(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    first = [{"msg_id": 9, "seq": 2, "type": "delta", "text": "c"}, {"msg_id": 9, "seq": 0, "type": "delta", "text": "a"}]
    second = [{"msg_id": 9, "seq": 1, "type": "delta", "text": "b"}, {"msg_id": 8, "seq": 0, "type": "error", "text": "e"}]
    with open(os.path.join(src, "part-1.json"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in first))
    stream = fold.fold_stream(spark, src)
    q = fold.start_fold(stream, "memory", os.path.join(scratch, "ckpt"), "folded_test", mode="complete").start()
    try:
        q.processAllAvailable()
        with open(os.path.join(src, "part-2.json"), "w") as f:
            f.write("\n".join(json.dumps(x) for x in second))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.msg_id: r.text for r in spark.table("folded_test").collect()}
    assert got == {9: "abc", 8: fold.ERROR_PREFIX + "e"}


def test_frames_stream_fold(spark, scratch):
    """Frames arriving as files in a stream (A24, L4) folded per message (L1)."""
    src = os.path.join(scratch, "frames-in")
    os.makedirs(src)

    def frame(msg, seq, typ, text):
        return "data: " + json.dumps({"msg_id": msg, "seq": seq, "type": typ, "text": text}, ensure_ascii=False) + "\n\n"

    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write(frame(1, 1, "delta", "lo") + frame(1, 0, "delta", "Hel") + frame(2, 0, "delta", "é"))
    stream = fold.fold_events(frames.read_frames_stream(spark, src))
    q = fold.start_fold(stream, "memory", os.path.join(scratch, "ckpt-frames"), "frames_folded", mode="complete").start()
    try:
        q.processAllAvailable()
        with open(os.path.join(src, "b.txt"), "w") as f:
            f.write(frame(1, 2, "done", "Hello!") + frame(2, 1, "delta", "t") + 'data: {"msg_id": 2, "seq": 2, "ty')
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.msg_id: r.text for r in spark.table("frames_folded").collect()} == {1: "Hello!", 2: "ét"}


def test_fold_stream_expiring_matches_batch(spark, scratch):
    """Stateful fold with an idle timeout gives the batch fold's texts (L1)."""
    src = os.path.join(scratch, "in-expiring")
    os.makedirs(src)
    rows = [{"msg_id": m, "seq": s, "type": t, "text": x} for m, s, t, x in EVENTS]
    half = len(rows) // 2
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows[:half]))
    latest = {}

    def keep(batch, _):
        for r in batch.collect():
            latest[r.msg_id] = r.text

    import time

    stream = fold.fold_stream_expiring(spark.readStream.schema(fold.EVENT_SCHEMA).json(src), idle_timeout_ms=60_000)
    q = stream.writeStream.outputMode("update").foreachBatch(keep).trigger(processingTime="1 second").option(
        "checkpointLocation", os.path.join(scratch, "ckpt-expiring")).start()

    def wait_for(pred, limit=90):
        end = time.time() + limit
        while not pred() and time.time() < end and q.exception() is None:
            time.sleep(0.5)

    try:
        wait_for(lambda: len(latest) >= 3)
        with open(os.path.join(src, "b.json"), "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows[half:] + rows[:2]))  # late half plus repeats
        wait_for(lambda: latest == WANT)
    finally:
        q.stop()
    assert q.exception() is None
    assert latest == WANT


def test_fold_stream_state_expires(spark, scratch):
    """After the idle timeout a message's state is gone: a late event starts it afresh."""
    import time

    src = os.path.join(scratch, "in-expire")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(json.dumps({"msg_id": 4, "seq": i, "type": "delta", "text": c}) for i, c in enumerate("ab")))
    seen = []
    stream = fold.fold_stream_expiring(spark.readStream.schema(fold.EVENT_SCHEMA).json(src), idle_timeout_ms=2000)
    q = stream.writeStream.outputMode("update").trigger(processingTime="1 second").foreachBatch(
        lambda b, _: seen.extend((r.msg_id, r.text) for r in b.collect())).option(
        "checkpointLocation", os.path.join(scratch, "ckpt-expire")).start()
    try:
        end = time.time() + 60
        while (4, "ab") not in seen and time.time() < end:
            time.sleep(0.5)
        time.sleep(5)  # idle past the timeout; empty batches drop the state
        with open(os.path.join(src, "b.json"), "w") as f:
            f.write(json.dumps({"msg_id": 4, "seq": 2, "type": "delta", "text": "c"}))
        end = time.time() + 60
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen == [(4, "ab"), (4, "c")]
