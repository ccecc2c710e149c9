"""Streaming fold with incremental state: equal to the batch fold whatever the order of
arrival, repeats included, over restarts; state work counted against the events."""

import itertools
import random

from cardlake.streaming import fold, keeper


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = tuple(v)

    def clear(self):
        self.v = None


class _Map:
    def __init__(self):
        self.d, self.reads = {}, 0

    def exists(self):
        return bool(self.d)

    def containsKey(self, k):
        return k in self.d

    def updateValue(self, k, v):
        self.d[k] = v

    def keys(self):
        self.reads += len(self.d)
        return iter(list(self.d))

    def clear(self):
        self.d = {}


class _Handle:
    def getValueState(self, name, schema):
        return _Value()

    def getMapState(self, name, key, value):
        return _Map()


class _Event:
    def __init__(self, e):
        self.seq, self.type, self.text = e


def brute(events):
    text = None
    for _, kind, t in sorted({e for e in events if e[1] in ("delta", "done", "error")}, key=keeper.in_order):
        text = (text or "") + (t or "") if kind == "delta" else (fold.ERROR_PREFIX if kind == "error" else "") + (t or "")
    return text


def play(batches):
    p = keeper.MessageFold()
    p.init(_Handle())
    out = [r for b in batches for r in p.handleInputRows((1,), iter(map(_Event, b)), None)]
    return p, out


def test_any_order_and_any_cut_gives_the_batch_fold():
    r = random.Random(3)
    for _ in range(1500):
        events = [(r.choice([None, *range(6)]), r.choice(["delta"] * 4 + ["done", "error", "prompt"]), r.choice(["a", "b", "", None])) for _ in range(r.randint(0, 9))]
        sent = events + r.sample(events, len(events) // 2)
        r.shuffle(sent)
        cuts = sorted(r.randint(0, len(sent)) for _ in range(3))
        batches = [sent[a:b] for a, b in itertools.pairwise([0, *cuts, len(sent)]) if b > a]
        _, out = play(batches)
        assert [x.version for x in out] == list(range(1, len(out) + 1))
        assert (out[-1].text if out else None) == brute(events)


def test_events_in_order_read_no_stored_event_again():
    p, out = play([[(i, "delta", "x")] for i in range(300)])
    assert out[-1].text == "x" * 300 and p.tail.reads == 0
    p, out = play([[(i, "delta", "x")] for i in range(300)] + [[(400, "done", "end")], [(5, "delta", "x")]])
    assert out[-1].text == "end" and not p.tail.d  # events before the closing one are not kept


def test_runs_over_what_arrived_continue_from_the_checkpoint(spark, scratch):
    first = [(1, 1, "delta", "b"), (2, 0, "prompt", "?"), (3, 1, "done", "all"), (3, 0, "delta", "old")]
    second = [(1, 0, "delta", "a"), (1, 1, "delta", "b"), (3, 2, "delta", "!"), (4, 0, "error", "e")]
    everything = spark.createDataFrame(first + second, fold.EVENT_SCHEMA)
    for part in (first, second):
        spark.createDataFrame(part, fold.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        keeper.fold_available(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt")
    got = {r.msg_id: r.text for r in keeper.latest(spark, f"{scratch}/out").collect()}
    assert got == {r.msg_id: r.text for r in fold.fold_events(everything).collect()}
    assert got == {1: "ab", 2: None, 3: "all!", 4: fold.ERROR_PREFIX + "e"}
    assert spark.read.parquet(f"{scratch}/out").where("msg_id = 1").count() == 2  # the second run went on from the first one's state
    keeper.fold_available(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt")  # nothing new
    assert spark.read.parquet(f"{scratch}/out").count() == 6
