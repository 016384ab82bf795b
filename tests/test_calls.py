"""Calls in flight: order, slots, patience, and the events that a tally is made of."""

import threading
import time

from textloom import providers as P
from textloom.operators import queue


class Slow:
    """Counts how many calls are on their way; some are refused at first."""

    def __init__(self, pause=0.05, refusals=None):
        self.pause, self.refusals, self.now, self.most, self.lock = pause, dict(refusals or {}), 0, 0, threading.Lock()

    def __call__(self, item):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        try:
            time.sleep(self.pause * (1 + item % 3) / 2)
            left = self.refusals.get(item, 0)
            if left:
                self.refusals[item] = left - 1
                raise P.Refused((429, 503, 0)[item % 3], f"busy {item}", ahead=item)
            if item == 13:
                raise ValueError("no")
            return item * 2
        finally:
            with self.lock:
                self.now -= 1


def test_order_and_slots():
    for slots in (1, 3, 8):
        call = Slow()
        began = time.monotonic()
        found = list(P.in_order(call, range(24), slots))
        took = time.monotonic() - began
        assert [x[0] for x in found] == list(range(24)) and call.most == slots
        assert [x[1] for x in found] == [None if i == 13 else 2 * i for i in range(24)] and found[13][2] == "ValueError: no"
        assert took < 24 * 0.05 / slots + 0.4
    taken = []
    source = (taken.append(i) or i for i in range(100))
    next(P.in_order(Slow(0.001), source, 4))
    assert len(taken) <= 5  # items are taken as slots get free
    assert list(P.in_order(Slow(), [], 4)) == []


def test_patience():
    call = Slow(0.001, {3: 2, 4: 1, 5: 9})
    found = {x[0]: x[1:] for x in P.in_order(call, range(8), 4, tries=3, pause=0.01)}
    assert [e["kind"] for e in found[3][2]] == ["429", "429", "recovered"] and [e["delay"] for e in found[3][2]] == [0.01, 0.02, 0.0]
    assert [e["kind"] for e in found[4][2]] == ["5xx", "recovered"] and found[4][0] == 8
    assert [e["kind"] for e in found[5][2]] == ["transport", "transport", "gave-up"] and found[5][0] is None and "busy 5" in found[5][1]
    assert found[0][2] == []
    asked = P.patiently(Slow(0.001), 1)
    assert asked[0] == 2
    waits = []
    def told(_):
        waits.append(1)
        if len(waits) == 1:
            raise P.Refused(429, "later", wait=0.02)
        return "x"

    assert P.patiently(told, 0)[2][0]["delay"] == 0.02


def refusing(item):
    """Refuses odd numbers for good, and answers null with null."""
    if item is not None and item % 2:
        raise P.Refused(503, f"down {item}", ahead=2)
    return None if item is None else f"a{item}"


def test_called_rows_and_their_tally(spark):
    rows = spark.createDataFrame([(i, i if i != 6 else None) for i in range(8)], "job int, v int").coalesce(1)
    found = P.called(rows, "v", refusing, "string", slots=3, tries=2, pause=0.01)
    got = {r["job"]: (r["answer"], r["error"]) for r in found.collect()}
    assert got[2] == ("a2", None) and got[6] == (None, None) and got[3] == (None, "503 down 3")
    tally = {r["job_id"]: r["d"] for r in queue.retry_tally(P.retry_events(found, "job")).select("job_id", queue.retry_detail().alias("d")).collect()}
    assert tally.keys() == {1, 3, 5, 7} and tally[3].startswith("1×5xx (up to 2 ahead)".replace(" (up to 2 ahead)", "")) and tally[3].endswith("; last: 503 down 3") and "1 gave up" in tally[3]


def test_embedding_in_flight(spark):
    texts = ["auth " * i + "deploy" for i in range(40)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    one = {r["k"]: list(r["vector"]) for r in P.embedded(rows, "k", "t", P.FakeEmbedder()).collect()}
    many = {r["k"]: list(r["vector"]) for r in P.embedded(rows, "k", "t", P.FakeEmbedder(), slots=4).collect()}
    assert one == many and len(one) == 41
    assert P.embed_all(P.FakeEmbedder(), ["auth"] * 9, most=4, slots=3) == P.embed_all(P.FakeEmbedder(), ["auth"] * 9)
