"""What a stream costs: calls to a key's state, and runs of a batch."""

import pandas as pd

from emberlog.streaming import streams, windows


class State:
    """A value or list state in memory that counts calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "get":
                return self.held if self.kind == "value" else iter(self.held or [])
            self.held = {"clear": None, "put": given and given[0], "update": given and given[0]}.get(name, [*(self.held or []), *(given[:1] if name == "appendValue" else given[0] if given else [])])

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def _of(self, kind):
        made = State(self.calls)
        made.kind = kind
        return made

    def getListState(self, *_):
        return self._of("list")

    def getValueState(self, *_):
        return self._of("value")

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_key_costs_as_many_calls_however_long_its_events_span():
    handle, made = Handle(), windows._Trailing(["k"], [str], 1_000_000, 0)
    made.init(handle)
    events = pd.DataFrame({"us": [i * 700_000 for i in range(200)], "id": [f"{i:03}" for i in range(200)], "own": ["x"] * 200})
    list(made.handleInputRows(("a",), iter([events]), Now(0)))
    got = pd.concat(made.handleExpiredTimer(("a",), Now(70_000), None))
    assert got["before"].tolist() == [0] + [1] * 100 and len(handle.calls) <= 12
    assert handle.timers[-1] == 101 * 700 + 1
    rest = pd.concat(made.handleExpiredTimer(("a",), Now(10**6), None))
    assert rest["before"].tolist() == [1] * 99 and len(handle.calls) <= 20


def test_lists_are_kept_in_entries_of_bounded_size():
    state = Handle().getListState()
    windows._put(state, list(range(500_000)), list(range(500_000)))
    assert max(len(c) for entry in state.held for c in entry) <= windows.CHUNK_ROWS
    assert windows._held(state, 2) == [list(range(500_000))] * 2
    assert max(map(len, (state.held[:1],))) == 1 and state.calls.count("put") == 1 and state.calls.count("appendList") == 3


def test_a_batch_runs_once(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "rows"))
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch.slice(0, 0)  # to ask whether nothing is there is to run all of it

    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "rows")).mapInArrow(seen, "id long")
    assert streams.run_to_table(stream, "once").count() == 0 and ran.value == 100
