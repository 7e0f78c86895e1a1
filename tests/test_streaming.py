import random
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest

from ledgerlens.operators import graph
from ledgerlens.operators.rolling import rolling_features
from ledgerlens.plans import scoring
from ledgerlens.schemas import FEATURES
from ledgerlens.sources.readers import replay_stream
from ledgerlens.streaming.jobs import StreamingScorer, ordered_stream, result_feed
from ledgerlens.streaming import keyed
from ledgerlens.streaming.keyed import SenderState, window_values
from ledgerlens.streaming.state import batch_folders, retained
from make import frame, tx
from test_rolling import mixed_rows

SCORES = ["rule_score", "ensemble_anomaly_score", "gnn_anomaly_score", "transaction_risk_score"]


def rows_of(n=150):
    rnd = random.Random(2)
    rows = mixed_rows(n, seed=21)
    for r in rows:
        r["receiver_account"] = rnd.choice(["A", "B", "C", "X", "Y"])
    return sorted(rows, key=lambda r: (r["timestamp"], r["transaction_id"]))


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def art(spark, rows):
    return scoring.fit_artefacts(frame(spark, rows), trees=20, dim=6, als_iterations=3)


@pytest.fixture
def no_empty_batches(spark):
    """No last batch without rows that only moves the watermark on."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def fed(spark, job, *slices):
    """Run the job over the slices, a file and a micro-batch each, after those it has seen."""
    seen = len(batch_folders(spark, f"{job.root}/features"))
    for i, rows in enumerate(slices):
        frame(spark, rows).coalesce(1).write.parquet(f"{job.root}/in/part={seen + i}")
    job.start(replay_stream(spark, f"{job.root}/in/*", schema=frame(spark, [tx(0)]).schema), available_now=True).awaitTermination()
    return job


def close(a, b, cols):
    left, right = ({r["transaction_id"]: r for r in df.select("transaction_id", *cols).collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for k in left:
        for c in cols:
            assert left[k][c] == pytest.approx(right[k][c], rel=1e-6, abs=1e-6), (k, c)


def test_micro_batches_equal_batch_scoring(spark, rows, art, tmp_path, no_empty_batches):
    """Three files, three micro-batches, compaction after each; then a repeat of the last."""
    job = StreamingScorer(spark, str(tmp_path / "s"), art, lateness="1 hour", compact_every=1)
    # ties across a cut would be late or early depending on their ids
    fed(spark, job, rows[:50], rows[50:100], rows[100:])
    assert job.results("late").count() == 0
    all_rows = frame(spark, rows)
    close(job.results("features"), rolling_features(all_rows), FEATURES)
    vectors = ["sender_in_degree", "sender_out_degree_unique", "receiver_in_degree_unique", "receiver_out_degree", "cycle_length"]
    close(job.results("vectors"), graph.live_graph_vector(all_rows), vectors)
    batch = scoring.score_transactions(all_rows, art)
    close(job.results("scored"), batch, SCORES)
    close(job.results("alerts"), scoring.alerts_of(batch), ["transaction_risk_score", "group_risk_score"])
    # the files of the state do not grow with the batches: the last two snapshots, no log below them
    for table in ("pairs", "edges", "peaks", "marks"):
        assert len(batch_folders(spark, f"{job.root}/state/{table}/snapshot")) == 2
        assert batch_folders(spark, f"{job.root}/state/{table}/log") == [2]
    assert batch_folders(spark, f"{job.root}/arrived") == [2]

    before = sorted(map(tuple, job.results("scored").select("transaction_id", *SCORES).collect()))
    for name in ("2", ".2.crc"):  # as if the driver had died before the last commit was written
        (tmp_path / "s" / "checkpoint" / "commits" / name).unlink()
    again = StreamingScorer(spark, job.root, art, lateness="1 hour", compact_every=1)
    fed(spark, again)
    assert sorted(map(tuple, again.results("scored").select("transaction_id", *SCORES).collect())) == before


def test_late_and_repeated_rows(spark, tmp_path):
    job = StreamingScorer(spark, str(tmp_path / "l"), lateness="10 minutes")
    job.warm_start(frame(spark, [tx(0, 0), tx(1, 3600)]))
    fed(spark, job, [tx(1, 3600), tx(2, 100), tx(3, 3300), tx(4, 4000), tx(4, 4000)], [tx(4, 4000), tx(5, 50), tx(6, 4100)])
    assert {r["transaction_id"] for r in job.results("late").collect()} == {"T00002", "T00005"}
    assert {r["transaction_id"]: r["tx_velocity_6h"] for r in job.results("features").collect()} == {
        "T00002": 1, "T00003": 2, "T00004": 4, "T00005": 1, "T00006": 6}


def test_late_rows_see_only_what_precedes_them(spark, tmp_path):
    edge = lambda i, s, a, b: tx(i, s, sender_account=a, receiver_account=b)
    job = fed(spark, StreamingScorer(spark, str(tmp_path / "d")), [edge(0, 0, "a", "b"), edge(1, 3600, "a", "c"), edge(2, 7200, "c", "a")],
              [edge(3, 1800, "a", "d"), edge(4, 9000, "a", "b")])
    got = {r["transaction_id"]: r for r in job.results("vectors").collect()}
    assert (got["T00003"]["sender_out_degree"], got["T00003"]["sender_in_degree"], got["T00003"]["cycle_length"]) == (2, 0, 0)
    assert (got["T00004"]["sender_out_degree"], got["T00004"]["sender_in_degree"], got["T00004"]["sender_out_degree_unique"]) == (4, 1, 3)


def test_shared_devices_and_late_first_uses(spark, tmp_path):
    """A late row may turn out to be a sender's first use; empty devices are shared by nobody."""
    use = lambda i, at, s, d="X": tx(i, at, s, device_id=d)
    job = fed(spark, StreamingScorer(spark, str(tmp_path / "v")), [use(0, 0, "A"), use(1, 100, "B"), use(2, 7300, "C"), use(3, 7400, "A", "")],
              [use(4, 50, "C"), use(5, 7350, "D"), use(6, 7500, "B"), use(7, 7600, "D", "")])
    got = {r["transaction_id"]: (r["shared_device_count"], r["new_device_flag"]) for r in job.results("features").collect()}
    assert got == {"T00000": (0, 1), "T00001": (1, 1), "T00002": (2, 1), "T00003": (0, 1), "T00004": (1, 1), "T00005": (3, 1), "T00006": (4, 0), "T00007": (0, 1)}


def test_old_rows_leave_the_state(spark, tmp_path):
    """Event-time timers: rows over 35 days old go, but for the last ones; features of what comes later are those of the whole history."""
    day = 86_400
    slices = [[tx(20 * m + i, m * 40 * day + i * 3000, "AB"[i % 2], device_id=f"D{i % 3}", amount=1000 * (i + m)) for i in range(20)] for m in range(4)]
    job = fed(spark, StreamingScorer(spark, str(tmp_path / "o"), last_rows=6), *slices)
    every = frame(spark, [r for part in slices for r in part])
    close(job.results("features"), rolling_features(every), [f for f in FEATURES if f != "benford_chi2_score"])
    state = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "rows").option("flattenCollectionTypes", True).load(f"{job.root}/checkpoint")
    kept = {r[0]: r[1] for r in state.groupBy("key.sender_account").count().collect()}
    # a timer fires in the batch after the one that moved the watermark past it
    assert set(kept) == {"A", "B"} and all(n <= 6 + 10 for n in kept.values())


def test_window_values_equal_a_plain_scan():
    rnd = random.Random(5)
    country, us = ["IN", "AE"], 1_000_000
    rows = sorted((rnd.randrange(0, 40 * 86_400, 500) * us, f"T{i:04d}", rnd.choice([5.0, 7.5, 1e6]), rnd.randint(1, 9), rnd.randint(0, 1), rnd.randint(0, 1),
                   rnd.randint(0, 1), rnd.choice("xyz"), rnd.choice("de"), rnd.choice("pq"), rnd.choice(country), 1.0, 2.0) for i in range(300))
    got = window_values(rows, {i: "IN" for i in range(300)}, set())
    for i, r in enumerate(rows):
        w = lambda days: [x for x in rows[:i] if x[0] >= r[0] - days * 86_400 * us]
        seven, thirty = w(7), w(30)
        mean = sum(x[2] for x in seven) / len(seven) if seven else None
        assert got[i][3:5] == (len(seven), len(thirty))
        assert got[i][5] == (pytest.approx(mean) if seven else None)
        assert got[i][7:9] == ((max(x[2] for x in seven), min(x[2] for x in seven)) if seven else (None, None))
        assert got[i][13:17] == (len({x[7] for x in seven}), len({x[7] for x in thirty}), len({x[8] for x in seven}), len({x[9] for x in w(1)}))
        assert got[i][17] == (sum(a[10] != b[10] for a, b in zip(seven, seven[1:])) if seven else None)
        assert got[i][19] == sum(x[10] != "IN" for x in thirty)
        assert got[i][23:32] == tuple(sum(x[3] == d for x in rows[max(0, i - 200) : i]) for d in range(1, 10))


class Held:
    """State variables of one key in memory; counts the calls."""

    def __init__(self):
        self.items, self.map, self.calls = [], {}, 0

    def getListState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def __getattribute__(self, name):
        if name in ("get", "appendList", "appendValue", "put", "getValue", "containsKey", "updateValue", "exists", "update"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return iter(self.items)

    def appendList(self, values):
        self.items += values

    def appendValue(self, value):
        self.items.append(value)

    def put(self, values):
        self.items = list(values)

    def exists(self):
        return False

    def update(self, value):
        pass

    clear = lambda self: None

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value


class Handle:
    def __init__(self):
        self.states = defaultdict(Held)

    def __getattr__(self, name):
        return lambda variable, *_: self.states[variable]


COLUMNS = ["transaction_id", "amount", "receiver_account", "device_id", "ip_address", "sender_country", "receiver_country", "geo_latitude", "geo_longitude", "at",
           "digit", "night", "weekend", "ok"]


def through_state(uses, size):
    """First-use flags of one sender's (at, id, device) in batches of ``size``, and the calls of each batch."""
    handle, flags, calls = Handle(), {}, []
    state = SenderState(COLUMNS[:-4])
    state.init(handle)
    for lo in range(0, len(uses), size):
        before = sum(s.calls for s in handle.states.values())
        batch = pd.DataFrame([(i, 5.0, "r", d, "ip", "IN", "IN", 1.0, 2.0, at, 5, 0, 0, 1) for at, i, d in uses[lo:lo + size]], columns=COLUMNS)
        for out in state.handleInputRows(("a",), iter([batch]), None):
            new = keyed._PARTS.index("new_device_flag")
            flags |= {i: (p[new], f, w if f == 2 else None) for i, p, f, w in zip(out["transaction_id"], out["p_parts"], out["p_first"], out["p_was_id"])}
        calls.append(sum(s.calls for s in handle.states.values()) - before)
    return flags, calls


def test_a_sender_costs_a_few_state_calls_a_batch(monkeypatch):
    """However many rows and devices a batch has; beyond ``LISTED`` devices each is looked up, with equal results."""
    rnd = random.Random(8)
    uses = [(rnd.randrange(10**12), f"T{i:04d}", f"D{rnd.randrange(60)}") for i in range(180)]
    flags, calls = through_state(uses, 60)
    assert max(calls) <= 6
    for lo in (0, 60, 120):
        seen = {d: min(u[:2] for u in uses[:lo + 60] if u[2] == d) for _, _, d in uses[:lo + 60]}
        was = {d: min((u[:2] for u in uses[:lo] if u[2] == d), default=None) for _, _, d in uses[:lo + 60]}
        for at, i, d in uses[lo:lo + 60]:
            new = seen[d] == (at, i)
            assert flags[i] == (new, 0 if not new else 1 if was[d] is None else 2, was[d][1] if new and was[d] else None)
    monkeypatch.setattr(keyed, "LISTED", 5)
    assert through_state(uses, 60)[0] == flags


def test_plain_rows_give_what_data_frames_give():
    """The operators of the streams take rows without a data frame a key; what they tell equals that of the data frames, repeated ids and late rows included."""
    rnd = random.Random(9)
    uses = [(rnd.randrange(10**12), f"T{rnd.randrange(70):04d}", f"D{rnd.randrange(9)}") for _ in range(90)]
    frames, rows = SenderState(COLUMNS[:-4]), keyed.SenderRows()
    frames.init(Handle()), rows.init(Handle())
    for lo in range(0, 90, 30):
        part = uses[lo:lo + 30]
        batch = pd.DataFrame([(i, 5.0, "r", d, "ip", "IN", "IN", 1.0, 2.0, at, 5, 0, 0, 1) for at, i, d in part], columns=COLUMNS)
        plain = [("a", at, i, 5.0, 5, 0, 0, 1, "r", d, "ip", "IN", 1.0, 2.0, "IN", f"row {at}") for at, i, d in part]
        told = [x for out in rows.handleInputRows(("a",), iter(plain), None) for x in zip(out.id, out.p_parts, out.p_first, out.p_was_at, out.p_was_id)]
        known = [x for out in frames.handleInputRows(("a",), iter([batch]), None) for x in zip(*[out[c] for c in ("transaction_id", "p_parts", "p_first", "p_was_at", "p_was_id")])]
        assert told == known and told
    assert keyed._held(rows.rows) == keyed._held(frames.rows)


def test_timers_drop_rows_inside_the_entries_of_a_state():
    handle, day = Handle(), 86_400_000_000
    state = SenderState(COLUMNS[:-4], last_rows=6)
    state.init(handle)
    for lo in (0, 10):
        batch = pd.DataFrame([(f"T{i}", 5.0, "r", "d", "ip", "IN", "IN", 1.0, 2.0, i * day, 5, 0, 0, 1) for i in range(lo, lo + 10)], columns=COLUMNS)
        list(state.handleInputRows(("a",), iter([batch]), None))
    state.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 40 * day // 1000), None)
    assert [r[1] for r in keyed._held(state.rows)] == [f"T{i}" for i in range(6, 20)]
    state.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 99 * day // 1000), None)
    assert [r[1] for r in keyed._held(state.rows)] == [f"T{i}" for i in range(14, 20)]


def test_retention_keeps_what_features_need(spark):
    rows = rows_of(200)
    kept = retained(frame(spark, rows[:150]), last_rows=20)
    assert kept.count() < 150
    later = frame(spark, rows[150:])
    cols = [f for f in FEATURES if f != "benford_chi2_score"]
    both = lambda past: rolling_features(past.unionByName(later)).join(later.select("transaction_id"), "transaction_id", "left_semi")
    close(both(kept.select(*later.columns)), both(frame(spark, rows[:150])), cols)


def test_repeats_are_dropped_and_results_can_be_followed(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([tx(0, 0), tx(1, 60)], [tx(1, 60), tx(2, 120)])):
        frame(spark, rows).coalesce(1).write.parquet(f"{src}/part={i}")
    schema = frame(spark, [tx(0)]).schema
    job = StreamingScorer(spark, str(tmp_path / "out"))
    job.start(ordered_stream(replay_stream(spark, f"{src}/*", schema=schema)), available_now=True).awaitTermination()
    feed = result_feed(spark, job.root, "features", job.results("features").schema)
    q = feed.select("transaction_id").writeStream.format("memory").queryName("feed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("feed").collect()) == ["T00000", "T00001", "T00002"]
