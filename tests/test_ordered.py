"""Bucketed ordered computations and machines against plain one-key loops, with a hot key."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.functions.machines import AdaptiveLimit, Breaker, Notifier, TokenBucket
from webloom.operators import events as E
from webloom.operators import ordered as O

SEC = 1_000_000


def make(spark, n=1500, seed=1, step=40, keys=("hot", "hot", "a", "b")):
    rnd, rows, now = random.Random(seed), [], 1_700_000_000 * SEC
    for i in range(n):
        now += rnd.choice([0, 0, rnd.randrange(step * SEC), rnd.randrange(3 * step * SEC)])
        if rnd.random() < 0.01:
            now += 4000 * SEC
        rows.append((i, now, rnd.choice(keys), rnd.random() < 0.6, rnd.choice(["x", "y", "z"]), rnd.random()))
    df = spark.createDataFrame(rows, "id long, at long, k string, ok boolean, kind string, v double")
    return rows, df.withColumn("ts", F.timestamp_micros("at")).drop("at").repartition(5).cache()


@pytest.fixture(scope="module")
def data(spark):
    return make(spark)


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out[r[2]].append(r)
    return out


def result(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("seconds", [60, 900, 86400])
def test_lag_runs_and_spacing(data, seconds):
    rows, df = data
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = result(df.withColumn("p", F.lag("v").over(w)), "p")
    assert result(O.lagged(df, ["k"], ["ts", "id"], {"p": "v"}, seconds), "p") == want
    runs = result(O.failure_runs(df.withColumn("bad", ~F.col("ok")), ["k"], ["ts", "id"], "bad", seconds), "run_length")
    plan = result(O.spaced(df, ["k"], ["ts", "id"], F.lit(25 * SEC).cast("long"), "at", seconds), "at")
    for events in by_key(rows).values():
        n, free = 0, None
        for i, at, _, ok, _, _ in events:
            n = 0 if ok else n + 1
            free = at if free is None else max(at, free + 25 * SEC)
            assert runs[i] == (n,) and plan[i] == (free,)


@pytest.mark.parametrize("limit,window,seconds", [(3, 60, 86400), (5, 300, 600), (1, 30, 100)])
def test_sliding_limit(data, limit, window, seconds):
    rows, df = data
    got = result(E.rate_limit(df, "k", "ts", "id", limit, window, seconds), "allowed", "retry_after")
    assert len(got) == len(rows)
    for events in by_key(rows).values():
        log = deque()
        for i, at, *_ in events:
            while log and log[0] < at - window * SEC:
                log.popleft()
            if len(log) < limit:
                log.append(at)
                assert got[i] == (True, 0)
            else:
                assert got[i] == (False, max(int((log[0] + window * SEC - at) / SEC) + 1, 1))


def test_token_bucket(data):
    rows, df = data
    got = result(E.token_bucket(df, "k", "ts", "id", 4.0, 0.02, 900), "taken", "tokens")
    machine = TokenBucket(4.0, 0.02)
    for events in by_key(rows).values():
        state = None
        for i, at, *_ in events:
            state, want = machine.step(state, at)
            assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-6)


@pytest.mark.parametrize("config", [Breaker(2, 2, 30.0, 200.0), Breaker(3, 1, 10.0, 60.0), Breaker()])
@pytest.mark.parametrize("seconds", [300, 86400])
def test_breaker(data, config, seconds):
    rows, df = data
    got = result(E.breaker(df, "k", "ts", "id", "ok", config, seconds), "state_before", "state", "blocked")
    assert len(got) == len(rows)
    for events in by_key(rows).values():
        state = config.start()
        for i, at, _, ok, _, _ in events:
            state, want = config.step(state, at, ok)
            assert got[i] == want


@pytest.mark.parametrize("scope", [[], ["k"]])
def test_notifications(data, scope):
    rows, df = data
    config = Notifier(4, 300.0, 45.0)
    got = result(E.notify(df, "ts", "id", "kind", config, scope, 1200), "outcome")
    groups = by_key(rows) if scope else {"": sorted(rows, key=lambda r: (r[1], r[0]))}
    for events in groups.values():
        sent, seen = [], defaultdict(list)
        for i, at, _, _, kind, _ in events:
            if len([t for t in sent if t > at - 300 * SEC]) >= 4:
                want = "rate_limited"
            else:
                near = [t for t in seen[kind] if t > at - 45 * SEC]
                seen[kind].append(at)
                want = "aggregated" if near else "sent"
                if not near:
                    sent.append(at)
            assert got[i] == (want,)


def test_adaptive_limit_bounds():
    machine, state, at = AdaptiveLimit(100), None, 0
    for _ in range(40):
        state, out = machine.step(state, at, 0.9, 0.0)
        at += 30 * SEC
    assert out == (0.5, 50)
    for _ in range(60):
        state, out = machine.step(state, at, 0.1, 0.0)
        at += 31 * SEC
    assert out == (2.0, 200)
    before = state
    state, _ = machine.step(state, at - 10 * SEC, 0.9, 0.9)
    assert state[0] == before[0]


def test_escalation_needs_five_in_the_window(data):
    rows, df = data
    errors = df.withColumnRenamed("kind", "error_type").withColumnRenamed("k", "component")
    urgent = [r for r in rows if r[5] > 0.5]
    for panes in (1, 4, 7):  # 7 does not divide the span
        out = {r.id: r for r in E.escalate(errors, "ts", F.col("v") > 0.5, 5, 120, panes).collect()}
        for i, at, *_ in urgent:
            near = [r for r in urgent if at - 120 * SEC < r[1] <= at]
            assert (i in out) == (len(near) >= 5)
            if i in out:
                assert set(out[i].error_types) == {r[4] for r in near} and set(out[i].components) == {r[2] for r in near}
    got = {r.id: r.error_count for r in E.escalate(errors, "ts", F.col("v") > 0.5, 5, 120).collect()}
    for i, at, *_ in urgent:
        n = sum(1 for r in urgent if at - 120 * SEC < r[1] <= at)
        assert got.get(i) == (n if n >= 5 else None)


def test_breaker_costs_the_same_however_dense_the_events(spark):
    """Failures are looked up by running values, no frame of the longest pause is summed anew for each row."""
    import random

    from webloom.functions.machines import Breaker
    from webloom.operators import events as E

    random.seed(5)
    config = Breaker(3, 2, 60.0, 600.0)
    events = sorted((random.choice([random.randrange(4000), random.randrange(300000)]), i, random.random() < 0.6) for i in range(1500))
    df = spark.createDataFrame([(i, "s", at, ok) for at, i, ok in events], "id int, src string, at int, ok boolean") \
        .withColumn("ts", F.timestamp_seconds("at"))
    judged = E.breaker(df, "src", "ts", "id", "ok", config, 3600)
    state, want = config.start(), {}
    for at, i, ok in events:
        state, result = config.step(state, at * 1_000_000, ok)
        want[i] = result
    assert {r.id: (r.state_before, r.state, r.blocked) for r in judged.collect()} == want
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan and "RangeFrame, -" not in plan
