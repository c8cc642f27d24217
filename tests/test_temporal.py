"""Versions: merge, history, as-of, point-in-time join."""

from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import star, temporal
from tests.conftest import rows_of

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
END = date(9999, 12, 31)
STATE = "key string, name string, changed date, valid_from date, valid_to date, is_current boolean"
BATCH = "key string, name string, changed date"


def d(n):
    return date(2020, 1, 1) + timedelta(days=n)


def merge(state, batch):
    return temporal.scd2_apply(state, batch, "key", ["name"], "changed")


def test_merge_cases(frame):
    state = frame([
        ("same", "a", d(0), d(0), END, True), ("moved", "a", d(0), d(0), END, True), ("filled", None, d(0), d(0), END, True),
        ("emptied", "a", d(0), d(0), END, True), ("absent", "a", d(0), d(0), END, True),
        ("moved", "old", d(-9), d(-9), d(0), False),
    ], STATE)
    batch = frame([("same", "a", d(5)), ("moved", "b", d(5)), ("filled", "x", d(5)), ("emptied", None, d(5)), ("new", "n", d(5))], BATCH)
    out = merge(state, batch)
    assert out.rejected.count() == 0
    assert rows_of(out.state, "key", "name", "valid_from", "valid_to", "is_current") == sorted([
        ("same", "a", d(0), END, True),
        ("moved", "old", d(-9), d(0), False), ("moved", "a", d(0), d(5), False), ("moved", "b", d(5), END, True),
        ("filled", None, d(0), d(5), False), ("filled", "x", d(5), END, True),
        ("emptied", "a", d(0), d(5), False), ("emptied", None, d(5), END, True),
        ("absent", "a", d(0), END, True), ("new", "n", d(5), END, True),
    ], key=repr)
    assert rows_of(merge(out.state, batch).state) == rows_of(out.state)


def test_rejected_rows_leave_the_state_alone(frame):
    state = frame([("k", "a", d(10), d(10), END, True), ("two", "a", d(0), d(0), END, True)], STATE)
    batch = frame([("k", "b", d(5)), ("two", "b", d(5)), ("two", "c", d(6)), (None, "z", d(5)), ("undated", "z", None)], BATCH)
    out = merge(state, batch)
    assert rows_of(out.state) == rows_of(state)
    assert rows_of(out.rejected, "key", "_reject_reason") == sorted([
        ("k", "before_open_version"), ("two", "dup_key"), ("two", "dup_key"), (None, "null_key"), ("undated", "null_change_date")], key=repr)


CHANGES = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["x", "y", None])), min_size=1, max_size=24)


@SLOW
@given(CHANGES)
def test_history_equals_applying_changes_one_by_one(frame, changes):
    rows = [(f"k{k}", a, datetime(2020, 1, 1) + timedelta(hours=7 * i), i) for i, (k, a) in enumerate(changes)]
    log = frame(rows, "key string, attr string, ts timestamp_ntz, n int")
    got = rows_of(temporal.history_from_changes(log, "key", ["attr"], "ts", "n"))
    state: dict = {}
    for key, attr, ts, _ in rows:
        versions = state.setdefault(key, [])
        if versions and versions[-1][0] == attr:
            continue
        versions.append((attr, ts))
    want = []
    for key, versions in state.items():
        ends = [v[1] for v in versions[1:]] + [datetime(9999, 12, 31)]
        want += [(key, a, t, e, e.year == 9999) for (a, t), e in zip(versions, ends)]
    assert got == sorted(want, key=repr)


@SLOW
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["x", "y"])), min_size=1, max_size=4, unique_by=lambda t: t[0]),
                min_size=1, max_size=3))
def test_merged_batches_have_no_gaps_or_overlaps(frame, batches):
    state = frame([], STATE)
    for i, batch in enumerate(batches):
        state = merge(state, frame([(f"k{k}", a, d(i)) for k, a in batch], BATCH)).state
    rows = state.collect()
    for key in {r["key"] for r in rows}:
        spans = sorted((r["valid_from"], r["valid_to"], r["is_current"], r["name"]) for r in rows if r["key"] == key)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(a[3] != b[3] for a, b in zip(spans, spans[1:]))
        assert [s[2] for s in spans] == [False] * (len(spans) - 1) + [True] and spans[-1][1] == END


def test_neighbours_of_a_hot_key(frame):
    rows = [("hot", datetime(2020, 1, 1) + timedelta(minutes=13 * i), i) for i in range(400)] + [("one", datetime(2020, 1, 1), 999)]
    rows += [(None, None if i < 3 else datetime(2020, 1, 1 + i), 1000 + i) for i in range(20)]
    df = frame(rows, "key string, ts timestamp_ntz, n int")
    out = temporal.with_neighbours(df, "key", ["ts", "n"], ["n"], "p", "x")
    n = lambda x: x["n"] if x else None
    want = {(i, i - 1 if i else None, i + 1 if i < 399 else None) for i in range(400)} | {(999, None, None)}
    want |= {(1000 + i, 999 + i if i else None, 1001 + i if i < 19 else None) for i in range(20)}
    assert {(r["n"], n(r["p"]), n(r["x"])) for r in out.collect()} == want


def test_versions_of_a_null_key(frame):
    rows = [(None, "a", datetime(2020, 1, 1), 1), (None, "a", datetime(2020, 1, 2), 2), (None, "b", datetime(2020, 1, 3), 3)]
    out = temporal.history_from_changes(frame(rows, "key string, attr string, ts timestamp_ntz, n int"), "key", ["attr"], "ts", "n")
    assert rows_of(out, "attr", "is_current") == [("a", False), ("b", True)]
    assert temporal.history_from_changes(frame([], "key string, attr string, ts timestamp_ntz, n int"), "key", ["attr"], "ts", "n").count() == 0


def test_as_of_bounds(frame):
    df = frame([("a", d(0), d(10), datetime(2020, 6, 1)), ("a", d(10), END, datetime(2020, 7, 1))],
               "k string, valid_from date, valid_to date, ingestion_date timestamp_ntz")
    at = lambda n, known=None: [r["valid_from"] for r in temporal.as_of(df, d(n).isoformat(), known).collect()]
    assert at(-1) == [] and at(0) == [d(0)] and at(9) == [d(0)] and at(10) == [d(10)]
    assert at(10, "2020-06-15") == []


def test_axes_fall_back_to_ingestion(frame):
    df = frame([("2020-01-01", "2021-05-05T10:00:00+00:00"), (None, "2021-05-05T10:00:00+00:00")], "day string, _ingestion_ts string")
    assert rows_of(temporal.with_axes(df, "day"), "effective_date") == [(date(2020, 1, 1),), (date(2021, 5, 5),)]


def test_dates_that_are_none_do_not_stop_the_job(frame):
    df = frame([("soon", "never"), ("2020-02-30", "2021-05-05T10:00:00+00:00")], "day string, _ingestion_ts string")
    out = temporal.with_axes(df, "day")
    assert rows_of(out, "effective_date") == sorted([(None,), (date(2021, 5, 5),)], key=repr)
    row = temporal.null_audit({"t": out}).first()
    assert (row["n_rows"], row["effective_null"], row["ingestion_null"]) == (2, 1, 1)


DIM = "k string, sk string, valid_from date, valid_to date"


@pytest.mark.parametrize("slices", [None, ("2019-01-01", "2021-12-31", 30), ("2030-01-01", "2031-12-31", 7), ("1990-01-01", "1991-12-31", 400)])
def test_point_in_time_join(frame, slices):
    dim = frame([("a", "a1", d(0), d(10)), ("a", "a2", d(10), d(800)), ("a", "a3", d(800), END), ("b", "b1", date(1900, 1, 1), END),
                 ("a", "none", d(3), d(3))], DIM)
    fact = frame([(1, "a", d(-1)), (2, "a", d(0)), (3, "a", d(9)), (4, "a", d(10)), (5, "a", d(800)), (6, "b", date(1850, 1, 1)),
                  (7, "b", date(3000, 1, 1)), (8, "c", d(0)), (9, None, d(0)), (10, "a", None)], "id int, k string, at date")
    got = dict(rows_of(star.pit_join(fact, "at", dim, "k", "sk", slices), "id", "sk"))
    assert got == {1: None, 2: "a1", 3: "a1", 4: "a2", 5: "a3", 6: None, 7: "b1", 8: None, 9: None, 10: None}


def test_overlapping_versions_multiply_and_are_reported(ctx):
    dim = ctx.m.dim_investor
    doubled = dim.unionByName(dim.withColumn("investor_sk", F.concat("investor_sk", F.lit("x"))))
    t = ctx.m.conformed
    fact = star.investment_fact(t["investments"], t["funding_rounds"], ctx.m.dim_company, doubled)
    report = {r["check_name"]: r["status"] for r in star.certify(fact, ctx.m.dim_company, doubled, t["investments"]).collect()}
    assert report["rowcount reconcile fact_investment vs conformed_investments"] == "FAIL"
    assert report["envelope one-current-per-key [dim_investor]"] == "FAIL"
