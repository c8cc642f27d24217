"""Stage B boundaries and scoring."""

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from tests.conftest import rows_of

ROUND = "canonical_id string, _record_id string, announced_date date, amount_raised double"
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rounds(frame, a, b):
    feeds = {"feed_a": frame(a, ROUND), "feed_b": frame(b, ROUND)}
    return reconcile.reconcile_rounds(reconcile.align(feeds, "canonical_id", ["announced_date", "amount_raised"]))


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


def test_limits_are_strict(frame):
    a = [(str(i), f"a{i}", day(0), 100.0) for i in range(8)]
    b = [
        ("0", "b0", day(30), 100.0), ("1", "b1", day(31), 100.0), ("2", "b2", day(0), 95.0), ("3", "b3", day(0), 94.99),
        ("4", "b4", day(0), None), ("5", "b5", day(-31), 10.0), ("9", "b9", day(5), 1.0), ("7", "b7", None, 100.0),
    ]
    got = {r["canonical_id"]: r for r in rounds(frame, a, b).collect()}
    assert got["0"]["reconciliation_status"] == "clean"
    assert got["1"]["is_temporal"] and got["1"]["announced_date"] == day(0)
    assert got["2"]["reconciliation_status"] == "clean"
    assert got["3"]["is_value"] and got["3"]["amount_raised"] == 100.0
    assert got["4"]["reconciliation_status"] == "clean" and got["4"]["is_value"] is False
    assert got["5"]["reconciliation_status"] == "conflict_flagged" and got["5"]["is_temporal"]
    assert len(got["5"]["conflicts"]) == 2 and got["5"]["announced_date"] == day(-31)
    assert got["6"]["is_existence"] and got["6"]["reconciliation_status"] == "conflict_resolved"
    assert got["7"]["reconciliation_status"] == "clean" and got["7"]["announced_date"] == day(0)
    assert got["9"]["source_attribution"] == ["feed_b"] and got["9"]["amount_raised"] == 1.0


def test_zero_on_both_sides_is_clean(frame):
    got = rounds(frame, [("1", "a", day(0), 0.0)], [("1", "b", day(0), 0.0)]).first()
    assert got["reconciliation_status"] == "clean"


@SLOW
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 200), st.integers(1, 200)), min_size=1, max_size=30))
def test_conflicts_match_plain_python(frame, cases):
    a = [(str(i), f"a{i}", day(0), float(x)) for i, (_, x, _) in enumerate(cases)]
    b = [(str(i), f"b{i}", day(d), float(y)) for i, (d, _, y) in enumerate(cases)]
    got = {int(r["canonical_id"]): (r["is_temporal"], r["is_value"]) for r in rounds(frame, a, b).collect()}
    assert got == {i: (d > 30, abs(x - y) / max(x, y) > 0.05) for i, (d, x, y) in enumerate(cases)}


def test_many_vendor_rows_of_one_id_give_one_row(frame):
    a = [("hot", f"a{i:04}", day(i % 3), float(i)) for i in range(300)] + [("x", "ax", day(0), 1.0)]
    b = [("hot", f"b{i:04}", day(0), 0.0) for i in range(300)]
    got = {r["canonical_id"]: r for r in rounds(frame, a, b).collect()}
    assert set(got) == {"hot", "x"}
    assert got["hot"]["feed_a"]["amount_raised"] == 0.0


EDGE = "canonical_id string, _record_id string, vendor_company_id string, n int"


def edges(frame, a, b, companies):
    feeds = {"feed_a": frame(a, EDGE), "feed_b": frame(b, EDGE)}
    df = reconcile.align(feeds, "canonical_id", ["vendor_company_id", "n"])
    df = df.withColumn("company_id", F.col("feed_a.vendor_company_id"))
    df = df.withColumn("company_id", F.coalesce("company_id", F.col("feed_b.vendor_company_id")))
    return reconcile.reconcile_investments(df, frame(companies, "canonical_id string, n_sources long"))


def test_edge_split(frame):
    got = edges(
        frame,
        [("1", "a1", "both", 1), ("2", "a2", "both", 1), ("3", "a3", "one", 1), ("4", "a4", "unknown", 1), ("5", "a5", None, 1)],
        [("1", "b1", "both", 1)],
        [("both", 2), ("one", 1)],
    )
    status = dict(rows_of(got, "canonical_id", "reconciliation_status"))
    assert status == {"1": "clean", "2": "conflict_flagged", "3": "conflict_resolved", "4": "conflict_resolved", "5": "conflict_resolved"}


def test_investor_sizes(frame):
    schema = "canonical_id string, _record_id string, fund_size double"
    a = [("1", "a1", 100.0), ("2", "a2", None), ("3", "a3", 0.0), ("4", "a4", 100.0)]
    b = [("1", "b1", 120.0), ("2", "b2", 5.0), ("3", "b3", 0.0)]
    df = reconcile.reconcile_investors(
        reconcile.align({"feed_a": frame(a, schema), "feed_b": frame(b, schema)}, "canonical_id", ["fund_size"]))
    assert rows_of(df, "canonical_id", "fund_size", "reconciliation_status") == [
        ("1", 100.0, "conflict_flagged"), ("2", 5.0, "clean"), ("3", 0.0, "clean"), ("4", 100.0, "clean")]


def test_log_ids_are_stable_and_unique(ctx):
    log = ctx.m.log
    ids = rows_of(log, "reconciliation_id")
    assert len(set(ids)) == len(ids)
    assert ids == rows_of(reconcile.conflict_log(
        {k: ctx.m.reconciled[e] for k, e in (("company", "companies"), ("funding_round", "funding_rounds"),
                                             ("investor", "investors"), ("investment", "investments"))},
        "2002-01-01 00:00:00"), "reconciliation_id")


@pytest.mark.parametrize("drop, verdict", [(None, "PASS"), ("log", "REVIEW"), ("ledger", "REVIEW")])
def test_score_notices_missing_and_extra_rows(ctx, drop, verdict):
    log, ledger = ctx.m.log, ctx.m.ledger
    if drop == "log":
        log = log.filter("entity_type <> 'company'")
    if drop == "ledger":
        ledger = ledger.filter("entity_type <> 'company'")
    row = reconcile.score_log(log, ledger).first()
    assert row["verdict"] == verdict
    assert (row["recall"] < 1, row["precision"] < 1) == (drop == "log", drop == "ledger")


def test_score_notices_wrong_handling(ctx):
    wrong = ctx.m.log.withColumn("resolution_action", F.when(F.col("entity_type") == "investment", "auto_resolved").otherwise(
        F.col("resolution_action")))
    row = reconcile.score_log(wrong, ctx.m.ledger).first()
    assert row["genuine_mishandled"] > 0 and row["coverage_mishandled"] == 0 and row["verdict"] == "REVIEW"


def test_counts_of_the_fixture(ctx):
    """The branch counts measured for this scale when the projections were specified."""
    rounds = ctx.m.reconciled["funding_rounds"].groupBy("is_existence", "is_value", "is_temporal").count().collect()
    got = {(r["is_existence"], r["is_value"], r["is_temporal"]): r["count"] for r in rounds}
    assert got == {(True, False, False): 450, (False, False, False): 449, (False, True, False): 131,
                   (False, False, True): 372, (False, True, True): 98}
    edges_row = ctx.m.reconciled["investments"].agg(F.count_if("is_genuine"), F.count_if("is_coverage"), F.count("*")).first()
    assert tuple(edges_row) == (364, 1016, 3402)


def test_ledger_and_log_agree_at_the_threshold(frame):
    """Exactly five percent apart is no conflict, amounts below zero are compared by neither side."""
    pairs = {"R1": (100.0, 95.0), "R2": (100.0, 94.9), "R3": (-100.0, -200.0), "R4": (0.0, 10.0), "R5": (None, 5.0), "R6": (1.05, 1.0), "R7": (300.0, 285.0)}
    mapping = frame([("funding_round", k, s, f"{s}-{k}") for k in pairs for s in ("feed_a", "feed_b")],
                    "entity_type string, canonical_id string, source_system string, vendor_id string")
    feeds = {s: frame([(f"{s}-{k}", "2000-01-01", p[i]) for k, p in pairs.items()], "vendor_round_id string, announced_date string, amount_raised double")
             for i, s in enumerate(("feed_a", "feed_b"))}
    none = frame([], "vendor_investor_id string, fund_size double")
    ledger = reconcile.expected_ledger(mapping, feeds, {s: none for s in feeds}, frame([], "canonical_id string, company_id string"))
    aligned = frame([(k, (date(2000, 1, 1), a), (date(2000, 1, 1), b)) for k, (a, b) in pairs.items()],
                    "canonical_id string, feed_a struct<announced_date:date,amount_raised:double>, feed_b struct<announced_date:date,amount_raised:double>")
    log = reconcile.conflict_log({"funding_round": reconcile.reconcile_rounds(aligned)}, "2002-01-01 00:00:00")
    want = sorted((k,) for k, (a, b) in pairs.items() if a and b and max(a, b) > 0 and abs(a - b) / max(a, b) > 0.05)
    want += [("R4",)]  # the larger is positive
    assert rows_of(ledger, "canonical_id") == sorted(want) == rows_of(log, "entity_id")
    assert reconcile.score_log(log, ledger).first()["verdict"] == "PASS"


def test_thinned_edges_keep_status_attribution_and_best_row(frame):
    a = [("both", "a0", "C1", 1), ("a", "a2", "C1", 2), ("hole", "a3", None, None)]
    b = [("both", "b0", "C1", 7), ("b", "b2", "C2", 8), ("hole", "b3", "C1", 9)]
    feeds = {"feed_a": frame(a, EDGE), "feed_b": frame(b, EDGE)}
    whole = reconcile.align(feeds, "canonical_id", ["vendor_company_id", "n"]).withColumn("company_id", F.lit("C1"))
    thin = reconcile.thinned(whole)
    moved = {r["canonical_id"]: (r["feed_b"] is not None, r["feed_b"] and r["feed_b"]["n"]) for r in thin.collect()}
    assert moved == {"both": (True, None), "a": (False, None), "hole": (True, None), "b": (True, 8)}
    cover = frame([("C1", 2)], "canonical_id string, n_sources long")
    columns = ["canonical_id", "best", "reconciliation_status", "source_attribution", "conflicts"]
    full, cut = (
        rows_of(reconcile.reconcile_investments(df, cover).withColumn("best", reconcile.best_row()), *columns) for df in (whole, thin))
    assert full == cut and len(cut) == 4
