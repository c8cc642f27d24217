"""Assertions fail on corrupted input; dimensions on odd input; the full run."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.functions.scalars import surrogate_key
from ledgerloom.operators import quality, reconcile, star, validate
from ledgerloom.operators.identity import coverage
from ledgerloom.plans.medallion import CONFORMED_KEYS, REFERENCES, Medallion, run
from ledgerloom.plans.queries_quality import entity_report
from ledgerloom.plans.registry import RESOLVED_AT, groups_of_segments
from ledgerloom.sources import landing
from ledgerloom.sources.contracts import CONTRACTS
from ledgerloom.sources.landing import materialize
from ledgerloom.sources.fixtures import Fixtures
from tests.conftest import rows_of


def statuses(df):
    return {r["check_name"]: r["status"] for r in df.collect()}


SPOIL = {
    "envelope no-nulls": lambda df, key: df.withColumn("valid_from", F.lit(None).cast("date")),
    "envelope valid_from<=valid_to": lambda df, key: df.withColumn("valid_to", F.lit("1800-01-01").cast("date")),
    "envelope one-current-per-key": lambda df, key: df.withColumn("is_current", F.lit(False)),
    "rowcount reconcile": lambda df, key: df.limit(3),
    "status domain": lambda df, key: df.withColumn("reconciliation_status", F.lit("odd")),
}


@pytest.mark.parametrize("entity", CONFORMED_KEYS)
def test_each_table_check_can_fail(ctx, entity):
    df = ctx.m.conformed[entity]
    for check, spoil in SPOIL.items():
        got = statuses(entity_report(ctx, entity, spoil(df, CONFORMED_KEYS[entity])))
        assert got[f"{check} [{entity}]"] == "FAIL", check
    double = statuses(entity_report(ctx, entity, df.unionByName(df)))
    assert double[f"envelope one-current-per-key [{entity}]"] == "FAIL"


@pytest.mark.parametrize("name, child, fk, parent, pk", REFERENCES)
def test_each_reference_check_can_fail(ctx, name, child, fk, parent, pk):
    gone = ctx.m.conformed[parent].limit(1)
    assert statuses(quality.check_reference(name, ctx.m.conformed[child], fk, gone, pk)) == {name: "FAIL"}


def test_all_45_checks_pass(ctx):
    got = ctx.m.assertions()
    assert got.count() == 45 and got.filter("status <> 'PASS'").count() == 0
    assert got.filter("not is_hard").count() == 4


def test_gold_checks(ctx):
    got = statuses(ctx.m.gold_assertions())
    assert sorted(got.values()) == ["PASS"] * 6 + ["WARN"]


def test_soft_failures_do_not_raise(frame):
    schema = "check_name string, status string, is_hard boolean, detail string"
    quality.enforce(frame([("a", "WARN", False, ""), ("b", "PASS", True, "")], schema))
    with pytest.raises(quality.QualityError, match="b"):
        quality.enforce(frame([("a", "WARN", False, ""), ("b", "FAIL", True, "")], schema))


def test_null_status_is_shown(ctx):
    df = ctx.m.conformed["investors"].withColumn("reconciliation_status", F.lit(None).cast("string"))
    row = entity_report(ctx, "investors", df).filter("check_name like 'status%'").first()
    assert row["status"] == "PASS" and row["detail"] == "0 rows outside allowed set, 10 null"


def test_company_dimension_of_odd_tags(frame):
    rows = [(str(i), t) for i, t in enumerate(['["SaaS"]', '["Payments","SaaS"]', "[]", "not json", None, '["Nope"]', "[null]"])]
    df = frame(rows, "company_id string, sector_taxonomy string").selectExpr(
        "*", "'n' legal_name", "'c' country", "date'2020-01-01' effective_date", "date'2020-01-01' valid_from",
        "date'9999-12-31' valid_to", "true is_current")
    got = dict(rows_of(star.company_dimension(df), "company_id", "sector_group"))
    assert got == {"0": "Information Technology", "1": "Financials", "2": None, "3": None, "4": None, "5": None, "6": None}
    assert star.unmatched_tags(star.company_dimension(df)).first()["no_group"] == 5


def test_taxonomy_is_one_group_per_tag():
    tags = [t for tags in v.SECTOR_GROUPS.values() for t in tags]
    assert len(tags) == len(set(tags)) == 35 and len(v.SECTOR_GROUPS) == 8


def test_surrogate_keys_do_not_skip_nulls(frame):
    df = frame([("C-1", None), ("C-1", "x")], "a string, b string")
    keys = [r[0] for r in df.select(surrogate_key("a", "b")).collect()]
    assert keys[0] is None and len(keys[1]) == 64


def test_date_dimension_of_no_dates(frame):
    assert star.date_dimension([frame([], "d date")]).count() == 0


def test_run_writes_every_stage_and_certifies(spark, sf_dir, tmp_path):
    m = run(spark, Fixtures(spark, sf_dir), str(tmp_path), RESOLVED_AT, groups_of_segments())
    written = {p.name for p in tmp_path.iterdir()}
    assert {"vendor_id_mapping", "reconciliation_log", "dq_assertions_report", "gold_dq_assertions_report", "gold_fact_investment",
            "gold_dim_date", "validation_summary", "stg_quarantine_feed_a_investments"} <= written
    assert "stg_quarantine_feed_a_companies" not in written
    assert {f"conformed_{e}" for e in CONFORMED_KEYS} <= written
    assert m.fact.count() == 3402


def test_feeds_are_not_copied_and_edges_are_joined_once(spark, sf_dir):
    kept = []

    def keep(name, df):
        kept.append((name, df.columns))
        return materialize(df)

    m = Medallion(Fixtures(spark, sf_dir, keep), RESOLVED_AT, groups_of_segments(), keep)
    assert m.fact.count() == 3402
    names = [name for name, _ in kept]
    assert not [n for n in names if n.startswith(("landing_", "stg_tagged_"))] and names.count("edge_base") == 1
    assert not [n for n, columns in kept if "_record_id" in columns]
    tagged = m.gates["feed_a", "investments"].tagged
    assert tagged.columns == [*m.landing["feed_a", "investments"].columns, "_quarantine_reason", "_valid"]
    # The hash of the record id is worked out behind the join with the repeated keys.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tagged.select("_record_id", "_valid")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("sha2(") < plan.index("Join ") and plan.count("sha2(") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_provider_without_raw_feeds_is_written_once(spark, sf_dir):
    class Plain:
        def __init__(self):
            self.inner = Fixtures(spark, sf_dir)
            self.feed, self.mapping = self.inner.feed, self.inner.mapping

    names = []

    def keep(name, df):
        names.append(name)
        return materialize(df)

    assert Medallion(Plain(), RESOLVED_AT, groups_of_segments(), keep).fact.count() == 3402
    assert names.count("landing_feed_a_investments") == 1


def test_run_sets_unmapped_rows_apart(spark, sf_dir, tmp_path):
    class Partial(Fixtures):
        def mapping(self, entity_type=None):
            return super().mapping(entity_type).filter("vendor_id <> 'B-I-3'")

    # Investments that only feed B has lose their investor, which the gold checks must not let pass.
    with pytest.raises(quality.QualityError, match="point-in-time investor"):
        run(spark, Partial(spark, sf_dir), str(tmp_path), RESOLVED_AT, groups_of_segments())
    left = spark.read.parquet(str(tmp_path / "stg_unmapped_feed_b_investors"))
    assert rows_of(left, "vendor_investor_id", "_quarantine_reason") == [("B-I-3", "unmapped")]
    assert not (tmp_path / "stg_unmapped_feed_a_investors").exists()


def test_run_stops_on_a_hard_failure(spark, sf_dir, tmp_path):
    class Broken(Fixtures):
        def deals(self):
            return super().deals().withColumn("company_id", F.lit("C-none"))

    with pytest.raises(quality.QualityError, match="deals.company_id"):
        run(spark, Broken(spark, sf_dir), str(tmp_path), RESOLVED_AT, groups_of_segments())
    assert (tmp_path / "dq_assertions_report").exists()


def test_rounds_and_companies_do_not_wait_for_the_edges(spark, sf_dir):
    names = []

    def keep(name, df):
        names.append(name)
        return materialize(df)

    m = Medallion(Fixtures(spark, sf_dir, keep), RESOLVED_AT, groups_of_segments(), keep)
    assert m.conformed["funding_rounds"].count() and m.conformed["companies"].count() and m.identified("feed_a", "investors").count()
    assert not [n for n in names if n == "edge_base" or n.endswith(("investments", "=investment"))]


def test_coverage_comes_with_the_company_key_and_orders_are_short(spark, sf_dir):
    m = Medallion(Fixtures(spark, sf_dir), RESOLVED_AT, groups_of_segments())
    apart = reconcile.reconcile_investments(m.aligned("investments"), coverage(m.maps["company"]))
    columns = ["canonical_id", "company_id", "is_genuine", "is_coverage", "reconciliation_status", "conflicts"]
    assert rows_of(m.reconciled["investments"], *columns) == rows_of(apart, *columns)
    assert m.reconciled["investments"].columns == apart.columns
    ordered, by = m._ordered("feed_a", "investors")
    assert ordered.schema[by].dataType.simpleString() == "bigint"
    assert ordered.orderBy(by).select("_record_id").collect() == ordered.orderBy("_record_id").select("_record_id").collect()


def test_rows_set_apart_are_worked_out_once_for_the_write(spark, sf_dir, tmp_path):
    m = Medallion(Fixtures(spark, sf_dir), RESOLVED_AT, groups_of_segments())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for feed, bad in ((("feed_a", "investments"), True), (("feed_a", "companies"), False)):
            gate = validate.validate_feed(m.landing[feed], CONTRACTS[feed[1]], repeated=materialize(
                validate.repeated_keys(m.landing[feed], CONTRACTS[feed[1]].pk)))
            assert gate.suspects.isEmpty() == gate.quarantine.isEmpty() == (not bad)
            joins = [d._jdf.queryExecution().optimizedPlan().toString().count("Join ") for d in (gate.suspects, m.landing[feed], gate.quarantine)]
            assert joins[0] <= joins[1] < joins[2]
            assert landing.save_if_any(gate.quarantine, str(tmp_path / "q"), gate.suspects) == bad
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Lineage is stamped behind the join with the identity map too, so no hash travels to it.
    plan = m.identified("feed_b", "funding_rounds").select("_record_id", "canonical_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.index("Join ") and plan.count("sha2(") == 1


def test_conformed_tables_do_not_need_written_reconciled_ones(spark, sf_dir):
    """Straight from the alignment, edges with the day of their round brought along by its key, or from the written rows."""
    names = []

    def keep(name, df):
        names.append(name)
        return materialize(df)

    direct = Medallion(Fixtures(spark, sf_dir, keep), RESOLVED_AT, groups_of_segments(), keep)
    tables = {e: direct.conformed[e] for e in ("funding_rounds", "investments")}
    assert not [n for n in names if n.startswith("reconciled_")]
    written = Medallion(Fixtures(spark, sf_dir, keep), RESOLVED_AT, groups_of_segments(), keep)
    written.reconciled.build(tables)
    for entity, df in tables.items():
        assert df.columns == written.conformed[entity].columns and rows_of(df) == rows_of(written.conformed[entity])
