"""What the stages hold at once: on the disk while they are written, and in memory for a join."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import documents, relations
from ledgerloom.operators.identity import attach_canonical
from ledgerloom.plans import medallion
from ledgerloom.plans.medallion import Medallion, write_stages
from ledgerloom.session import CLEANUP, shuffles_dropped
from ledgerloom.sources.fixtures import Fixtures
from ledgerloom.sources.landing import looked_up, materialize
from tests.conftest import rows_of

RESOLVED = "2002-01-01 00:00:00"


@pytest.fixture
def folder(frame, tmp_path):
    """A few tables of their own: 60 companies, 12 investors, 120 rounds with three lines each."""
    day = datetime(1998, 3, 1)
    tables = {
        "nation": ([(k, f"N{k}") for k in range(3)], "n_nationkey int, n_name string"),
        "customer": ([(k, f"Company {k}", k % 3, 1.0, "BUILDING") for k in range(1, 61)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(k, f"Fund {k}", k % 3, 10.0 * k) for k in range(1, 13)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "orders": ([(k, k % 60 + 1, "F", 1000.0 + k, day) for k in range(1, 121)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"),
        "lineitem": ([(k, k * 7 + n, k % 12 + 1, n, 100.0 * k + n, "R" if k % 2 else "N") for k in range(1, 121) for n in (1, 2, 3)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        frame(rows, schema).write.parquet(f"{tmp_path}/in/{name}.parquet")
    return tmp_path


def stages(spark, folder, out):
    keep = write_stages(spark, f"{folder}/{out}")
    return Medallion(Fixtures(spark, f"{folder}/in", keep), RESOLVED, None, keep)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{at}/{f}" for d in dirs for at, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_table_of_many_rows_is_not_broadcast_for_its_small_files(spark, frame):
    feed = frame([("a-1", 1), ("a-9", 2), (None, 3)], "vendor_id string, n int")
    ids = materialize(frame([("x", f"a-{k}", "feed_a", f"C-{k}") for k in range(8)],
                            "entity_type string, vendor_id string, source_system string, canonical_id string"))
    few, many = (attach_canonical(feed, looked_up(ids, most), "x", "feed_a", "vendor_id") for most in (8, 7))
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
    assert rows_of(few) == rows_of(many) == sorted([("a-1", 1, "C-1"), ("a-9", 2, None), (None, 3, None)], key=repr)


def test_stages_do_not_broadcast_long_identity_maps_and_rounds(spark, folder, monkeypatch):
    usual = stages(spark, folder, "usual")
    want = rows_of(usual.conformed["investments"].drop("ingestion_date")), rows_of(usual.fact)
    monkeypatch.setattr(medallion, "looked_up", lambda df: looked_up(df, 10))
    m = stages(spark, folder, "long")
    for entity in ("companies", "investments"):
        assert "SortMergeJoin" in plan(m.identified("feed_a", entity)) and "SortMergeJoin" not in plan(usual.identified("feed_a", entity))
    text = plan(m.aligned("investments", covered=True, closed=True)).split("Initial Plan")[0]
    assert text.count("SortMergeJoin") >= 5 and "BroadcastHashJoin" not in text  # three keys, coverage and the rounds' days
    assert (rows_of(m.conformed["investments"].drop("ingestion_date")), rows_of(m.fact)) == want and len(want[0]) > 200


def test_shuffle_files_go_when_a_stage_is_written(spark, tmp_path):
    keep, before, had = write_stages(spark, str(tmp_path)), spark.conf.get(CLEANUP, None), shuffle_files(spark)
    grouped = spark.range(50_000).groupBy((F.col("id") % 20_000).alias("k")).count()
    assert keep("grouped", grouped).count() == materialize(grouped).count() == 20_000
    for _ in range(100):
        left = sum(os.path.getsize(p) for p in shuffle_files(spark) - had if os.path.exists(p))
        if left < 20_000:  # the counts' own shuffles, of a row for each task, may stay
            break
        time.sleep(0.1)
    assert left < 20_000
    with shuffles_dropped(spark):
        with shuffles_dropped(spark):
            assert spark.conf.get(CLEANUP) == "true"
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP, None) == before


def test_edges_are_identified_and_aligned_in_steps(spark, folder):
    m = stages(spark, folder, "out")
    assert m.conformed["investments"].count() > 200
    made = os.listdir(f"{folder}/out")
    assert {"aligned_investments", "aligned_funding_rounds"} <= set(made) and not [x for x in made if x.startswith("identified")]


def test_letters_broadcast_funds_and_not_their_quarters(spark, frame):
    held = frame([(f"I-{k % 5}", f"C-{k}", True) for k in range(40)], "investor_id string, company_id string, is_current boolean")
    funds = frame([(f"I-{k}", f"Fund {k}", year, True) for k, year in enumerate((1999, 2001, None, 2090, 1990))],
                  "investor_id string, legal_name string, vintage_year int, is_current boolean")
    names = frame([(f"C-{k}", f"Company {k}", True) for k in range(40)], "company_id string, legal_name string, is_current boolean")
    letters = documents.quarterly_letters(held, materialize(funds), names, "2002-01-01")
    text = plan(letters).split("Initial Plan")[0]
    assert "Generate explode" in text and "Generate explode" not in text[text.index("BroadcastExchange HashedRelation", text.index("Generate explode")):]
    ends = documents.quarter_ends("2002-01-01")
    got = rows_of(letters.groupBy("investor_id").count())
    assert got == sorted((f"I-{k}", sum(q.year >= year for q in ends)) for k, year in ((0, 1999), (1, 2001), (4, 1990)))
    assert all(v_min <= n <= v_max for n, v_min, v_max in (
        (len(r["refs"]) - 1, documents.v.HIGHLIGHTS_MIN, documents.v.HIGHLIGHTS_MAX) for r in letters.collect()))


def test_comparables_are_broadcast_by_their_rows(spark, frame, monkeypatch):
    dims = frame([(f"C-{k}", "Consumer", True) for k in range(9)], "company_id string, sector_group string, is_current boolean")
    rounds = frame([(f"R-{k}", f"C-{k}", "Seed" if k < 6 else "Series A", datetime(2000, 1, 1), True) for k in range(9)],
                   "round_id string, company_id string, round_type string, announced_date timestamp_ntz, is_current boolean")
    edges = frame([(f"I-{k % 3}", f"R-{k}", f"C-{k}") for k in range(9)], "investor_id string, round_id string, company_id string")
    start = relations.seeds(frame([("C-1",)], "company_id string"), "company_id")
    run = lambda: relations.backed_by_comparables_investors(dims, rounds, edges, start)
    want = rows_of(run())
    assert want == [("C-1", "C-6"), ("C-1", "C-7"), ("C-1", "C-8")]
    monkeypatch.setattr(relations, "looked_up", lambda df: looked_up(df, 3))
    few = plan(run()).count("SortMergeJoin")
    assert few >= 2 and rows_of(run()) == want
