"""Clustering on several columns, bucket merges and slices from one scan."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import buckets, measures, temporal
from ledgerloom.plans.registry import AS_OF
from ledgerloom.session import shared_dir
from ledgerloom.sources import layout
from tests.conftest import rows_of
from tests.test_temporal import BATCH, END, STATE, d

WIDE = "id int, n double, day date, s string"


@pytest.fixture
def wide(spark):
    """Skewed numbers (a third are one value), days and strings, with NULLs."""
    i = F.col("id")
    return spark.range(0, 30_000, numPartitions=4).select(
        i.cast("int").alias("id"), F.when(i % 3 == 0, 7.0).when(i % 101 != 0, (i * 7919 % 10007).cast("double")).alias("n"),
        F.when(i % 97 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (i * 31 % 1000).cast("int"))).alias("day"),
        F.concat(F.lit("k"), F.lpad((i * 13 % 5000).cast("string"), 4, "0")).alias("s"))


def test_a_filter_on_any_clustered_column_leaves_few_files(spark, wide):
    path = f"{shared_dir(spark)}/t"
    out = layout.cluster(wide, path, ["n", "day"], 36)
    assert out.exceptAll(wide).count() == 0 and out.count() == 30_000 and out.dtypes == wide.dtypes
    for column, low, high in (("n", 5000.0, 5010.0), ("day", date(2021, 1, 1), date(2021, 1, 5))):
        seen = layout.files_touched(out, column, low, high).first()
        assert 30 <= seen["n_files"] <= 36 and 0 < seen["n_read"] * 3 < seen["n_files"]
    sizes = [r["count"] for r in out.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert max(sizes) < 30_000 / 6  # the value with a third of the rows is in several files


def test_strings_are_ranked_by_their_beginning(spark, wide):
    out = layout.cluster(wide, f"{shared_dir(spark)}/t", ["s", "n"], 36)
    seen = layout.files_touched(out, "s", "k2000", "k2010").first()
    assert 0 < seen["n_read"] * 3 < seen["n_files"]
    with pytest.raises(TypeError):
        layout.cluster(wide.withColumn("a", F.array("n")), f"{shared_dir(spark)}/t", ["a"], 2)


def files_of(spark, path):
    return {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}


def test_bucket_merge_equals_the_whole_merge_and_touches_nothing_else(spark, frame):
    rng = np.random.default_rng(4)
    state = frame([(f"k{k}", "ab"[rng.integers(2)], d(0), d(0), END, True) for k in range(300)] + [("k1", "z", d(-9), d(-9), d(0), False)], STATE)
    batch = frame(
        [(f"k{k}", "c", d(5)) for k in range(6)] + [("k50", "ab"[0], d(-5)), ("k50b", "n", d(1)), ("k60", "x", d(1)), ("k60", "y", d(2)), (None, "n", d(1))], BATCH)
    path = f"{shared_dir(spark)}/t"
    layout.write_buckets(state, path, "key", 64)
    assert rows_of(layout.read_buckets(spark, path), *state.columns) == rows_of(state)
    before = files_of(spark, path)
    whole = temporal.scd2_apply(state, batch, "key", ["name"], "changed")
    got = buckets.merge_buckets(path, batch, "key", ["name"], "changed", 64)
    assert rows_of(layout.read_buckets(spark, path), *state.columns) == rows_of(whole.state, *state.columns)
    assert rows_of(got.rejected, "key", "name", "_reject_reason") == rows_of(whole.rejected, "key", "name", "_reject_reason")
    assert 0 < len(got.rewritten) < 12
    gone = before - files_of(spark, path)
    assert gone and all(any(f"_bucket={b}/" in x for b in got.rewritten) for x in gone)
    after = files_of(spark, path)
    again = buckets.merge_buckets(path, batch.filter("key <> 'k50' and key <> 'k60'"), "key", ["name"], "changed", 64)
    assert again.rewritten == [] and files_of(spark, path) == after


def test_slices_equal_the_measures_of_each_and_scan_the_fact_once(ctx):
    slices = {"all": (), "v": ("vintage_year",), "vs": ("vintage_year", "sector_group"), "t": ("investor_type",)}
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return ctx.keep(f"slices_{len(plans)}", df)

    got = measures.measure_slices(ctx.star, slices, {"country": ["GERMANY", "FRANCE", None]}, AS_OF, keep)
    measured = ["total_invested", "nav", "moic", "matched_rows"]
    for name, by in slices.items():
        want = measures.measure(ctx.star, list(by), {"country": ["GERMANY", "FRANCE", None]}, AS_OF)
        near = lambda rows: [tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows]
        assert near(rows_of(got.filter(F.col("slice") == name), *by, *measured)) == near(rows_of(want, *by, *measured))
    assert len(plans) == 1 and plans[0].count("participation_amount") > 0
    assert sum("realised_return_multiple" in line and "Relation" in line for line in plans[0].splitlines()) == 1
    blank = got.filter("slice = 'v' and vintage_year is null").count()
    assert blank == 1 and got.filter("slice = 'all'").count() == 1  # the blank member is not the total
    with pytest.raises(ValueError):
        measures.measure_slices(ctx.star, {"a": ("country",), "b": ("country",)}, None, AS_OF)
