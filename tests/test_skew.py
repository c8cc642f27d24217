"""One key holds a third of the rows: results stay whole and no task gets the whole key."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.landing import materialize
from ledgerloom.operators import quality, reconcile, relations, star, temporal
from ledgerloom.operators.identity import remap
from ledgerloom.operators.validate import repeated_keys, with_key_count
from ledgerloom.sources.landing import materialize

N = 60_000


@pytest.fixture
def big(spark):
    """`id`, a key `k` that is `hot` for a third of the rows, a date and some width."""
    return spark.range(0, N, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("at"),
        F.sha2(F.col("id").cast("string"), 256).alias("width"),
    )


@contextmanager
def cluster_like(spark):
    """No broadcast, and skew thresholds scaled down to the size of the test."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, x in wanted.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def dims(spark):
    return spark.sql("""select concat('k', id) k, id from range(5000) union all select 'hot', -1""")


def test_remap_splits_a_hot_key(spark, big):
    mapping = dims(spark).select(F.col("k").alias("vendor_id"), F.lit("t").alias("entity_type"), F.lit("s").alias("source_system"),
                                 F.concat(F.lit("c"), "k").alias("canonical_id"))
    with cluster_like(spark):
        out = remap(big.withColumn("best_source", F.lit("s")), mapping, {"k": ("t", "cid")})
        assert "skew=true" in final_plan(out)
        assert out.count() == N and out.filter(F.col("cid") != F.concat(F.lit("c"), "k")).count() == 0


def test_point_in_time_join_splits_a_hot_key(spark, big):
    years = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    dim = dims(spark).withColumn("y", years).selectExpr(
        "k", "concat(k, '-', y) sk", "make_date(2020 + y, 1, 1) valid_from",
        "if(y = 2, date'9999-12-31', make_date(2021 + y, 1, 1)) valid_to")
    with cluster_like(spark):
        out = star.pit_join(big, "at", dim, "k", "sk")
        assert "skew=true" in final_plan(out)
        assert out.count() == N
        assert out.filter(F.col("sk") != F.concat("k", F.lit("-"), F.year("at") - 2020)).count() == 0
        sliced = star.pit_join(big, "at", dim, "k", "sk", slices=("2020-01-01", "2022-12-31", 30))
        assert sliced.exceptAll(out.select(sliced.columns)).count() == 0 and sliced.count() == N


def test_sliced_versions_are_not_broadcast(spark):
    """200 versions in a file of some kB are 72,800 rows when sliced by day, which the file's size does not tell."""
    dim = materialize(spark.sql("SELECT concat('k', id) k, sha2(concat('k', id), 256) sk, date'2020-01-01' valid_from, date'9999-12-31' valid_to FROM range(200)"))
    facts = spark.sql("SELECT concat('k', id % 201) k, date_add(date'2020-01-01', cast(id % 400 AS int)) at, id FROM range(2000)")
    out = star.pit_join(facts, "at", dim, "k", "sk", slices=("2020-01-01", "2020-12-30", 1))
    assert "Broadcast" not in final_plan(out)
    assert out.filter("sk is not distinct from if(k = 'k200', null, sha2(k, 256))").count() == out.count() == 2000


def test_repeated_keys_are_counted_not_gathered(spark, big):
    with cluster_like(spark):
        lazy = with_key_count(big, "k")
        assert "skew=true" in final_plan(lazy)
        assert lazy.filter("k = 'hot'").agg(F.min("_copies"), F.max("_copies"), F.count("*")).first()[:] == (N // 3, N // 3, N // 3)
    known = materialize(spark.createDataFrame([("hot", N // 3)], "_k string, _copies long"))
    in_place = with_key_count(big, "k", repeated=known)
    plan = final_plan(in_place)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert in_place.filter("_copies > 1").count() == N // 3


def test_rows_tagged_by_key_are_in_place_for_a_join_on_it(spark):
    """NULL keys are counted aside, so one shuffle of the feed serves the tag and the identity map."""
    feed = materialize(spark.sql("SELECT if(id < 3, NULL, concat('k', id div 2)) AS k, id FROM range(1000)"))
    known = materialize(repeated_keys(feed, "k"))
    ids = spark.sql("SELECT concat('k', id) AS k, id AS canonical FROM range(600)")
    with cluster_like(spark):
        tagged = with_key_count(feed, "k", repeated=known)
        plan = tagged.join(materialize(ids), "k", "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
        want = with_key_count(feed, "k")
        assert sorted(map(tuple, tagged.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert {r["_copies"] for r in tagged.filter("k is null").collect()} == {3}


def test_alignment_combines_a_hot_id_before_the_shuffle(spark, big):
    feed = big.select(F.col("k").alias("canonical_id"), F.col("width").alias("_record_id"), F.col("id").alias("v"))
    df = reconcile.align({"feed_a": feed, "feed_b": feed}, "canonical_id", ["v"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Join" not in plan
    hot = df.filter("canonical_id = 'hot'").collect()
    assert len(hot) == 1
    want = big.filter("k = 'hot'").agg(F.min_by("id", "width")).first()[0]
    assert hot[0]["feed_a"]["v"] == hot[0]["feed_b"]["v"] == want


def test_edges_in_both_feeds_do_not_pile_up_under_a_company(spark, big):
    aligned = big.select(
        F.col("id").cast("string").alias("canonical_id"), F.struct("id").alias("feed_a"),
        F.when(F.col("id") % 9 != 0, F.struct("id")).alias("feed_b"), F.col("k").alias("company_id"))
    cover = dims(spark).select(F.col("k").alias("canonical_id"), F.lit(2).cast("long").alias("n_sources"))
    with cluster_like(spark):
        out = reconcile.reconcile_investments(aligned, cover)
        assert out.count() == N
        assert out.filter("is_genuine").count() == len(range(0, N, 9))


def test_history_of_a_hot_key(spark, big):
    changes = big.select("k", (F.col("id") % 7).alias("attr"), F.timestamp_seconds(F.col("id") * 61).cast("timestamp_ntz").alias("ts"), "id")
    out = temporal.history_from_changes(changes, "k", ["attr"], "ts", "id")
    hot = out.filter("k = 'hot'")
    # Every third id: the attribute moves on each row, so each row is a version that ends where the next starts.
    assert hot.count() == N // 3
    assert hot.filter("is_current").count() == 1
    assert hot.filter("not is_current and unix_seconds(cast(valid_to as timestamp)) - unix_seconds(cast(valid_from as timestamp)) <> 183").count() == 0


def test_one_key_on_one_day_is_cut(spark, big):
    """A third of the rows have one key and one day; no task reads a tenth of all rows."""
    parts = 32
    changes = big.select("k", (F.col("id") % 7).alias("attr"), F.timestamp_seconds(F.col("id") % 80_000).cast("timestamp_ntz").alias("ts"), "id")
    written = []
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = temporal.with_neighbours(changes, "k", ["ts", "id"], ["id"], "p", "n", keep=lambda df: written.append(materialize(df)) or written[-1])
        assert out.count() == N and out.filter("p is null").count() == out.select("k").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert written[0].groupBy("_part").count().agg(F.max("count")).first()[0] < N / 10


def test_key_checks_combine_before_the_shuffle(spark, big):
    df = big.selectExpr("k", "at valid_from", "date'9999-12-31' valid_to", "id < 3 is_current")
    plan = quality.entity_counts(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "partial_count" in plan
    row = quality.entity_counts(df, "k").first()
    assert (row["multi"], row["with_current"], row["n_groups"]) == (0, 3, 5001)


def test_coinvestment_counts_form_no_pairs(spark, big):
    edges = big.selectExpr("id % 2000 investor_id", "k round_id", "k company_id", "true is_current")
    out = relations.coinvestment_degree(edges)
    rows = {(r["investor_id"], r["k"]) for r in big.selectExpr("id % 2000 investor_id", "k").distinct().collect()}
    sizes: dict = {}
    for _, k in rows:
        sizes[k] = sizes.get(k, 0) + 1
    want: dict = {}
    for i, k in rows:
        want[i] = want.get(i, 0) + sizes[k] - 1
    assert {r["investor_id"]: r["other_seats"] for r in out.collect()} == want
