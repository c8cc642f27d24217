"""Queries over knowledge intervals, as-of merges, running totals, layouts and slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import bitemporal, buckets, measures, ordered, relations, temporal
from ledgerloom.plans.queries_quality import _PIT, _probes, _versions
from ledgerloom.plans.queries_measures import rounded
from ledgerloom.plans.queries_reconcile import _MERGED, change_batch, change_state
from ledgerloom.plans.registry import AS_OF, Context, query
from ledgerloom.sources.fixtures import tag
from ledgerloom.sources.landing import materialize
from ledgerloom.sources.layout import cluster, files_touched, read_buckets, write_buckets

#: Batch b becomes known at this moment; queries ask half a day after each, and once before all.
KNOWN = [f"2024-02-0{b + 1} 00:00:00" for b in range(4)]
ASKED_KNOWN = ["2024-01-31 12:00:00", *[x.replace("00:00:00", "12:00:00") for x in KNOWN]]
ASKED_VALID = ["2024-01-05 06:00:00", "2024-01-15 18:00:00", "2024-01-29 00:00:00"]


def arrivals(c: Context) -> DataFrame:
    """What arrives in which batch: each event in the batch of its week, a seventh of them one batch late; an eleventh
    is corrected two batches later, a thirteenth is taken back in the last batch."""
    e = c.t("events")
    id_, top = F.col("event_id"), F.lit(3)
    week = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    first = F.least((F.floor(week / 8) + F.when(id_ % 7 == 0, 1).otherwise(0)).cast("int"), top)

    def kind(n: int, batch: Column, attr: Column, when: Column | None = None) -> DataFrame:
        rows = e if when is None else e.filter(when)
        return rows.select(
            "event_id", tag("U", F.col("user_id").cast("string")).alias("key"), "ts", attr.alias("attr"), batch.cast("int").alias("batch"),
            F.lit(n).alias("kind"), F.lit(n == 2).alias("taken_back"))

    return kind(0, first, F.col("event_type")).unionByName(
        kind(1, F.least(first + 2, top), F.upper("event_type"), id_ % 11 == 0)).unionByName(
        kind(2, top, F.lit(None).cast("string"), id_ % 13 == 0))


_ARRIVALS = """
    SELECT *, least(CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER), 3) AS first FROM events"""
_ARRIVED = f"""
    SELECT event_id, 'U-' || user_id AS key, ts, event_type AS attr, first AS batch, 0 AS kind FROM ({_ARRIVALS})
    UNION ALL SELECT event_id, 'U-' || user_id, ts, upper(event_type), least(first + 2, 3), 1 FROM ({_ARRIVALS}) WHERE event_id % 11 = 0
    UNION ALL SELECT event_id, 'U-' || user_id, ts, NULL, 3, 2 FROM ({_ARRIVALS}) WHERE event_id % 13 = 0"""
#: For each batch b, the timelines that a replay of the batches up to b gives.
_TIMELINES = f"""
    SELECT b, key, attr, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY b, key ORDER BY ts), TIMESTAMP '9999-12-31') AS valid_to FROM (
        SELECT b, key, ts, arg_max(kind, (batch, event_id, kind)) AS kind, arg_max(coalesce(attr, ''), (batch, event_id, kind)) AS attr
        FROM ({_ARRIVED}) a JOIN (SELECT unnest([0, 1, 2, 3]) AS b) ON batch <= b GROUP BY b, key, ts) WHERE kind <> 2"""


def learned(c: Context, batches: int = 4) -> DataFrame:
    """The events' versions after so many batches, each applied to what the one before left."""
    if batches == 0:
        return bitemporal.nothing_known(arrivals(c), "key", ["attr"], "ts")
    return c.kept(f"knowledge_{batches}", lambda: _apply(c, learned(c, batches - 1), batches - 1))


def _apply(c: Context, table: DataFrame, b: int) -> DataFrame:
    batch = arrivals(c).filter(F.col("batch") == b)
    return bitemporal.learn(table, batch, "key", ["attr"], "ts", KNOWN[b], ["event_id", "kind"], "taken_back").state


@query("T6_as_known_then", f"""
    SELECT k AS known, v AS valid, key, attr, valid_from FROM ({_TIMELINES})
    JOIN (VALUES {", ".join(f"({b}, TIMESTAMP '{k}')" for b, k in enumerate(ASKED_KNOWN[1:]))}) kk(b2, k) ON b = b2
    JOIN (VALUES {", ".join(f"(TIMESTAMP '{x}')" for x in ASKED_VALID)}) vv(v) ON valid_from <= v AND valid_to > v""", covers="T6")
def as_known_then(c: Context) -> DataFrame:
    """Every asked pair of moments, the one before the first batch too, which gives no row."""
    table, moment = learned(c), lambda x: F.lit(x).cast("timestamp_ntz")
    parts = [
        temporal.as_of(table, moment(x), moment(k)).select(moment(k).alias("known"), moment(x).alias("valid"), "key", "attr", "valid_from")
        for k in ASKED_KNOWN for x in ASKED_VALID]
    return reduce(DataFrame.unionByName, parts)


@query("T6_knowledge_intervals", f"""
    SELECT key, attr, valid_from, valid_to, TIMESTAMP '2024-02-01' + CAST(min(b) AS INTEGER) * INTERVAL 1 DAY AS known_from,
           CASE WHEN max(b) = 3 THEN TIMESTAMP '9999-12-31' ELSE TIMESTAMP '2024-02-02' + CAST(max(b) AS INTEGER) * INTERVAL 1 DAY END AS known_to FROM (
        SELECT *, b - row_number() OVER (PARTITION BY key, attr, valid_from, valid_to ORDER BY b) AS island FROM ({_TIMELINES}))
    GROUP BY key, attr, valid_from, valid_to, island""", covers="T6 T4")
def knowledge(c: Context) -> DataFrame:
    return learned(c)


@query("T6_replayed_batch", f"""
    SELECT key, attr, valid_from, valid_to FROM ({_TIMELINES}) WHERE b = 3""", covers="T6")
def replayed(c: Context) -> DataFrame:
    """The last batch once more: what is known now does not change."""
    again = _apply(c, learned(c), 3)
    return again.filter("known_to > timestamp_ntz'9000-01-01'").select("key", "attr", "valid_from", "valid_to")


def rounds_learned(c: Context) -> DataFrame:
    """Rounds as first told by feed A, then as feed B corrects a third of those that both have: the first date is taken back."""
    base = c.fixtures.round_base().withColumn("company_id", tag("C", F.col("ck").cast("string")))
    attrs = ["company_id", "round_type", "announced_date"]

    def told(rows: DataFrame, day: str, gone: bool, said: str | None = None) -> DataFrame:
        return rows.select("round_id", "company_id", "round_type", F.col(said or day).alias("announced_date"), F.col(day).alias("day"),
                           F.lit(gone).alias("gone"))

    fixes = base.filter("in_a and in_b and ok % 3 = 0 and announced_a <> announced_b")
    batches = [
        ("2001-01-01 00:00:00", told(base.filter("in_a"), "announced_a", False)),
        ("2001-06-01 00:00:00", told(fixes, "announced_a", True).unionByName(told(fixes, "announced_b", False)).unionByName(
            told(base.filter("in_b and not in_a"), "announced_b", False)))]
    table = bitemporal.nothing_known(batches[0][1], "round_id", attrs, "day")
    for known, batch in batches:
        table = materialize(bitemporal.learn(table, batch, "round_id", attrs, "day", known, ["gone"], "gone").state)
    return table


_SCREEN_DAYS = ["2000-12-31", "2001-03-01", "2001-07-01"]


@query("H8_screening_as_known", """
    SELECT k AS known, company_id, sector_group FROM c_co JOIN (VALUES (1, DATE '2001-03-01'), (2, DATE '2001-07-01')) kk(b, k) ON true
    WHERE sector_group IN ('Consumer', 'Industrials') AND founded <= DATE '1998-04-01' AND EXISTS (
        SELECT 1 FROM ro WHERE ro.ck = c_co.ck AND round_type = 'Series A' AND CASE
            WHEN b = 1 AND NOT in_a THEN false
            WHEN in_a AND NOT (b = 2 AND in_b AND ok % 3 = 0) THEN ann_a BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'
            ELSE in_b AND ann_b BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' END)""", covers="H8 T6")
def screened_as_known(c: Context) -> DataFrame:
    """The screening of a past quarter on three days: before anything was known, before and after the correction."""
    rounds = c.kept("rounds_learned", lambda: rounds_learned(c))
    parts = [
        relations.screen(c.m.dim_company, rounds, "Series A", "1998-01-01", "1998-03-31", ["Consumer", "Industrials"], "1998-04-01", k).select(
            F.lit(k).cast("date").alias("known"), "company_id", "sector_group") for k in _SCREEN_DAYS]
    return reduce(DataFrame.unionByName, parts)


@query("J7_asof_merge", _PIT, covers="J7")
def merged(c: Context) -> DataFrame:
    return ordered.asof_join(_probes(c), "day", _versions(c), "key", "version_sk").select("event_id", "version_sk")


def _crossing(c: Context) -> DataFrame:
    """Versions that last three days past the next one's start for every fourth, and end a day early for every fifth."""
    d = F.dayofyear("valid_from")
    until = F.when(d % 4 == 0, F.date_add("valid_to", 3)).when(d % 5 == 0, F.date_sub("valid_to", 1)).otherwise(F.col("valid_to"))
    return _versions(c).filter("valid_to < date'9999-01-01'").withColumn("valid_to", until)


_PIT_CROSSING = _PIT.replace(
    "coalesce(lead(d) OVER (PARTITION BY key ORDER BY d), DATE '9999-12-31') AS until",
    "lead(d) OVER (PARTITION BY key ORDER BY d) + CAST(CASE WHEN dayofyear(d) % 4 = 0 THEN 3 WHEN dayofyear(d) % 5 = 0 THEN -1 ELSE 0 END AS INTEGER) AS until")


@query("J7_asof_crossing_versions", _PIT_CROSSING, covers="J7")
def merged_crossing(c: Context) -> DataFrame:
    return ordered.asof_join(_probes(c), "day", _crossing(c), "key", "version_sk").select("event_id", "version_sk")


@query("J7_asof_at_timestamps", """
    SELECT e.event_id, o.attr FROM events e LEFT JOIN (
        SELECT 'U-' || user_id AS key, arg_max(event_type, (ts, event_id)) AS attr, CAST(max(ts) AS DATE) AS d FROM events
        WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1) o ON o.key = 'U-' || e.user_id AND e.ts >= o.d""", covers="J7 J8")
def merged_timestamps(c: Context) -> DataFrame:
    """Facts with a time of day against versions that begin on days."""
    dim = change_state(c).select("key", "attr", "valid_from", "valid_to")
    return ordered.asof_join(c.fixtures.changes().drop("attr"), "ts", dim, "key", "attr").select("event_id", "attr")


@query("W3_running_total_by_user", """
    SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cents_so_far,
           count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS events_so_far FROM events""", covers="W3 A13")
def running_by_user(c: Context) -> DataFrame:
    sums = {"cents_so_far": F.round(F.col("value") * 100).cast("bigint"), "events_so_far": F.lit(1).cast("bigint")}
    return ordered.running_total(c.t("events"), ["user_id"], ["ts", "event_id"], sums).select("event_id", *sums)


@query("W3_running_total_of_all", """
    SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, event_id) AS BIGINT) AS cents_so_far FROM events""",
    covers="W3 A13")
def running_of_all(c: Context) -> DataFrame:
    """No key at all: still no task with all rows."""
    sums = {"cents_so_far": F.round(F.col("value") * 100).cast("bigint")}
    return ordered.running_total(c.t("events"), [], ["ts", "event_id"], sums).select("event_id", *sums)


@query("A13_running_lines", """
    SELECT l_suppkey, l_shipdate, l_orderkey, CAST(sum(cents) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey) AS BIGINT) AS cents_so_far FROM (
        SELECT l_suppkey, l_shipdate, l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL)""",
    covers="A13 W3")
def running_lines(c: Context) -> DataFrame:
    """Peers are added up first, as the order must be unique."""
    peers = c.t("lineitem").groupBy("l_suppkey", "l_shipdate", "l_orderkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    return ordered.running_total(peers, ["l_suppkey"], ["l_shipdate", "l_orderkey"], {"cents_so_far": F.col("cents")}).drop("cents")


@query("M7_running_nav_by_fund_type", """
    SELECT investor_type, effective AS effective_date, investment_id,
           CAST(sum(CAST(round(paid, 4) AS DECIMAL(28, 4))) OVER w AS DOUBLE) AS invested_so_far,
           CAST(sum(CAST(round(worth, 4) AS DECIMAL(28, 4))) OVER w AS DOUBLE) AS nav_so_far
    FROM f WINDOW w AS (PARTITION BY investor_type ORDER BY effective NULLS FIRST, investment_id)""", covers="M7 A13")
def running_nav(c: Context) -> DataFrame:
    out = ordered.running_nav(c.star, ["investor_type"], ["effective_date", "investment_id"])
    return out.withColumns({n: F.col(n).cast("double") for n in ("invested_so_far", "nav_so_far")})


BUCKETS = 32


@query("T4_bucket_merge", _MERGED, covers="T4 J9")
def bucket_merge(c: Context) -> DataFrame:
    """The merge in place, twice: the second time changes nothing."""
    path = f"{c.dir}/t4_buckets"
    write_buckets(change_state(c), path, "key", BUCKETS)
    for _ in range(2):
        buckets.merge_buckets(path, change_batch(c), "key", ["attr"], "changed", BUCKETS)
    return read_buckets(c.spark, path)


_FEW = _MERGED.replace("TIMESTAMP '2024-01-16' GROUP BY 1) n", "TIMESTAMP '2024-01-16' AND user_id < 4 GROUP BY 1) n")


@query("T4_bucket_merge_of_few", f"SELECT *, true AS untouched FROM ({_FEW})", covers="T4")
def bucket_merge_of_few(c: Context) -> DataFrame:
    """Four keys change: files of other buckets are the same before and after."""
    path = f"{c.dir}/t4_few"
    write_buckets(change_state(c), path, "key", BUCKETS)
    files = lambda: {r[0] for r in c.spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}
    before = files()
    few = change_batch(c).filter(F.substring_index("key", "-", -1).cast("int") < 4)
    done = buckets.merge_buckets(path, few, "key", ["attr"], "changed", BUCKETS)
    gone = before - files()
    same = 0 < len(done.rewritten) <= 4 and all(any(f"_bucket={b}/" in x for b in done.rewritten) for x in gone)
    return read_buckets(c.spark, path).withColumn("untouched", F.lit(same))


SLICES = {"total": (), "vintage": ("vintage_year",), "sector": ("sector_group",), "vintage by sector": ("vintage_year", "sector_group"),
          "country": ("country",)}
_SLICE = """
    SELECT '{name}' AS slice, {cols}, round(ti, 2) AS total_invested, round(nav, 4) AS nav, round(cd / 365.25 / ti, 6) AS years_held, round(nav / ti, 6) AS moic,
           round(pow(nav / ti, 1 / (cd / 365.25 / ti)) - 1, 6) AS irr, round(ti / (SELECT sum(paid) FROM f), 6) AS concentration, n AS matched_rows
    FROM (SELECT {by}sum(paid) AS ti, sum(worth) AS nav, sum(cost_days) AS cd, count(*) AS n FROM f {group})"""


def _slices_sql() -> str:
    columns = ["vintage_year", "sector_group", "country"]
    kinds = {"vintage_year": "INTEGER"}
    parts = []
    for name, by in SLICES.items():
        cols = ", ".join(c if c in by else f"CAST(NULL AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in columns)
        parts.append(_SLICE.format(name=name, cols=cols, by="".join(f"{c}, " for c in by), group=f"GROUP BY {', '.join(by)}" if by else ""))
    return " UNION ALL ".join(parts)


@query("M15_all_slices", _slices_sql(), covers="M8 M9 M11 M15 M16 M17")
def all_slices(c: Context) -> DataFrame:
    return rounded(measures.measure_slices(c.star, SLICES, as_of=AS_OF))


@query("S10_clustered_on_two", """
    SELECT 'l_shipdate' AS filtered, count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity, true AS under_a_third FROM lineitem
    WHERE l_shipdate BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'
    UNION ALL SELECT 'l_partkey', count(*), CAST(sum(l_quantity) AS DOUBLE), true FROM lineitem WHERE l_partkey BETWEEN 11 AND 14""", covers="S10")
def clustered(c: Context) -> DataFrame:
    """Rows under a filter on either column, and whether it leaves less than a third of the files to be read."""
    columns = ["l_shipdate", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity"]
    df = cluster(c.t("lineitem").select(*columns), f"{c.dir}/s10_clustered_on_two", ["l_shipdate", "l_partkey"], 36)
    kind = df.schema["l_shipdate"].dataType
    parts = []
    for column, low, high in (("l_shipdate", F.lit("1995-03-01").cast(kind), F.lit("1995-03-31").cast(kind)), ("l_partkey", F.lit(11), F.lit(14))):
        seen = files_touched(df, column, low, high).select((F.col("n_read") * 3 < F.col("n_files")).alias("ok")).scalar()
        parts.append(df.filter(F.col(column).between(low, high)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("double").alias("quantity")).select(
            F.lit(column).alias("filtered"), "n_rows", "quantity", seen.alias("under_a_third")))
    return parts[0].unionByName(parts[1])
