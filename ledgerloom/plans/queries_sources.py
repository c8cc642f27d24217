"""Queries over readers, writers, projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import blank, date_key, numbers_in, surrogate_key
from ledgerloom.operators.measures import members
from ledgerloom.operators.validate import empty_like
from ledgerloom.plans.registry import Context, query
from ledgerloom.sources import landing
from ledgerloom.sources.contracts import FEEDS, SOURCES
from ledgerloom.sources.fixtures import BATCH, INGESTED, SEGMENT_GROUPS


@query("S1_feed_scan", """
    SELECT o_orderstatus, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
    FROM orders GROUP BY 1""", covers="S1 A2 A4")
def feed_scan(c: Context) -> DataFrame:
    return landing.read_feed(c.spark, c.sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("o_orderdate").cast("date")).alias("first_day"),
        F.max(F.col("o_orderdate").cast("date")).alias("last_day"))


@query("S1_csv_fallback", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", covers="S1")
def csv_fallback(c: Context) -> DataFrame:
    df = c.t("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    df.write.mode("overwrite").option("header", True).csv(f"{c.dir}/csv/supplier.csv")
    return landing.read_feed(c.spark, f"{c.dir}/csv", "supplier", df.schema)


@query("S2_reference_scan", """
    SELECT r_name, count(n_nationkey) AS n_nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def reference_scan(c: Context) -> DataFrame:
    region = landing.read_feed(c.spark, c.sf_dir, "region")
    nation = landing.read_feed(c.spark, c.sf_dir, "nation")
    return region.join(nation, region["r_regionkey"] == nation["n_regionkey"], "left").groupBy("r_name").agg(
        F.count("n_nationkey").alias("n_nations"))


def saved(c: Context, df: DataFrame, name: str) -> str:
    """A catalog table in the shared folder, named after the context's folder; its name."""
    table = f"{name}_{c.dir.rsplit('-', 1)[1]}"
    landing.save_table(df, table, path=f"{c.dir}/catalog/{table}")
    return table


@query("S3_named_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def named_table(c: Context) -> DataFrame:
    name = saved(c, c.t("customer"), "customer")
    return landing.read_named(c.spark, name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("S4_qualified_table", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def qualified_table(c: Context) -> DataFrame:
    name = saved(c, c.t("part"), "part")
    return landing.read_named(c.spark, c.spark.catalog.currentCatalog(), c.spark.catalog.currentDatabase(), name).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("S5_table_overwrite", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def table_overwrite(c: Context) -> DataFrame:
    """The second write has more columns, one of another type, and takes the place of the first with its schema."""
    df = c.t("customer")
    saved(c, df.select(F.col("c_custkey").cast("string").alias("c_custkey")), "overwritten")
    return landing.read_named(c.spark, saved(c, df.select("c_custkey", "c_name", "c_acctbal"), "overwritten"))


@query("S6_conditional_sink", """
    SELECT 'feed_a' AS source, 'investments' AS entity, count(*) FILTER (WHERE in_a AND copies > 1) > 0 AS written FROM efeed
    UNION ALL SELECT 'feed_b', 'investments', count(*) FILTER (WHERE in_b AND copies > 1) > 0 FROM efeed
    UNION ALL SELECT s, e, false FROM (SELECT unnest(['feed_a', 'feed_b']) AS s), (SELECT unnest(['companies', 'funding_rounds', 'investors']) AS e)
    UNION ALL SELECT 'internal', unnest(['people', 'deals', 'documents']), false""", covers="S6 S7")
def conditional_sink(c: Context) -> DataFrame:
    c.m.gates.build()
    rows = [(s, e, landing.save_if_any(c.m.gates[s, e].quarantine, f"{c.dir}/quarantine_{s}_{e}", c.m.gates[s, e].suspects))
            for s, e in FEEDS]
    return c.spark.createDataFrame(rows, "source string, entity string, written boolean")


@query("S7_rows_to_frame", """
    SELECT sector_group, count(*) AS n_customers FROM customer JOIN grp ON segment = c_mktsegment GROUP BY 1""")
def rows_to_frame(c: Context) -> DataFrame:
    lookup = c.spark.createDataFrame(list(SEGMENT_GROUPS.items()), "segment string, sector_group string")
    df = c.t("customer")
    return df.join(lookup, df["c_mktsegment"] == lookup["segment"]).groupBy("sector_group").agg(
        F.count(F.lit(1)).alias("n_customers"))


@query("S8_nested_to_json", "SELECT company_id, tags FROM co")
def nested_json(c: Context) -> DataFrame:
    return c.keep("s8_tags", landing.nested_to_json(c.fixtures.company_base().select("company_id", "tags")))


@query("S9_lineage_stamp", """
    SELECT CAST(o_orderkey AS VARCHAR) AS k, sha256('feed_x|orders.parquet|' || o_orderkey) AS _record_id, 'feed_x' AS _source_system,
           'orders.parquet' AS _source_file, '2002-01-01T00:00:00+00:00' AS _ingestion_ts, 'batch-0001' AS _batch_id,
           '1.0' AS _data_version, true AS _is_synthetic FROM orders""")
def lineage_stamp(c: Context) -> DataFrame:
    df = c.t("orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("_metadata.file_name").alias("_file"))
    return landing.stamp_lineage(df, "feed_x", F.col("_file"), INGESTED, BATCH, key=["k"]).drop("_file")


@query("S10_compact", """
    SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem GROUP BY ALL""", covers="S10 A5")
def compacted(c: Context) -> DataFrame:
    cols = ["l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"]
    df = c.kept("s10", lambda: landing.compact(
        c.t("lineitem").select(*cols), f"{c.dir}/s10_clustered", ["l_shipdate", "l_orderkey"]))
    return df.groupBy("l_returnflag", F.year("l_shipdate").alias("ship_year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# --- projection, filter, predicate ---


@query("P1_project_rename", "SELECT round_id AS deal_ref, amt_a AS raised, currency AS ccy FROM ro2 WHERE in_a", covers="P1 P3")
def project_rename(c: Context) -> DataFrame:
    df = c.m.identified("feed_a", "funding_rounds").drop("_record_id", "_batch_id")
    return df.select(F.col("canonical_id").alias("deal_ref"), "amount_raised", "currency").withColumnRenamed(
        "amount_raised", "raised").withColumnRenamed("currency", "ccy")


@query("P2_computed_columns", """
    SELECT round_id, is_temporal, is_value, is_existence, announced AS announced_date, amount AS amount_raised FROM c_ro""",
    covers="P2 P8")
def computed(c: Context) -> DataFrame:
    return c.m.reconciled["funding_rounds"].select(
        F.col("canonical_id").alias("round_id"), "is_temporal", "is_value", "is_existence", "announced_date", "amount_raised")


@query("P4_filters", """
    SELECT 'realised' AS kind, count(*) FILTER (WHERE realised) AS n FROM f UNION ALL SELECT 'not realised', count(*) FILTER (WHERE NOT realised) FROM f
    UNION ALL SELECT 'lead and large', count(*) FILTER (WHERE is_lead AND paid > 50000) FROM f""", covers="P4 U3")
def filters(c: Context) -> DataFrame:
    fact = c.m.fact
    count = F.count(F.lit(1)).alias("n")
    one = fact.filter("is_realized").agg(count).select(F.lit("realised").alias("kind"), "n")
    two = fact.filter(~F.col("is_realized")).agg(count).select(F.lit("not realised").alias("kind"), "n")
    three = fact.where(F.col("is_lead") & (F.col("participation_amount") > 50000)).agg(count).select(
        F.lit("lead and large").alias("kind"), "n")
    return one.union(two).union(three)


@query("P5_null_predicates", """
    SELECT count(*) FILTER (WHERE paid IS NULL) AS undisclosed, count(*) FILTER (WHERE paid IS NOT NULL) AS disclosed,
           count(*) FILTER (WHERE realised AND multiple IS NULL) AS realised_unknown, count(*) AS n FROM f""", covers="P5 A1")
def null_predicates(c: Context) -> DataFrame:
    amount = F.col("participation_amount")
    return c.m.fact.agg(
        F.count_if(amount.isNull()).alias("undisclosed"), F.count_if(amount.isNotNull()).alias("disclosed"),
        F.count_if(F.col("is_realized") & F.col("realised_return_multiple").isNull()).alias("realised_unknown"),
        F.count(F.lit(1)).alias("n"))


@query("P6_blank_or_null", """
    SELECT lang, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blanks, count(*) AS n FROM documents GROUP BY 1""")
def blanks(c: Context) -> DataFrame:
    return c.t("documents").groupBy("lang").agg(F.count_if(blank("text")).alias("blanks"), F.count(F.lit(1)).alias("n"))


@query("P7_domain_predicate", """
    SELECT count(*) FILTER (WHERE round_type NOT IN ('Seed', 'Series A', 'Series B')) AS outside, count(*) FILTER (WHERE round_type IS NULL) AS nulls,
           count(*) FILTER (WHERE exit_type NOT IN ('ipo')) AS other_exits, count(*) FILTER (WHERE exit_type IS NULL) AS no_exit
    FROM c_ed e JOIN ro r ON r.ok = e.ok""")
def domain(c: Context) -> DataFrame:
    kind, ended = F.col("round_type"), F.col("exit_type")
    return c.m.fact.agg(
        F.count_if(~kind.isin("Seed", "Series A", "Series B")).alias("outside"), F.count_if(kind.isNull()).alias("nulls"),
        F.count_if(~ended.isin("ipo")).alias("other_exits"), F.count_if(ended.isNull()).alias("no_exit"))


@query("P10_empty_same_schema", "SELECT round_id, ok AS n FROM ro WHERE false")
def empty(c: Context) -> DataFrame:
    return empty_like(c.fixtures.round_base().select("round_id", F.col("ok").alias("n")))


@query("P11_presence_flags", "SELECT company_id, in_a, in_b FROM co")
def presence(c: Context) -> DataFrame:
    df = c.m.reconciled["companies"]
    return df.select(F.col("canonical_id").alias("company_id"),
                     *[F.col(s).isNotNull().alias(n) for s, n in zip(SOURCES, ("in_a", "in_b"))])


# --- aggregates, order, limits, set operations ---


@query("A8_nullable_group_size", """
    SELECT entity_type, conflict_type, subtype AS existence_subtype, count(*) AS n FROM log GROUP BY ALL""", covers="A8 R12")
def nullable_groups(c: Context) -> DataFrame:
    return c.m.ledger.groupBy("entity_type", "conflict_type", "existence_subtype").agg(F.count(F.lit(1)).alias("n"))


@query("A6_having", """
    SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def having(c: Context) -> DataFrame:
    return c.t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("A5_sum_and_counts", """
    SELECT round(sum(paid), 2) AS total, count(paid) AS disclosed, count(*) AS n FROM f""", covers="A5 A1")
def sum_counts(c: Context) -> DataFrame:
    return c.m.fact.agg(F.round(F.sum("participation_amount"), 2).alias("total"),
                        F.count("participation_amount").alias("disclosed"), F.count(F.lit(1)).alias("n"))


@query("A4_date_bounds", "SELECT min(date) AS first_day, max(date) AS last_day, count(*) AS n FROM cal", covers="A4 G1")
def bounds(c: Context) -> DataFrame:
    return c.m.dim_date.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("L2_first_rows", "SELECT round_id, announced, amount FROM c_ro ORDER BY amount DESC, round_id LIMIT 20", covers="L1 L2")
def first_rows(c: Context) -> DataFrame:
    return c.m.conformed["funding_rounds"].select("round_id", F.col("announced_date").alias("announced"),
                                                  F.col("amount_raised").alias("amount")).orderBy(
        F.col("amount").desc(), "round_id").limit(20)


@query("U1_union_by_name", """
    SELECT kind, count(*) AS n FROM (SELECT 'company' AS kind FROM c_co UNION ALL SELECT 'round' FROM c_ro UNION ALL SELECT 'investor' FROM iv)
    GROUP BY 1""")
def union_by_name(c: Context) -> DataFrame:
    t = c.m.conformed
    parts = [t["companies"].select(F.lit("company").alias("kind"), F.col("company_id").alias("id")),
             t["funding_rounds"].select(F.col("round_id").alias("id"), F.lit("round").alias("kind")),
             t["investors"].select(F.lit("investor").alias("kind"), F.col("investor_id").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("U2_union_missing_columns", """
    SELECT count(*) AS n, count(pre_money) AS with_pre_money FROM (
        SELECT pre_money FROM ro2 WHERE in_a UNION ALL SELECT NULL FROM ro2 WHERE in_b)""")
def union_missing(c: Context) -> DataFrame:
    a = c.m.valid("feed_a", "funding_rounds")
    b = c.m.valid("feed_b", "funding_rounds").drop("pre_money_valuation")
    return a.unionByName(b, allowMissingColumns=True).agg(
        F.count(F.lit(1)).alias("n"), F.count("pre_money_valuation").alias("with_pre_money"))


@query("U4_intersect", "SELECT round_id FROM ro WHERE in_a AND in_b")
def intersect(c: Context) -> DataFrame:
    ids = [c.m.identified(s, "funding_rounds").select(F.col("canonical_id").alias("round_id")) for s in SOURCES]
    return ids[0].intersect(ids[1])


@query("U6_symmetric_difference", """
    SELECT company_id, CASE WHEN in_a THEN 'feed_a' ELSE 'feed_b' END AS only_in FROM co WHERE in_a <> in_b""")
def symmetric(c: Context) -> DataFrame:
    df = c.m.reconciled["companies"].filter("is_existence")
    return df.select(F.col("canonical_id").alias("company_id"),
                     F.when(F.col("feed_a").isNotNull(), "feed_a").otherwise("feed_b").alias("only_in"))


@query("U7_subset_check", """
    SELECT 'feed_a' AS source, count(*) FILTER (WHERE NOT coalesce(c.in_a, false)) AS outside FROM ro r LEFT JOIN co c ON c.ck = r.ck WHERE r.in_a
    UNION ALL SELECT 'feed_b', count(*) FILTER (WHERE NOT coalesce(c.in_b, false)) FROM ro r LEFT JOIN co c ON c.ck = r.ck WHERE r.in_b""",
    covers="U7 J6")
def subset(c: Context) -> DataFrame:
    parts = []
    for s in SOURCES:
        companies = c.m.valid(s, "companies").select("vendor_company_id")
        stray = c.m.valid(s, "funding_rounds").join(companies, "vendor_company_id", "left_anti")
        parts.append(stray.agg(F.count(F.lit(1)).alias("outside")).select(F.lit(s).alias("source"), "outside"))
    return parts[0].unionByName(parts[1])


@query("F_hash_keys", "SELECT sha256(o_orderkey || '||' || o_custkey) AS sk, o_orderkey FROM orders", covers="G4")
def hash_keys(c: Context) -> DataFrame:
    return c.t("orders").select(surrogate_key("o_orderkey", "o_custkey").alias("sk"), "o_orderkey")


@query("F_date_functions", """
    SELECT o_orderkey, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, last_day(o_orderdate) AS month_end, strftime(o_orderdate, '%B') AS month_name,
           CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week, CAST(datediff('day', DATE '1995-01-01', o_orderdate) AS INTEGER) AS days,
           CAST(CAST(o_orderdate AS DATE) + 90 AS DATE) AS due, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_sk,
           CAST(len(generate_series(CAST(o_orderdate AS DATE), last_day(o_orderdate), INTERVAL 1 DAY)) AS INTEGER) AS days_left FROM orders""", covers="F")
def date_functions(c: Context) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return c.t("orders").select(
        "o_orderkey", F.quarter(day).alias("quarter"), F.last_day(day).alias("month_end"), F.date_format(day, "MMMM").alias("month_name"),
        F.dayofweek(day).alias("day_of_week"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_add(day, 90).alias("due"), date_key(day).alias("date_sk"), F.size(F.sequence(day, F.last_day(day))).alias("days_left"))


@query("F_text_and_math_functions", r"""
    SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price, regexp_extract(o_orderpriority, '(\d)-(\w+)', 2) AS word,
           concat_ws('/', o_orderstatus, lower(o_orderpriority)) AS label, contains(lower(o_orderpriority), 'low') AS is_low,
           greatest(o_totalprice, 100000.0::DOUBLE) AS top, least(o_totalprice, 100000.0::DOUBLE) AS bottom,
           CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_orderkey AS DOUBLE) / (o_custkey % 7) END AS share,
           TRY_CAST(regexp_extract(o_orderpriority, '-?\d[\d,]*\.?\d*') AS DOUBLE) AS number FROM orders""", covers="F")
def text_functions(c: Context) -> DataFrame:
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    return c.t("orders").select(
        "o_orderkey", F.format_number(price, 2).alias("price"), F.regexp_extract(priority, r"(\d)-(\w+)", 2).alias("word"),
        F.concat_ws("/", "o_orderstatus", F.lower(priority)).alias("label"), F.contains(F.lower(priority), F.lit("low")).alias("is_low"),
        F.greatest(price, F.lit(100000.0)).alias("top"), F.least(price, F.lit(100000.0)).alias("bottom"),
        F.try_divide(F.col("o_orderkey").cast("double"), F.col("o_custkey") % 7).alias("share"), F.get(numbers_in(priority), F.lit(0)).alias("number"))


@query("M12_member_list", "SELECT DISTINCT sector_group FROM c_co WHERE sector_group IS NOT NULL", covers="M12 A7 L1")
def member_list(c: Context) -> DataFrame:
    return members(c.star)
