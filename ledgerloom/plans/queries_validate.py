"""Queries of stage A."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import validate
from ledgerloom.operators.identity import attach_canonical, coverage
from ledgerloom.plans.registry import Context, query
from ledgerloom.sources.contracts import CONTRACTS, ENTITY_KEYS, FEEDS, SHARED_ENTITIES, SOURCES


@query("Q1_structural_gate", """
    SELECT 'A-V-' || ok || '-' || ln AS vendor_investment_id, copies = 1 AS is_valid,
           CASE WHEN copies > 1 THEN 'dup_pk:vendor_investment_id;' END AS reason FROM efeed WHERE in_a""", covers="Q1 W1 P9")
def gate(c: Context) -> DataFrame:
    return c.m.gates["feed_a", "investments"].tagged.select(
        "vendor_investment_id", F.col("_valid").alias("is_valid"), F.col("_quarantine_reason").alias("reason"))


@query("Q1_missing_column", """
    SELECT 'A-R-' || ok AS vendor_round_id, 'missing_columns: currency, round_type' AS reason FROM ro WHERE in_a""", covers="Q1")
def missing_column(c: Context) -> DataFrame:
    broken = c.m.landing["feed_a", "funding_rounds"].drop("round_type", "currency")
    return validate.validate_feed(broken, CONTRACTS["funding_rounds"]).quarantine.select(
        "vendor_round_id", F.col("_quarantine_reason").alias("reason"))


_FEED_ROWS = """
    SELECT 'feed_a' AS source, 'companies' AS entity, count(*) FILTER (WHERE in_a) AS n FROM co
    UNION ALL SELECT 'feed_b', 'companies', count(*) FILTER (WHERE in_b) FROM co
    UNION ALL SELECT 'feed_a', 'funding_rounds', count(*) FILTER (WHERE in_a) FROM ro
    UNION ALL SELECT 'feed_b', 'funding_rounds', count(*) FILTER (WHERE in_b) FROM ro
    UNION ALL SELECT unnest(['feed_a', 'feed_b']), 'investors', count(*) FROM iv
    UNION ALL SELECT 'feed_a', 'investments', count(*) FILTER (WHERE in_a) FROM efeed
    UNION ALL SELECT 'feed_b', 'investments', count(*) FILTER (WHERE in_b) FROM efeed
    UNION ALL SELECT 'internal', 'people', count(DISTINCT person_id) FROM aff
    UNION ALL SELECT 'internal', 'deals', count(DISTINCT deal_id) FROM stages
    UNION ALL SELECT 'internal', 'documents', count(*) FROM documents"""


@query("Q2_all_contracts", f"""
    SELECT source, entity, n AS n_rows, CAST(0 AS BIGINT) AS flagged, CASE WHEN entity IN ('companies', 'people') THEN 0 ELSE n END AS spoiled_flagged
    FROM ({_FEED_ROWS})""", covers="Q2")
def all_domains(c: Context) -> DataFrame:
    """Every feed against its contract as delivered, and with an unknown word in its first enumerated column."""
    parts = []
    for source, entity in FEEDS:
        contract, df = CONTRACTS[entity], c.m.landing[source, entity]
        enum = next(iter(contract.enums), None)
        flagged = F.count_if(F.col("_quarantine_reason").isNotNull())
        plain = validate.check_domains(df, contract).tagged.agg(F.count(F.lit(1)).alias("n_rows"), flagged.alias("flagged"))
        spoiled = validate.check_domains(df.withColumn(enum, F.lit("no such word")) if enum else df, contract).tagged.agg(flagged.alias("f"))
        parts.append(plain.select(F.lit(source).alias("source"), F.lit(entity).alias("entity"), "n_rows", "flagged",
                                  spoiled.scalar().alias("spoiled_flagged")))
    return reduce(DataFrame.unionByName, parts)


@query("Q3_map_completeness", """
    SELECT 'companies' AS entity, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS unmapped
    UNION ALL SELECT 'funding_rounds', 0, 0 UNION ALL SELECT 'investors', 0, 0
    UNION ALL SELECT 'investments', 0, (count(*) FILTER (WHERE in_a AND copies > 1)) + (count(*) FILTER (WHERE in_b AND copies > 1)) FROM efeed""", covers="Q3 R1 U7")
def map_completeness(c: Context) -> DataFrame:
    """Map rows whose canonical id no feed row has, and feed rows whose vendor id the map lacks."""
    parts = []
    for entity in SHARED_ENTITIES:
        kind, key = ENTITY_KEYS[entity]
        vendor = CONTRACTS[entity].pk
        own = c.m.maps[kind]
        ids = reduce(DataFrame.unionByName, [
            c.m.landing[s, entity].select(F.lit(s).alias("source_system"), F.col(vendor).alias("vendor_id")) for s in SOURCES])
        on = ["source_system", "vendor_id"]
        outside = own.join(ids, on, "left_anti").agg(F.count(F.lit(1)).alias("outside"))
        parts.append(outside.select(F.lit(entity).alias("entity"), "outside",
                                    ids.join(own, on, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar().alias("unmapped")))
    return reduce(DataFrame.unionByName, parts)


@query("Q2_domain_checks", """
    SELECT 'A-R-' || ok AS vendor_round_id, nullif(concat(
        CASE WHEN ok % 31 = 0 THEN 'domain:round_type;' END, CASE WHEN ok % 17 = 0 THEN 'domain:currency;' END,
        CASE WHEN ok % 13 = 0 THEN 'minimum:amount_raised;' END, CASE WHEN ok % 19 = 0 THEN 'type:announced_date;' END), '') AS reason
    FROM ro WHERE in_a""")
def domains(c: Context) -> DataFrame:
    k = F.regexp_extract("vendor_round_id", r"(\d+)$", 1).cast("bigint")
    spoiled = c.m.landing["feed_a", "funding_rounds"].withColumns(
        {
            "round_type": F.when(k % 31 == 0, "Series Z").otherwise(F.col("round_type")),
            "currency": F.when(k % 17 == 0, "XXX").otherwise(F.col("currency")),
            "amount_raised": F.when(k % 13 == 0, -F.col("amount_raised")).otherwise(F.col("amount_raised")),
            "announced_date": F.when(k % 19 == 0, "1999-13-45").otherwise(F.col("announced_date")),
        }
    )
    return validate.check_domains(spoiled, CONTRACTS["funding_rounds"]).tagged.select(
        "vendor_round_id", F.col("_quarantine_reason").alias("reason"))


@query("Q3_referential_check", """
    SELECT 'A-R-' || ok AS vendor_round_id, CASE WHEN ck % 10 = 4 THEN 'orphan:vendor_company_id;' END AS reason FROM ro WHERE in_a""",
    covers="Q3 J6")
def referential(c: Context) -> DataFrame:
    companies = c.m.landing["feed_a", "companies"].filter("not vendor_company_id like '%4'")
    return validate.check_references(
        c.m.landing["feed_a", "funding_rounds"], "vendor_company_id", companies, "vendor_company_id"
    ).tagged.select("vendor_round_id", F.col("_quarantine_reason").alias("reason"))


@query("Q4_freshness", """
    SELECT s AS source, e AS entity, '2002-01-01' AS newest, CAST(9 AS INTEGER) AS age_days, 'STALE' AS status FROM (
        SELECT unnest(['feed_a', 'feed_b']) AS s), (SELECT unnest(['companies', 'funding_rounds', 'investors', 'investments']) AS e)
    UNION ALL SELECT 'internal', unnest(['people', 'deals', 'documents']), '2002-01-01', 9, 'STALE'""")
def fresh(c: Context) -> DataFrame:
    return validate.freshness({f: c.m.landing[f] for f in FEEDS}, "2002-01-10", 7)


@query("Q5_validation_summary", """
    SELECT source, entity, rows_in, valid, rows_in - valid AS quarantined,
           CASE WHEN rows_in = valid THEN 'OK' ELSE 'QUARANTINED ROWS' END AS status FROM (
        SELECT 'feed_a' AS source, 'companies' AS entity, count(*) FILTER (WHERE in_a) AS rows_in, count(*) FILTER (WHERE in_a) AS valid FROM co
        UNION ALL SELECT 'feed_b', 'companies', count(*) FILTER (WHERE in_b), count(*) FILTER (WHERE in_b) FROM co
        UNION ALL SELECT 'feed_a', 'funding_rounds', count(*) FILTER (WHERE in_a), count(*) FILTER (WHERE in_a) FROM ro
        UNION ALL SELECT 'feed_b', 'funding_rounds', count(*) FILTER (WHERE in_b), count(*) FILTER (WHERE in_b) FROM ro
        UNION ALL SELECT 'feed_a', 'investors', count(*), count(*) FROM iv
        UNION ALL SELECT 'feed_b', 'investors', count(*), count(*) FROM iv
        UNION ALL SELECT 'feed_a', 'investments', count(*) FILTER (WHERE in_a), count(*) FILTER (WHERE in_a AND copies = 1) FROM efeed
        UNION ALL SELECT 'feed_b', 'investments', count(*) FILTER (WHERE in_b), count(*) FILTER (WHERE in_b AND copies = 1) FROM efeed
        UNION ALL SELECT 'internal', 'people', count(DISTINCT person_id), count(DISTINCT person_id) FROM aff
        UNION ALL SELECT 'internal', 'deals', count(DISTINCT deal_id), count(DISTINCT deal_id) FROM stages
        UNION ALL SELECT 'internal', 'documents', count(*), count(*) FROM documents)""", covers="Q5 A1")
def summary(c: Context) -> DataFrame:
    return c.m.validation_summary()


@query("Q6_corruption_demo", """
    SELECT CASE WHEN ck % 11 <> 0 THEN 'A-C-' || ck END AS vendor_company_id, nullif(concat(
        CASE WHEN ck % 11 = 0 THEN 'null:vendor_company_id;' END, CASE WHEN ck % 7 = 0 THEN 'null:legal_name;' END,
        CASE WHEN ck % 11 = 0 THEN 'null_pk:vendor_company_id;' END,
        CASE WHEN ck % 11 = 0 AND count(*) FILTER (WHERE ck % 11 = 0) OVER () > 1 THEN 'dup_pk:vendor_company_id;' END), '') AS reason
    FROM co WHERE in_a""", covers="Q6 P6 P9")
def corruption(c: Context) -> DataFrame:
    k = F.regexp_extract("vendor_company_id", r"(\d+)$", 1).cast("bigint")
    bad = c.m.landing["feed_a", "companies"].withColumn("_k", k).withColumns(
        {
            "vendor_company_id": F.when(F.col("_k") % 11 != 0, F.col("vendor_company_id")),
            "legal_name": F.when(F.col("_k") % 7 == 0, "  ").otherwise(F.col("legal_name")),
        }
    )
    return validate.validate_feed(bad, CONTRACTS["companies"]).tagged.select(
        "vendor_company_id", F.col("_quarantine_reason").alias("reason"))


@query("Q7_lineage_check", f"""
    SELECT source, entity, n AS n_rows, CAST(0 AS BIGINT) AS wrong_source, CAST(0 AS BIGINT) AS missing_columns FROM ({_FEED_ROWS})""")
def lineage(c: Context) -> DataFrame:
    parts = [validate.check_lineage(c.m.landing[s, e], s).withColumn("entity", F.lit(e)) for s, e in FEEDS]
    return reduce(DataFrame.unionByName, parts)


@query("R1_attach_canonical", """
    SELECT 'A-V-' || ok || '-' || ln AS vendor_investment_id, CASE WHEN copies = 1 THEN investment_id END AS canonical_id,
           copies > 1 AS is_unmapped FROM efeed WHERE in_a""", covers="R1 J1")
def attach(c: Context) -> DataFrame:
    # The raw feed: repeated edges are not in the map and stay unmapped.
    df = c.m.landing["feed_a", "investments"].select("vendor_investment_id")
    return attach_canonical(df, c.m.maps["investment"], "investment", "feed_a", "vendor_investment_id").withColumn(
        "is_unmapped", F.col("canonical_id").isNull())


@query("R2_source_coverage", """
    SELECT company_id AS canonical_id, CAST(in_a AS BIGINT) + CAST(in_b AS BIGINT) AS n_sources FROM co""", covers="R2 A3")
def source_coverage(c: Context) -> DataFrame:
    return coverage(c.m.maps["company"])


