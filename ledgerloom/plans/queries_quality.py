"""Queries of stages D and E."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import quality, star, temporal
from ledgerloom.plans.medallion import CONFORMED_KEYS, REFERENCES, TEMPORAL_CHECKED
from ledgerloom.plans.registry import Context, query
from ledgerloom.sources.contracts import ENTITY_KEYS


@query("C1_check_report", """
    SELECT count(*) AS checks, count(*) AS passed, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS warned, CAST(41 AS BIGINT) AS hard
    FROM (SELECT unnest(range(45)))""", covers="C1 C9")
def report(c: Context) -> DataFrame:
    df = c.kept("dq_assertions_report", c.m.assertions)
    quality.enforce(df)
    return df.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if("is_hard").alias("hard"))


@query("C2_referential_integrity", """
    SELECT 'RI funding_rounds.company_id -> companies' AS check_name, 'PASS' AS status, '0 unresolved of ' || count(DISTINCT ck) || ' distinct' AS detail FROM c_ro
    UNION ALL SELECT 'RI investments.investor_id -> investors', 'PASS', '0 unresolved of ' || count(DISTINCT sk) || ' distinct' FROM c_ed
    UNION ALL SELECT 'RI investments.round_id -> funding_rounds', 'PASS', '0 unresolved of ' || count(DISTINCT ok) || ' distinct' FROM c_ed
    UNION ALL SELECT 'RI investments.company_id -> companies', 'PASS', '0 unresolved of ' || count(DISTINCT ck) || ' distinct' FROM c_ed
    UNION ALL SELECT 'RI deals.company_id -> companies', 'PASS', '0 unresolved of ' || count(DISTINCT user_id) || ' distinct' FROM events
    UNION ALL SELECT 'RI documents.author_person_id -> people', 'PASS', '0 unresolved of ' || count(*) FILTER (WHERE doc_id % 4 <> 0) || ' distinct' FROM documents""",
    covers="C2 J6")
def references(c: Context) -> DataFrame:
    t = c.m.conformed
    return quality.report(
        [quality.check_reference(n, t[ch], ck, t[p], pk) for n, ch, ck, p, pk in REFERENCES]).drop("is_hard")


@query("C2_broken_references", """
    SELECT 'broken' AS check_name, 'FAIL' AS status, (SELECT count(DISTINCT ck) FROM c_ro WHERE ck % 10 = 4) || ' unresolved of ' ||
           (SELECT count(DISTINCT ck) FROM c_ro) || ' distinct' AS detail""", covers="C2")
def broken_references(c: Context) -> DataFrame:
    companies = c.m.conformed["companies"].filter("not company_id like '%4'")
    return quality.check_reference(
        "broken", c.m.conformed["funding_rounds"], "company_id", companies, "company_id").drop("is_hard")


def entity_report(c: Context, entity: str, df: DataFrame | None = None) -> DataFrame:
    key = CONFORMED_KEYS[entity]
    if entity in ENTITY_KEYS:
        kind = ENTITY_KEYS[entity][0]
        expected = quality.expected_from_map(c.m.maps[kind], kind)
    else:
        expected = quality.expected_from_feed(c.m.valid("internal", entity))
    return quality.check_entity(
        entity, c.m.conformed[entity] if df is None else df, key, expected, entity in TEMPORAL_CHECKED)


@query("C3_to_C8_entity_checks", """
    SELECT check_name, 'PASS' AS status, detail FROM (
        SELECT entity, n, unnest([
            {'check_name': 'envelope one-current-per-key [' || entity || ']', 'detail': '0 keys >1 current; ' || n || '/' || n || ' keys have a current row'},
            {'check_name': 'envelope no-nulls [' || entity || ']', 'detail': '0 null envelope rows'},
            {'check_name': 'envelope valid_from<=valid_to [' || entity || ']', 'detail': '0 inverted ranges'},
            {'check_name': 'rowcount reconcile [' || entity || ']', 'detail': n || ' distinct keys vs ' || n || ' expected'},
            {'check_name': 'status domain [' || entity || ']', 'detail': '0 rows outside allowed set, 0 null'}], recursive := true)
        FROM (SELECT 'companies' AS entity, count(*) AS n FROM c_co UNION ALL SELECT 'funding_rounds', count(*) FROM c_ro
              UNION ALL SELECT 'investors', count(*) FROM iv UNION ALL SELECT 'investments', count(*) FROM c_ed
              UNION ALL SELECT 'people', count(DISTINCT person_id) FROM aff UNION ALL SELECT 'deals', count(DISTINCT deal_id) FROM stages
              UNION ALL SELECT 'documents', count(*) FROM documents))
    UNION ALL SELECT 'temporal effective<=ingestion [' || unnest(['companies', 'funding_rounds', 'investments', 'documents']) || ']', 'PASS',
                     '0 rows effective > ingestion (disclosure-lag expected)'""", covers="C3 C4 C5 C6 C7 C8")
def entity_checks(c: Context) -> DataFrame:
    return quality.report([entity_report(c, e) for e in CONFORMED_KEYS]).drop("is_hard")


@query("C3_to_C8_broken_envelopes", """
    SELECT 'envelope one-current-per-key [funding_rounds]' AS check_name, 'FAIL' AS status,
           count(*) FILTER (WHERE ok % 5 = 0) || ' keys >1 current; ' || count(*) FILTER (WHERE ok % 7 <> 0 OR ok % 5 = 0) || '/' || count(*) || ' keys have a current row' AS detail FROM c_ro
    UNION ALL SELECT 'envelope no-nulls [funding_rounds]', 'FAIL', sum(CASE WHEN ok % 11 = 0 THEN CASE WHEN ok % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT || ' null envelope rows' FROM c_ro
    UNION ALL SELECT 'envelope valid_from<=valid_to [funding_rounds]', 'FAIL', sum(CASE WHEN ok % 13 = 0 AND ok % 11 <> 0 THEN CASE WHEN ok % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT || ' inverted ranges' FROM c_ro
    UNION ALL SELECT 'rowcount reconcile [funding_rounds]', 'PASS', count(*) || ' distinct keys vs ' || count(*) || ' expected' FROM c_ro
    UNION ALL SELECT 'status domain [funding_rounds]', 'FAIL', sum(CASE WHEN ok % 17 = 0 THEN CASE WHEN ok % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT || ' rows outside allowed set, 0 null' FROM c_ro
    UNION ALL SELECT 'temporal effective<=ingestion [funding_rounds]', 'WARN', sum(CASE WHEN ok % 19 = 0 THEN CASE WHEN ok % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT || ' rows effective > ingestion (disclosure-lag expected)' FROM c_ro""",
    covers="C3 C4 C5 C7 C8")
def broken_envelopes(c: Context) -> DataFrame:
    k = F.regexp_extract("round_id", r"(\d+)$", 1).cast("bigint")
    df = c.m.conformed["funding_rounds"].withColumn("_k", k)
    k = F.col("_k")
    spoiled = df.withColumns(
        {
            "is_current": (k % 7 != 0) | (k % 5 == 0),
            "valid_to": F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("1980-01-01").cast("date")).otherwise(F.col("valid_to")),
            "reconciliation_status": F.when(k % 17 == 0, "odd").otherwise(F.col("reconciliation_status")),
            "effective_date": F.when(k % 19 == 0, F.lit("2030-01-01").cast("date")).otherwise(F.col("effective_date")),
        }
    )
    spoiled = spoiled.unionByName(spoiled.filter(k % 5 == 0)).drop("_k")
    return entity_report(c, "funding_rounds", spoiled).drop("is_hard")


@query("C10_gold_checks", """
    SELECT 'FK fact_investment.company_sk -> dim_company' AS check_name, 'PASS' AS status, '0 unresolved of ' || count(DISTINCT CASE WHEN has_company THEN ck END) || ' distinct' AS detail FROM f
    UNION ALL SELECT 'FK fact_investment.investor_sk -> dim_investor', 'PASS', '0 unresolved of ' || count(DISTINCT sk) || ' distinct' FROM f
    UNION ALL SELECT 'no unmatched point-in-time company join', CASE WHEN count(*) FILTER (WHERE NOT has_company) = 0 THEN 'PASS' ELSE 'WARN' END,
                     count(*) FILTER (WHERE NOT has_company) || ' fact rows with no matching dim_company version' FROM f
    UNION ALL SELECT 'no unmatched point-in-time investor join', 'PASS', '0 fact rows with no matching dim_investor version'
    UNION ALL SELECT 'rowcount reconcile fact_investment vs conformed_investments', 'PASS', count(*) || ' fact rows vs ' || count(*) || ' current conformed investments' FROM f
    UNION ALL SELECT 'envelope one-current-per-key [dim_company]', 'PASS', '0 keys with >1 current row'
    UNION ALL SELECT 'envelope one-current-per-key [dim_investor]', 'PASS', '0 keys with >1 current row'""")
def gold(c: Context) -> DataFrame:
    return c.m.gold_assertions().drop("is_hard")


@query("G1_date_dimension", """
    SELECT date, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_sk, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
           CAST(month(date) AS INTEGER) AS month, strftime(date, '%B') AS month_name, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
           date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end FROM cal""", covers="G1 U3")
def dates(c: Context) -> DataFrame:
    return c.m.dim_date


@query("G2_company_dimension", """
    SELECT sha256(company_id || '||' || founded) AS company_sk, company_id, legal_name, sector_group, tags AS sector_taxonomy, country,
           founded AS founded_date, founded AS valid_from, DATE '9999-12-31' AS valid_to, true AS is_current FROM c_co""", covers="G2 G4")
def companies(c: Context) -> DataFrame:
    return c.m.dim_company


@query("G3_investor_dimension", """
    SELECT sha256(investor_id || '||1900-01-01') AS investor_sk, investor_id, investor_type, legal_name, vintage_year, size_a AS fund_size,
           '["' || country || '"]' AS geographic_focus, '["Consumer"]' AS sector_focus,
           '["' || ['Pre-Seed', 'Seed', 'Early', 'Growth', 'Late'][sk % 5 + 1] || '"]' AS stage_focus,
           DATE '1900-01-01' AS valid_from, DATE '9999-12-31' AS valid_to, true AS is_current FROM iv""", covers="G3 G4")
def investors(c: Context) -> DataFrame:
    return c.m.dim_investor


@query("G5_investment_fact", """
    SELECT sha256(investment_id) AS investment_sk, investment_id, CASE WHEN has_company THEN sha256(f.company_id || '||' || founded) END AS company_sk,
           sha256(investor_id || '||1900-01-01') AS investor_sk, CAST(strftime(effective, '%Y%m%d') AS INTEGER) AS effective_date_sk,
           CAST(strftime(exit_date, '%Y%m%d') AS INTEGER) AS exit_date_sk, f.round_id, round_type, instrument_type, r.amount AS amount_raised, currency,
           pre_money AS pre_money_valuation, post_money AS post_money_valuation, paid AS participation_amount, is_lead, board_seat_taken,
           effective AS effective_date, exit_date, exit_type, realised AS is_realized, multiple AS realised_return_multiple
    FROM f JOIN c_ro r ON r.ok = f.ok JOIN c_co c ON c.ck = f.ck""", covers="G5 J4 J7 P2")
def fact(c: Context) -> DataFrame:
    return c.m.fact


@query("G6_unmatched_tags", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE sector_group IS NULL) AS no_group FROM c_co")
def unmatched(c: Context) -> DataFrame:
    return star.unmatched_tags(c.m.dim_company)


@query("G7_sector_bridge", """
    SELECT sha256(company_id || '||' || founded) AS company_sk, company_id, tag1 AS tag FROM c_co WHERE tag1 IS NOT NULL
    UNION ALL SELECT sha256(company_id || '||' || founded), company_id, tag2 FROM c_co WHERE tag2 IS NOT NULL""")
def bridge(c: Context) -> DataFrame:
    return star.sector_bridge(c.m.conformed["companies"])


_PIT = """
    SELECT event_id, CASE WHEN h.key IS NOT NULL THEN sha256(h.key || '||' || h.d) END AS version_sk
    FROM (SELECT event_id, 'U-' || user_id AS key, CAST(ts AS DATE) + CAST(event_id % 7 AS INTEGER) AS day FROM events) e
    LEFT JOIN (SELECT key, d, attr, coalesce(lead(d) OVER (PARTITION BY key ORDER BY d), DATE '9999-12-31') AS until FROM (
        SELECT 'U-' || user_id AS key, CAST(ts AS DATE) AS d, arg_max(event_type, (ts, event_id)) AS attr FROM events GROUP BY ALL)) h
    ON h.key = e.key AND e.day >= h.d AND e.day < h.until"""


def _versions(c: Context) -> DataFrame:
    """One version per user and day with an event."""
    from ledgerloom.functions.scalars import surrogate_key

    daily = c.fixtures.changes().groupBy("key", F.col("ts").cast("date").alias("d")).agg(
        F.max_by("attr", F.struct("ts", "event_id")).alias("attr"))
    h = temporal.with_neighbours(daily, "key", ["d"], ["d"], "p", "n")
    return h.select(
        "key", "attr", F.col("d").alias("valid_from"),
        F.coalesce(F.col("n.d"), F.lit("9999-12-31").cast("date")).alias("valid_to")).withColumn(
        "version_sk", surrogate_key("key", "valid_from"))


def _probes(c: Context) -> DataFrame:
    return c.fixtures.changes().select(
        "event_id", "key", F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 7).cast("int")).alias("day"))


@query("J7_point_in_time_join", _PIT, covers="J7 J8")
def pit(c: Context) -> DataFrame:
    return star.pit_join(_probes(c), "day", _versions(c), "key", "version_sk").select("event_id", "version_sk")


@query("J7_point_in_time_sliced", _PIT, covers="J7")
def pit_sliced(c: Context) -> DataFrame:
    return star.pit_join(_probes(c), "day", _versions(c), "key", "version_sk", slices=("2024-01-01", "2024-02-15", 1)).select(
        "event_id", "version_sk")
