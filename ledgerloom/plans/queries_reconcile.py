"""Queries of stages B and C."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile, temporal
from ledgerloom.operators.identity import attach_canonical
from ledgerloom.plans.medallion import CONFORMED_KEYS
from ledgerloom.plans.registry import Context, query
from ledgerloom.sources.contracts import SOURCES


def _id(name: str):
    return F.col("canonical_id").alias(name)


@query("R3_two_source_align", """
    SELECT round_id, in_a, in_b, CASE WHEN in_a THEN ann_a END AS announced_a, CASE WHEN in_b THEN ann_b END AS announced_b,
           CASE WHEN in_a THEN amt_a END AS amount_a, CASE WHEN in_b THEN amt_b END AS amount_b FROM ro2""", covers="R3 J2 P11")
def aligned(c: Context) -> DataFrame:
    a, b = SOURCES
    df = c.m.reconciled["funding_rounds"]
    return df.select(
        _id("round_id"), F.col(a).isNotNull().alias("in_a"), F.col(b).isNotNull().alias("in_b"),
        F.col(f"{a}.announced_date").alias("announced_a"), F.col(f"{b}.announced_date").alias("announced_b"),
        F.col(f"{a}.amount_raised").alias("amount_a"), F.col(f"{b}.amount_raised").alias("amount_b"))


@query("R4_temporal_conflict", """
    SELECT round_id, announced AS announced_date, CAST(abs(datediff('day', ann_a, ann_b)) AS INTEGER) AS days_apart
    FROM c_ro WHERE is_temporal""")
def temporal_conflicts(c: Context) -> DataFrame:
    a, b = (F.col(f"{s}.announced_date") for s in SOURCES)
    return c.m.reconciled["funding_rounds"].filter("is_temporal").select(
        _id("round_id"), "announced_date", F.abs(F.datediff(a, b)).alias("days_apart"))


@query("R5_value_conflict", """
    SELECT round_id AS entity_id, amount AS kept, round(abs(amt_a - amt_b) / greatest(amt_a, amt_b), 6) AS gap FROM c_ro WHERE is_value
    UNION ALL SELECT investor_id, size_a, round(abs(size_a - size_b) / greatest(size_a, size_b), 6) FROM iv
    WHERE greatest(size_a, size_b) > 0 AND abs(size_a - size_b) / greatest(size_a, size_b) > 0.05""")
def value_conflicts(c: Context) -> DataFrame:
    from ledgerloom.functions.scalars import relative_gap

    def gap(attr: str):
        return F.round(relative_gap(*[F.col(f"{s}.{attr}") for s in SOURCES]), 6).alias("gap")

    rounds = c.m.reconciled["funding_rounds"].filter("is_value").select(
        _id("entity_id"), F.col("amount_raised").alias("kept"), gap("amount_raised"))
    return rounds.unionByName(c.m.reconciled["investors"].filter("is_value").select(
        _id("entity_id"), F.col("fund_size").alias("kept"), gap("fund_size")))


@query("R6_existence_entity", """
    SELECT company_id, status AS reconciliation_status, legal_name, country FROM c_co""", covers="R6 R8b")
def existence(c: Context) -> DataFrame:
    return c.m.reconciled["companies"].select(
        _id("company_id"), "reconciliation_status", reconcile.best_value("legal_name").alias("legal_name"),
        reconcile.best_value("country").alias("country"))


@query("R7_existence_edge", """
    SELECT investment_id, 'C-' || ck AS company_id, NOT (in_a AND in_b) AND both_cover AS is_genuine,
           NOT (in_a AND in_b) AND NOT both_cover AS is_coverage FROM ed""", covers="R7 J4 P8")
def edges(c: Context) -> DataFrame:
    return c.m.reconciled["investments"].select(_id("investment_id"), "company_id", "is_genuine", "is_coverage")


@query("R8_best_source_row", """
    SELECT investment_id, CASE WHEN in_a THEN 'feed_a' ELSE 'feed_b' END AS best_source, paid AS participation_amount, exit_date,
           exit_type, multiple AS realised_return_multiple FROM c_ed""", covers="R8 W2 U2")
def best_rows(c: Context) -> DataFrame:
    best = c.m.reconciled["investments"].withColumn("b", reconcile.best_row())
    return best.select(
        _id("investment_id"), F.when(F.col("feed_a").isNotNull(), "feed_a").otherwise("feed_b").alias("best_source"),
        "b.participation_amount", "b.exit_date", "b.exit_type", "b.realised_return_multiple")


@query("R8b_attribute_survivorship", """
    SELECT investment_id, CASE WHEN (in_a AND pk % 3 <> 0) OR (in_b AND pk % 6 <> 0) THEN price END AS participation_amount FROM ed""")
def best_attributes(c: Context) -> DataFrame:
    return c.m.reconciled["investments"].select(
        _id("investment_id"), reconcile.best_value("participation_amount").alias("participation_amount"))


@query("R9_conflict_log", """
    SELECT entity_type, entity_id, conflict_type, resolution_action, subtype AS existence_subtype, 'stage_b' AS resolved_by,
           TIMESTAMP '2002-01-01 00:00:00' AS resolved_date,
           sha256(entity_type || '||' || entity_id || '||' || conflict_type || '||2002-01-01 00:00:00') AS reconciliation_id
    FROM log""", covers="R9 U1 L1")
def log(c: Context) -> DataFrame:
    return c.m.log.select(
        "entity_type", "entity_id", "conflict_type", "resolution_action", "existence_subtype", "resolved_by",
        F.col("resolved_date").cast("timestamp_ntz").alias("resolved_date"), "reconciliation_id")


@query("R9_conflict_detail", """
    SELECT company_id AS entity_id, CASE WHEN in_a THEN 'in feed_a only' ELSE 'in feed_b only' END AS detail, 1 AS n_sources
    FROM co WHERE in_a <> in_b
    UNION ALL SELECT round_id, 'announced ' || ann_a || ' vs ' || ann_b, 2 FROM c_ro WHERE is_temporal""")
def log_detail(c: Context) -> DataFrame:
    wanted = (F.col("entity_type") == "company") | (F.col("conflict_type") == "temporal_disagreement")
    return c.m.log.filter(wanted).select(
        "entity_id", F.col("conflict_detail").alias("detail"), F.size("sources_involved").alias("n_sources"))


@query("R10_source_attribution", """
    SELECT round_id, CASE WHEN in_a AND in_b THEN 'feed_a,feed_b' WHEN in_a THEN 'feed_a' ELSE 'feed_b' END AS sources FROM ro""")
def attribution(c: Context) -> DataFrame:
    return c.m.conformed["funding_rounds"].select("round_id", F.array_join("source_attribution", ",").alias("sources"))


@query("R11_status_priority", """
    SELECT CASE WHEN is_value THEN 'conflict_flagged' WHEN is_temporal OR is_existence THEN 'conflict_resolved' ELSE 'clean' END AS status,
           count(*) AS n, count(*) FILTER (WHERE is_value AND is_temporal) AS with_both FROM c_ro GROUP BY 1""", covers="R11 P8 A2")
def priority(c: Context) -> DataFrame:
    return c.m.reconciled["funding_rounds"].groupBy(F.col("reconciliation_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_value") & F.col("is_temporal")).alias("with_both"))


@query("R12_expected_ledger", """
    SELECT entity_type, entity_id AS canonical_id, conflict_type, subtype AS existence_subtype FROM log""", covers="R12 J13")
def ledger(c: Context) -> DataFrame:
    return c.m.ledger.select("entity_type", "canonical_id", "conflict_type", "existence_subtype")


@query("R13_score_against_ledger", """
    SELECT count(*) AS expected, count(*) AS detected, count(*) AS matched, CAST(0 AS BIGINT) AS genuine_mishandled,
           CAST(0 AS BIGINT) AS coverage_mishandled, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS precision, 'PASS' AS verdict FROM log""",
    covers="R13 U4 J5 A9")
def score(c: Context) -> DataFrame:
    return reconcile.score_log(c.m.log, c.m.ledger)


@query("R12_ledger_detail", """
    SELECT entity_type, entity_id, kind, detail FROM (
        SELECT 'company' AS entity_type, company_id AS entity_id, 'existence' AS kind, CASE WHEN in_a THEN 'in feed_a only' ELSE 'in feed_b only' END AS detail
        FROM co WHERE in_a <> in_b
        UNION ALL SELECT 'funding_round', round_id, 'existence', CASE WHEN in_a THEN 'in feed_a only' ELSE 'in feed_b only' END FROM c_ro WHERE is_existence
        UNION ALL SELECT 'funding_round', round_id, 'temporal', 'announced ' || ann_a || ' vs ' || ann_b FROM c_ro WHERE is_temporal
        UNION ALL SELECT 'funding_round', round_id, 'value', 'amount_raised' FROM c_ro WHERE is_value
        UNION ALL SELECT 'investor', investor_id, 'value', 'fund_size' FROM iv WHERE size_a > 0 AND size_b > 0 AND abs(size_a - size_b) / greatest(size_a, size_b) > 0.05
        UNION ALL SELECT 'investment', investment_id, 'existence', CASE WHEN in_a THEN 'edge in feed_a only' ELSE 'edge in feed_b only' END || '; company covered by ' ||
                  concat_ws(',', CASE WHEN ck % 8 <> 0 THEN 'feed_a' END, CASE WHEN ck % 6 <> 1 THEN 'feed_b' END) FROM ed WHERE in_a <> in_b)""", covers="R12 R9")
def ledger_detail(c: Context) -> DataFrame:
    """The detail of each kind; of amounts, whose text depends on how doubles are written, only the attribute, and the two
    numbers are checked to be there."""
    kind = F.split("conflict_type", "_")[0]
    numbers = F.size(F.regexp_extract_all("detail", F.lit(r"[0-9][0-9.E]*"), F.lit(0))) == 2
    detail = F.when(kind == "value", F.when(numbers, F.split("detail", " ")[0])).otherwise(F.col("detail"))
    return c.m.ledger.select("entity_type", F.col("canonical_id").alias("entity_id"), kind.alias("kind"), detail.alias("detail"))


@query("R13_imperfect_log", """
    SELECT count(*) AS expected, CAST(count(*) FILTER (WHERE NOT gone) + (SELECT count(*) FROM co WHERE in_a = in_b) AS BIGINT) AS detected,
           count(*) FILTER (WHERE NOT gone) AS matched,
           count(*) FILTER (WHERE NOT gone AND subtype = 'genuine_dispute' AND turned) AS genuine_mishandled,
           count(*) FILTER (WHERE NOT gone AND entity_type = 'investment' AND subtype = 'coverage_gap' AND turned) AS coverage_mishandled,
           round(count(*) FILTER (WHERE NOT gone) / count(*), 6) AS recall,
           round(count(*) FILTER (WHERE NOT gone) / (count(*) FILTER (WHERE NOT gone) + (SELECT count(*) FROM co WHERE in_a = in_b)), 6) AS precision, 'REVIEW' AS verdict
    FROM (SELECT *, ascii(right(entity_id, 1)) % 5 = 0 AS gone, ascii(right(entity_id, 1)) % 3 = 0 AS turned FROM log)""", covers="R13 U4 A9")
def imperfect(c: Context) -> DataFrame:
    """A log that lost rows, has a conflict too many for each company in both feeds, and handles some edges the wrong way."""
    last = F.ascii(F.right("entity_id", F.lit(1)))
    edge = F.col("entity_type") == "investment"
    other = F.when(F.col("resolution_action") == "auto_resolved", "flagged_for_review").otherwise("auto_resolved")
    log = c.m.log.select("entity_type", "entity_id", "conflict_type", "resolution_action").filter(last % 5 != 0)
    log = log.withColumn("resolution_action", F.when(edge & (last % 3 == 0), other).otherwise(F.col("resolution_action")))
    both = c.m.reconciled["companies"].filter(~F.col("is_existence")).select(
        F.lit("company").alias("entity_type"), F.col("canonical_id").alias("entity_id"),
        F.lit("existence_disagreement").alias("conflict_type"), F.lit("auto_resolved").alias("resolution_action"))
    df = reconcile.score_log(log.unionByName(both), c.m.ledger)
    return df.withColumns({x: F.round(x, 6) for x in ("recall", "precision")})


@query("R14_log_summary", """
    SELECT entity_type, conflict_type, resolution_action, count(*) AS n FROM log GROUP BY ALL""", covers="R14 A2 L1")
def summary(c: Context) -> DataFrame:
    return reconcile.log_summary(c.m.log)


@query("R15_rate_profile", """
    SELECT *, round(companies_single / companies_union, 6) AS single_rate, round(value_conflicts / shared_rounds, 6) AS value_rate,
           round(temporal_conflicts / shared_rounds, 6) AS temporal_rate, round(genuine_disputes / edges, 6) AS genuine_rate,
           round(coverage_gaps / edges, 6) AS gap_rate
    FROM (SELECT count(*) FILTER (WHERE in_a) AS companies_a, count(*) FILTER (WHERE in_b) AS companies_b, count(*) FILTER (WHERE in_a AND in_b) AS companies_both,
                 count(*) FILTER (WHERE in_a <> in_b) AS companies_single, count(*) AS companies_union FROM co),
         (SELECT count(*) FILTER (WHERE NOT is_existence) AS shared_rounds, count(*) FILTER (WHERE is_value) AS value_conflicts,
                 count(*) FILTER (WHERE is_temporal) AS temporal_conflicts FROM c_ro),
         (SELECT count(*) AS edges, count(*) FILTER (WHERE NOT (in_a AND in_b) AND both_cover) AS genuine_disputes,
                 count(*) FILTER (WHERE NOT (in_a AND in_b) AND NOT both_cover) AS coverage_gaps FROM ed)""", covers="R15 A9 U6 J13")
def profile(c: Context) -> DataFrame:
    df = reconcile.rate_profile(
        c.m.maps["company"], c.m.reconciled["funding_rounds"], c.m.reconciled["investments"])
    return df.withColumns({x: F.round(x, 6) for x in df.columns if x.endswith("_rate")})


# --- stage C ---


@query("J3_fk_remap", "SELECT investment_id, investor_id, round_id, company_id FROM c_ed", covers="J3 J4")
def remap(c: Context) -> DataFrame:
    return c.m.conformed["investments"].select("investment_id", "investor_id", "round_id", "company_id")


@query("J5_inner_join", """
    SELECT entity_id, resolution_action FROM log WHERE entity_type = 'investment' AND subtype = 'genuine_dispute'""")
def inner(c: Context) -> DataFrame:
    genuine = c.m.ledger.filter("entity_type = 'investment' and existence_subtype = 'genuine_dispute'")
    genuine = genuine.select(F.col("canonical_id").alias("entity_id"))
    return c.m.log.filter("entity_type = 'investment'").select("entity_id", "resolution_action").join(genuine, "entity_id")


@query("J13_two_feed_merge", """
    SELECT round_id, amt_a AS amount_a, amt_b AS amount_b FROM ro2 WHERE in_a AND in_b""")
def merged(c: Context) -> DataFrame:
    def side(s: str, suffix: str) -> DataFrame:
        df = c.m.landing[s, "funding_rounds"].select("vendor_round_id", F.col("amount_raised").alias(f"amount_{suffix}"))
        return attach_canonical(df, c.m.maps["funding_round"], "funding_round", s, "vendor_round_id", "round_id").drop("vendor_round_id")

    return side("feed_a", "a").join(side("feed_b", "b"), "round_id")


@query("T1_effective_dates", """
    SELECT 'companies' AS entity, company_id AS id, founded AS effective_date FROM c_co
    UNION ALL SELECT 'funding_rounds', round_id, announced FROM c_ro
    UNION ALL SELECT 'investors', investor_id, DATE '2002-01-01' FROM iv
    UNION ALL SELECT 'investments', investment_id, effective FROM c_ed
    UNION ALL SELECT DISTINCT 'people', person_id, DATE '2002-01-01' FROM aff
    UNION ALL SELECT DISTINCT 'deals', deal_id, DATE '2002-01-01' FROM stages
    UNION ALL SELECT 'documents', 'D-' || doc_id, CAST(DATE '1995-01-01' + CAST(doc_id * 31 % 2400 AS INTEGER) AS DATE) FROM documents""")
def effective(c: Context) -> DataFrame:
    out = None
    for entity, key in CONFORMED_KEYS.items():
        part = c.m.conformed[entity].select(F.lit(entity).alias("entity"), F.col(key).alias("id"), "effective_date")
        out = part if out is None else out.unionByName(part)
    return out


@query("T2_scd2_envelope", """
    SELECT company_id, founded AS valid_from, DATE '9999-12-31' AS valid_to, true AS is_current FROM c_co""")
def first_envelope(c: Context) -> DataFrame:
    return c.m.conformed["companies"].select("company_id", *temporal.ENVELOPE)


@query("T3_genesis_envelope", """
    SELECT investor_id, vintage_year, size_a AS fund_size, DATE '1900-01-01' AS valid_from, DATE '9999-12-31' AS valid_to, true AS is_current FROM iv""")
def genesis(c: Context) -> DataFrame:
    return c.m.conformed["investors"].select("investor_id", "vintage_year", "fund_size", *temporal.ENVELOPE)


CUT = "2024-01-16"


def change_state(c: Context) -> DataFrame:
    """One open version per user: the last event before the cut."""
    last = c.fixtures.changes().filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")).groupBy("key").agg(
        F.max_by(F.struct("attr", "ts"), F.struct("ts", "event_id")).alias("l"))
    df = last.select("key", "l.attr", F.col("l.ts").cast("date").alias("changed"))
    return temporal.envelope(df, "changed")


def change_batch(c: Context) -> DataFrame:
    """The last event per user after the cut: some change the attribute, some repeat it, some users are new."""
    last = c.fixtures.changes().filter(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")).groupBy("key").agg(
        F.max_by(F.struct("attr", "ts"), F.struct("ts", "event_id")).alias("l"))
    return last.select("key", "l.attr", F.col("l.ts").cast("date").alias("changed"))


_MERGED = """
    SELECT key, attr, changed, changed AS valid_from, coalesce(closed, DATE '9999-12-31') AS valid_to, closed IS NULL AS is_current FROM (
        SELECT o.*, CASE WHEN n.attr <> o.attr THEN n.changed END AS closed FROM old o LEFT JOIN new n USING (key)
        UNION ALL SELECT n.*, NULL FROM new n LEFT JOIN old o USING (key) WHERE o.key IS NULL OR n.attr <> o.attr)"""
_OLD_NEW = """
    (SELECT 'U-' || user_id AS key, arg_max(event_type, (ts, event_id)) AS attr, CAST(max(ts) AS DATE) AS changed
     FROM events WHERE ts {op} TIMESTAMP '2024-01-16' GROUP BY 1)"""
_MERGED = _MERGED.replace("FROM old ", "FROM " + _OLD_NEW.format(op="<") + " ").replace(
    "JOIN old ", "JOIN " + _OLD_NEW.format(op="<") + " ").replace("JOIN new ", "JOIN " + _OLD_NEW.format(op=">=") + " ").replace(
    "FROM new ", "FROM " + _OLD_NEW.format(op=">=") + " ")


@query("T4_scd2_merge", _MERGED, covers="T4 J9 J5")
def merge(c: Context) -> DataFrame:
    return temporal.scd2_apply(change_state(c), change_batch(c), "key", ["attr"], "changed").state


@query("T4_scd2_replay", _MERGED, covers="T4")
def replay(c: Context) -> DataFrame:
    once = c.kept("t4_once", lambda: merge(c))
    return temporal.scd2_apply(once, change_batch(c), "key", ["attr"], "changed").state


@query("T4_rejected_updates", """
    SELECT key, attr, changed, CASE WHEN key IS NULL THEN 'null_key' ELSE 'dup_key' END AS reason FROM (
        SELECT CASE WHEN user_id % 5 <> 0 THEN 'U-' || user_id END AS key, event_type AS attr, CAST(ts AS DATE) AS changed,
               count(*) OVER (PARTITION BY CASE WHEN user_id % 5 <> 0 THEN 'U-' || user_id END) AS copies
        FROM events WHERE ts >= TIMESTAMP '2024-01-16') WHERE copies > 1 OR key IS NULL""")
def rejected(c: Context) -> DataFrame:
    k = F.regexp_extract("key", r"(\d+)$", 1).cast("bigint")
    raw = c.fixtures.changes().filter(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")).select(
        F.when(k % 5 != 0, F.col("key")).alias("key"), "attr", F.col("ts").cast("date").alias("changed"))
    out = temporal.scd2_apply(change_state(c), raw, "key", ["attr"], "changed").rejected
    return out.withColumnRenamed("_reject_reason", "reason")


@query("T5_version_history", """
    SELECT key, attr, valid_from, coalesce(nxt, TIMESTAMP '9999-12-31') AS valid_to FROM hist
    WHERE key = (SELECT key FROM hist GROUP BY key ORDER BY count(*) DESC, key LIMIT 1)""", covers="T5 L1")
def history_of_key(c: Context) -> DataFrame:
    h = history(c)
    longest = h.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "key").limit(1)
    return temporal.versions(h, "key", longest.select("key")).select("key", "attr", "valid_from", "valid_to")


@query("T6_as_of_snapshot", """
    SELECT key, attr, valid_from FROM hist WHERE valid_from <= TIMESTAMP '2024-01-12 06:00:00' AND (nxt IS NULL OR nxt > TIMESTAMP '2024-01-12 06:00:00')""",
    covers="T6 J8")
def snapshot(c: Context) -> DataFrame:
    at = F.lit("2024-01-12 06:00:00").cast("timestamp_ntz")
    return temporal.as_of(history(c), at).select("key", "attr", "valid_from")


@query("T6_as_of_both_axes", """
    SELECT 'known' AS kind, count(*) FILTER (WHERE announced <= DATE '1998-06-30') AS n FROM c_ro
    UNION ALL SELECT 'not yet known', 0 FROM (SELECT 1)""", covers="T6")
def both_axes(c: Context) -> DataFrame:
    rounds = c.m.conformed["funding_rounds"]
    count = F.count(F.lit(1)).alias("n")
    known = temporal.as_of(rounds, "1998-06-30", "2002-01-02").agg(count).select(F.lit("known").alias("kind"), "n")
    early = temporal.as_of(rounds, "1998-06-30", "2001-12-31").agg(count).select(F.lit("not yet known").alias("kind"), "n")
    return known.unionByName(early)


@query("T7_null_audit", """
    SELECT 'companies' AS table_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS effective_null, CAST(0 AS BIGINT) AS ingestion_null FROM c_co
    UNION ALL SELECT 'funding_rounds', count(*), count(*) FILTER (WHERE announced IS NULL), 0 FROM c_ro
    UNION ALL SELECT 'investors', count(*), 0, 0 FROM iv UNION ALL SELECT 'investments', count(*), count(*) FILTER (WHERE effective IS NULL), 0 FROM c_ed
    UNION ALL SELECT 'people', count(DISTINCT person_id), 0, 0 FROM aff UNION ALL SELECT 'deals', count(DISTINCT deal_id), 0, 0 FROM stages
    UNION ALL SELECT 'documents', count(*), 0, 0 FROM documents""")
def audit(c: Context) -> DataFrame:
    return temporal.null_audit({e: c.m.conformed[e] for e in CONFORMED_KEYS})


@query("T8_pass_through", """
    SELECT 'D-' || doc_id AS document_id,
           ['ic_memo', 'dd_report', 'news_article', 'transcript', 'vendor_report', 'analyst_note'][doc_id % 6 + 1] AS document_type,
           CASE WHEN doc_id % 4 <> 0 THEN 'P-' || doc_id END AS author_person_id, label AS sensitivity_label, 'clean' AS reconciliation_status,
           CAST(DATE '1995-01-01' + CAST(doc_id * 31 % 2400 AS INTEGER) AS DATE) AS valid_from FROM lab""")
def passed_through(c: Context) -> DataFrame:
    return c.m.conformed["documents"].select(
        "document_id", "document_type", "author_person_id", "sensitivity_label", "reconciliation_status", "valid_from")


def history(c: Context) -> DataFrame:
    return c.kept("change_history", lambda: temporal.history_from_changes(c.fixtures.changes(), "key", ["attr"], "ts", "event_id"))


@query("T9_history_from_changes", """
    SELECT key, attr, valid_from, coalesce(nxt, TIMESTAMP '9999-12-31') AS valid_to, nxt IS NULL AS is_current FROM hist""",
    covers="T9 W5")
def change_history(c: Context) -> DataFrame:
    return history(c)


@query("W5_neighbours", """
    SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbours(c: Context) -> DataFrame:
    df = temporal.with_neighbours(c.fixtures.changes(), "key", ["ts", "event_id"], ["attr"], "p", "n")
    return df.select("event_id", F.col("p.attr").alias("before"), F.col("n.attr").alias("after"))


@query("W5_null_keys", """
    SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM (
        SELECT *, CASE WHEN user_id % 3 <> 0 THEN user_id END AS k, CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events)
    WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, event_id)""", covers="W5")
def neighbours_of_null_keys(c: Context) -> DataFrame:
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("bigint")
    df = c.fixtures.changes().withColumn("key", F.when(number % 3 != 0, F.col("key"))).withColumn(
        "ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    df = temporal.with_neighbours(df, "key", ["ts", "event_id"], ["attr"], "p", "n")
    return df.select("event_id", F.col("p.attr").alias("before"), F.col("n.attr").alias("after"))
