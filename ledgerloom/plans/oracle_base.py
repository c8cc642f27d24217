"""The domain tables in SQL, straight from the given tables.

Written from the projection rules, not from the Spark code: no identity map, no gate, no alignment. Each statement
carries only the expressions it uses.
"""

from __future__ import annotations

import re

BASE: dict[str, str] = {
    # companies, rounds, investors and edges as the real world has them, with their coverage by feed
    "co": """
        SELECT c_custkey AS ck, 'C-' || c_custkey AS company_id, c_name AS name_a,
               CASE WHEN c_custkey % 4 = 0 THEN c_name || ' Inc' ELSE c_name END AS name_b, n_name AS country,
               CASE WHEN c_custkey % 29 = 0 THEN '[]'
                    WHEN c_custkey % 5 = 0 THEN '["' || c_mktsegment || '","BUILDING"]'
                    ELSE '["' || c_mktsegment || '"]' END AS tags,
               CASE WHEN c_custkey % 29 <> 0 THEN c_mktsegment END AS tag1,
               CASE WHEN c_custkey % 29 <> 0 AND c_custkey % 5 = 0 AND c_mktsegment <> 'BUILDING' THEN 'BUILDING' END AS tag2,
               CAST(DATE '1994-06-01' + CAST(c_custkey * 37 % 900 AS INTEGER) AS DATE) AS founded,
               c_custkey % 8 <> 0 AS in_a, c_custkey % 6 <> 1 AS in_b
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "grp": """
        SELECT * FROM (VALUES ('AUTOMOBILE', 'Mobility'), ('BUILDING', 'Industrials'), ('FURNITURE', 'Consumer'),
                              ('HOUSEHOLD', 'Consumer'), ('MACHINERY', 'Industrials')) g(segment, sector_group)""",
    "c_co": """
        SELECT ck, company_id, CASE WHEN in_a THEN name_a ELSE name_b END AS legal_name, tags, tag1, tag2, country, founded,
               sector_group, CASE WHEN in_a AND in_b THEN 'clean' ELSE 'conflict_resolved' END AS status
        FROM co LEFT JOIN grp ON segment = tag1""",
    "ro": """
        SELECT o_orderkey AS ok, o_custkey AS ck, 'R-' || o_orderkey AS round_id, CAST(o_orderdate AS DATE) AS od,
               o_custkey % 8 <> 0 AS in_a, o_custkey % 6 <> 1 AS in_b,
               CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 37 AS INTEGER) AS DATE) AS ann_a,
               CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 71 + 10 AS INTEGER) AS DATE) AS ann_b,
               CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
               ['Pre-Seed', 'Seed', 'Series A', 'Series B', 'Series C', 'Series D', 'Series E', 'Bridge', 'Growth'][o_orderkey % 9 + 1] AS round_type,
               ['Equity', 'Convertible Note', 'SAFE'][o_orderkey % 3 + 1] AS instrument_type,
               ['USD', 'EUR', 'GBP'][o_custkey % 3 + 1] AS currency
        FROM orders""",
    "ro2": """
        SELECT *, CAST(CASE WHEN ok % 7 = 0 THEN (cents * 120 + 50) // 100 ELSE cents END AS DOUBLE) / 100 AS amt_a,
               CAST(CASE WHEN ok % 11 = 0 THEN (cents * 85 + 50) // 100 ELSE cents END AS DOUBLE) / 100 AS amt_b,
               CASE WHEN ok % 5 <> 0 THEN CAST(cents * 3 AS DOUBLE) / 100 END AS pre_money,
               CASE WHEN ok % 5 <> 0 THEN CAST(cents * 4 AS DOUBLE) / 100 END AS post_money
        FROM ro""",
    "c_ro": """
        SELECT *, 'C-' || ck AS company_id,
               CASE WHEN in_a AND in_b THEN least(ann_a, ann_b) WHEN in_a THEN ann_a ELSE ann_b END AS announced,
               CASE WHEN in_a THEN amt_a ELSE amt_b END AS amount,
               in_a AND in_b AND abs(datediff('day', ann_a, ann_b)) > 30 AS is_temporal,
               in_a AND in_b AND abs(amt_a - amt_b) / greatest(amt_a, amt_b) > 0.05 AS is_value,
               NOT (in_a AND in_b) AS is_existence
        FROM ro2""",
    "iv": """
        SELECT s_suppkey AS sk, 'I-' || s_suppkey AS investor_id, s_name AS legal_name, n_name AS country,
               ['angel', 'accelerator', 'strategic', 'vc_fund', 'pe_fund', 'corporate_vc', 'family_office', 'sovereign_fund', 'vc_fund'][s_suppkey % 9 + 1] AS investor_type,
               s_suppkey % 9 >= 3 AS is_fund,
               CASE WHEN s_suppkey % 9 >= 3 THEN CAST(1995 + s_suppkey % 7 AS INTEGER) END AS vintage_year,
               CASE WHEN s_suppkey % 9 >= 3 THEN CAST(CAST(round(abs(s_acctbal) * 100) AS BIGINT) * 100 AS DOUBLE) END AS size_a,
               CASE WHEN s_suppkey % 9 >= 3 THEN CASE WHEN s_suppkey % 7 = 3
                    THEN CAST(CAST(round(abs(s_acctbal) * 100) AS BIGINT) * 12500 AS DOUBLE) / 100
                    ELSE CAST(CAST(round(abs(s_acctbal) * 100) AS BIGINT) * 100 AS DOUBLE) END END AS size_b
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "eall": """
        SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, o_custkey AS ck,
               CAST(o_orderdate AS DATE) AS od, l_extendedprice AS price, l_returnflag = 'R' AS realised,
               o_custkey % 8 <> 0 AND o_custkey % 6 <> 1 AS both_cover,
               count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "efeed": """
        SELECT *, 'V-' || ok || '-' || ln AS investment_id,
               ck % 8 <> 0 AND NOT (both_cover AND (ok * 3 + ln) % 10 = 3) AS in_a,
               ck % 6 <> 1 AND NOT (both_cover AND (ok + 5 * ln) % 12 = 5) AS in_b
        FROM eall""",
    "ed": "SELECT * FROM efeed WHERE copies = 1 AND (in_a OR in_b)",
    "c_ed": """
        SELECT e.*, 'I-' || e.sk AS investor_id, 'R-' || e.ok AS round_id, 'C-' || e.ck AS company_id, r.announced AS effective,
               CASE WHEN e.in_a THEN CASE WHEN e.pk % 3 <> 0 THEN price END ELSE CASE WHEN e.pk % 6 <> 0 THEN price END END AS paid,
               e.ln = 1 AS is_lead, e.pk % 4 = 0 AS board_seat_taken,
               CASE WHEN realised THEN CAST(e.od + CAST(900 + e.pk % 700 AS INTEGER) AS DATE) END AS exit_date,
               CASE WHEN realised THEN ['acquisition', 'ipo', 'secondary_sale', 'write_off'][e.pk % 4 + 1] END AS exit_type,
               CASE WHEN realised AND e.pk % 23 <> 0 THEN CASE WHEN e.pk % 4 = 3 THEN 0.0::DOUBLE
                    ELSE CAST(20 + (31 * e.sk + 17 * e.pk) % 300 AS DOUBLE) / 100 END END AS multiple,
               CASE WHEN e.in_a AND e.in_b THEN 'clean' WHEN both_cover THEN 'conflict_flagged' ELSE 'conflict_resolved' END AS status
        FROM ed e JOIN c_ro r ON r.ok = e.ok""",
    "log": """
        SELECT 'company' AS entity_type, company_id AS entity_id, 'existence_disagreement' AS conflict_type,
               'auto_resolved' AS resolution_action, 'coverage_gap' AS subtype FROM co WHERE NOT (in_a AND in_b)
        UNION ALL SELECT 'funding_round', round_id, 'existence_disagreement', 'auto_resolved', 'coverage_gap' FROM c_ro WHERE is_existence
        UNION ALL SELECT 'funding_round', round_id, 'temporal_disagreement', 'auto_resolved', NULL FROM c_ro WHERE is_temporal
        UNION ALL SELECT 'funding_round', round_id, 'value_disagreement', 'flagged_for_review', NULL FROM c_ro WHERE is_value
        UNION ALL SELECT 'investor', investor_id, 'value_disagreement', 'flagged_for_review', NULL FROM iv
                  WHERE greatest(size_a, size_b) > 0 AND abs(size_a - size_b) / greatest(size_a, size_b) > 0.05
        UNION ALL SELECT 'investment', investment_id, 'existence_disagreement', 'flagged_for_review', 'genuine_dispute' FROM ed
                  WHERE NOT (in_a AND in_b) AND both_cover
        UNION ALL SELECT 'investment', investment_id, 'existence_disagreement', 'auto_resolved', 'coverage_gap' FROM ed
                  WHERE NOT (in_a AND in_b) AND NOT both_cover""",
    # the fact with its dimension attributes; a date before founding matches no company version
    "f": """
        SELECT e.*, CASE WHEN effective >= founded THEN c.sector_group END AS sector_group, effective >= founded AS has_company,
               CASE WHEN effective >= founded THEN c.country END AS country, i.vintage_year, i.investor_type,
               CASE WHEN realised THEN paid * multiple ELSE paid END AS worth,
               paid * datediff('day', effective, CASE WHEN realised THEN exit_date ELSE DATE '2002-01-01' END) AS cost_days
        FROM c_ed e JOIN c_co c ON c.ck = e.ck JOIN iv i ON i.sk = e.sk""",
    "cal": """
        SELECT CAST(unnest(generate_series(mn, mx + INTERVAL 365 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM (
            SELECT min(d) AS mn, max(d) AS mx FROM (
                SELECT founded AS d FROM c_co UNION ALL SELECT announced FROM c_ro
                UNION ALL SELECT effective FROM c_ed UNION ALL SELECT exit_date FROM c_ed))""",
    # people and deals
    "aff": """
        SELECT 'P-' || (o_orderkey // 7) AS person_id, 'C-' || o_custkey AS company_id,
               ['founder', 'ceo', 'board', 'advisor'][o_orderkey % 4 + 1] AS role, CAST(o_orderdate AS DATE) AS start_date,
               o_orderstatus = 'F' AS is_past
        FROM orders""",
    "stages": """
        SELECT 'DL-' || user_id AS deal_id, CASE event_type WHEN 'signup' THEN 'sourcing' WHEN 'view' THEN 'screening'
               WHEN 'click' THEN 'due_diligence' WHEN 'purchase' THEN 'closed_won' WHEN 'error' THEN 'passed' END AS stage,
               min(ts) AS since
        FROM events GROUP BY user_id, event_type""",
    "steps": """
        SELECT *, lead(stage) OVER w AS next_stage, epoch_us(lead(since) OVER w) - epoch_us(since) AS us
        FROM stages WINDOW w AS (PARTITION BY deal_id ORDER BY since, stage)""",
    "lab": """
        SELECT d.doc_id, text, lang, source, CASE WHEN toxic = 1 THEN 'Highly Confidential' WHEN quality = 0 THEN 'Confidential'
               WHEN quality = 1 THEN 'Internal' ELSE 'Public' END AS label
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    # fund documents
    "q_ends": """
        SELECT unnest([DATE '2000-03-31', DATE '2000-06-30', DATE '2000-09-30', DATE '2000-12-31', DATE '2001-03-31',
                       DATE '2001-06-30', DATE '2001-09-30', DATE '2001-12-31']) AS q""",
    "held": "SELECT DISTINCT investor_id, company_id FROM c_ed",
    "lp_letter": """
        SELECT 'LPD-' || substr(sha256('quarterly_letter|' || investor_id || '|' || q), 1, 16) AS lp_document_id,
               'quarterly_letter' AS document_type, investor_id, q AS effective_date,
               'Quarterly letter -- ' || fund || ', quarter ended ' || q || '. The fund''s portfolio spans ' || n ||
               ' companies. This quarter''s highlights include ' || string_agg(legal_name, ', ' ORDER BY company_id) ||
               '. Full holdings detail is available on request.' AS body_text,
               list(company_id ORDER BY company_id) AS cs, NULL AS round_id, CAST(n AS DOUBLE) AS stated
        FROM (SELECT h.investor_id, i.legal_name AS fund, q, h.company_id, c.legal_name, n.n,
                     row_number() OVER (PARTITION BY h.investor_id, q ORDER BY md5(h.investor_id || '|' || q || '|' || h.company_id), h.company_id) AS rk,
                     2 + CAST('0x' || substr(md5(h.investor_id || '|' || q), 1, 6) AS INTEGER) % 3 AS want
              FROM held h JOIN iv i ON i.investor_id = h.investor_id AND i.is_fund JOIN q_ends ON year(q) >= i.vintage_year
              JOIN c_co c ON c.company_id = h.company_id
              JOIN (SELECT investor_id, count(*) AS n FROM held GROUP BY 1) n ON n.investor_id = h.investor_id)
        WHERE rk <= want GROUP BY investor_id, fund, q, n""",
    "lp_call": """
        SELECT 'LPD-' || substr(sha256('capital_call_notice|' || investment_id), 1, 16) AS lp_document_id,
               'capital_call_notice' AS document_type, e.investor_id, effective AS effective_date,
               'Capital call notice -- ' || i.legal_name || ' calls ' || format('{:,.2f}', paid) || ' ' || currency ||
               ' for its participation in ' || c.legal_name || '''s ' || round_type || ' round, closing ' || effective || '.' AS body_text,
               [e.company_id] AS cs, e.round_id, paid AS stated
        FROM c_ed e JOIN iv i ON i.sk = e.sk AND i.is_fund JOIN c_co c ON c.ck = e.ck JOIN ro r ON r.ok = e.ok
        WHERE paid IS NOT NULL""",
    "lp_memo": """
        SELECT 'LPD-' || substr(sha256('memo|' || investment_id), 1, 16) AS lp_document_id, 'memo' AS document_type,
               e.investor_id, exit_date AS effective_date,
               'Memo -- ' || i.legal_name || ' realised its position in ' || c.legal_name || ' via ' || exit_type || ', effective ' ||
               exit_date || ', returning ' || CASE WHEN multiple IS NULL THEN 'an undisclosed multiple' ELSE format('{:.2f}', multiple) || 'x cost' END || '.' AS body_text,
               [e.company_id] AS cs, e.round_id, multiple AS stated
        FROM c_ed e JOIN iv i ON i.sk = e.sk AND i.is_fund JOIN c_co c ON c.ck = e.ck WHERE realised""",
    "lp": "SELECT * FROM lp_letter UNION ALL SELECT * FROM lp_call UNION ALL SELECT * FROM lp_memo",
    # one file per document, some failed, some never indexed, some retried, some stale
    "files": """
        SELECT CAST(doc_id AS VARCHAR) AS doc, CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 41 = 5 THEN 'in_progress'
                    WHEN doc_id % 43 = 7 THEN 'cancelled' ELSE 'completed' END AS status
        FROM documents WHERE doc_id % 17 <> 3
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'completed' FROM documents WHERE doc_id % 39 = 0 AND doc_id % 17 <> 3
        UNION ALL SELECT 'old-' || doc_id, 'completed' FROM documents WHERE doc_id % 97 = 0""",
    # BM25 over the stored texts with the benchmark passages as questions
    "tok": "SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF x <> ''] AS ts FROM documents",
    "asked": """
        SELECT DISTINCT item_id, unnest([x FOR x IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']) AS term
        FROM benchmark""",
    "tfs": """
        SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM tok)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL""",
    "bm25": """
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score
            FROM tfs JOIN asked USING (term) JOIN (SELECT term, count(*) AS df FROM tfs GROUP BY 1) USING (term),
                 (SELECT count(*) AS n, avg(len(ts)) AS al FROM tok)
            GROUP BY item_id, doc_id)""",
    # the same over the documents a reader cleared for Internal may see
    "tokv": "SELECT t.* FROM tok t JOIN lab USING (doc_id) WHERE label IN ('Public', 'Internal')",
    "tfsv": "SELECT t.* FROM tfs t JOIN tokv USING (doc_id)",
    "bm25v": """
        SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score
        FROM tfsv JOIN asked USING (term) JOIN (SELECT term, count(*) AS df FROM tfsv GROUP BY 1) USING (term),
             (SELECT count(*) AS n, avg(len(ts)) AS al FROM tokv)
        GROUP BY item_id, doc_id""",
    # versions of each user's last event type
    "chg": """
        SELECT key, attr, ts, event_id FROM (
            SELECT 'U-' || user_id AS key, event_type AS attr, ts, event_id,
                   lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
        WHERE before IS NULL OR before <> attr""",
    "hist": """
        SELECT key, attr, ts AS valid_from, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS nxt FROM chg""",
}


def _uses(sql: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return words & BASE.keys()


def with_base(sql: str) -> str:
    """Put the base expressions the statement needs in front of it, in their order."""
    needed: set[str] = set()
    todo = _uses(sql)
    while todo:
        needed |= todo
        todo = set().union(*(_uses(BASE[n]) for n in todo)) - needed
    if not needed:
        return sql
    body = ",\n".join(f"{name} AS ({text})" for name, text in BASE.items() if name in needed)
    return f"WITH {body}\n{sql.strip()}"
