"""Relationship, screening and workflow queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import relations
from ledgerloom.plans.registry import Context, query


def largest_funds(c: Context) -> DataFrame:
    """Per vintage the fund with the most capital invested."""
    paid = c.m.conformed["investments"].groupBy("investor_id").agg(F.round(F.sum("participation_amount"), 2).alias("paid"))
    funds = c.m.conformed["investors"].filter("vintage_year is not null").select("investor_id", "vintage_year")
    best = paid.join(funds, "investor_id").groupBy("vintage_year").agg(
        F.max_by("investor_id", F.struct("paid", "investor_id")).alias("investor_id"))
    return relations.seeds(best, "investor_id")


def largest_targets(c: Context) -> DataFrame:
    """Per sector group the company with the most raised."""
    raised = c.m.conformed["funding_rounds"].groupBy("company_id").agg(F.round(F.sum("amount_raised"), 2).alias("raised"))
    groups = c.m.dim_company.filter("sector_group is not null").select("company_id", "sector_group")
    best = raised.join(groups, "company_id").groupBy("sector_group").agg(
        F.max_by("company_id", F.struct("raised", "company_id")).alias("company_id"))
    return relations.seeds(best, "company_id")


def portfolio(c: Context) -> DataFrame:
    """Companies the largest funds hold."""
    edges = c.m.conformed["investments"]
    return edges.join(largest_funds(c).select(F.col("node").alias("investor_id")), "investor_id", "left_semi").select(
        "company_id").distinct()


FUNDS = """(SELECT arg_max(investor_id, (paid, investor_id)) AS seed FROM (
    SELECT c_ed.investor_id, vintage_year, round(sum(paid), 2) AS paid FROM c_ed JOIN iv USING (sk) WHERE vintage_year IS NOT NULL GROUP BY ALL)
    GROUP BY vintage_year)"""
TARGETS = """(SELECT arg_max(company_id, (raised, company_id)) AS seed FROM (
    SELECT c_ro.company_id, sector_group, round(sum(amount), 2) AS raised FROM c_ro JOIN c_co USING (ck) WHERE sector_group IS NOT NULL GROUP BY ALL)
    GROUP BY sector_group)"""
PORTFOLIO = f"(SELECT DISTINCT company_id FROM c_ed WHERE investor_id IN {FUNDS})"


def seats(c: Context) -> DataFrame:
    return c.kept("edges_backing", lambda: relations.backing(c.m.conformed["investments"]))


def links(c: Context) -> DataFrame:
    return c.kept("edges_affiliations", lambda: relations.affiliations(c.m.conformed["people"]))


@query("H1_company_backers", """
    SELECT company_id, count(DISTINCT sk) AS n_investors, count(DISTINCT ok) AS n_rounds FROM c_ed GROUP BY 1""", covers="H1")
def backers(c: Context) -> DataFrame:
    return relations.company_backers(seats(c))


@query("H1_investor_portfolios", "SELECT investor_id, count(DISTINCT ck) AS n_companies FROM c_ed GROUP BY 1", covers="H1")
def portfolios(c: Context) -> DataFrame:
    return relations.portfolios(seats(c))


@query("H1_person_companies", """
    SELECT person_id, company_id, count(*) FILTER (WHERE NOT is_past) > 0 AS is_active, count(*) AS n_links FROM aff GROUP BY 1, 2""", covers="H1")
def person_companies(c: Context) -> DataFrame:
    return relations.person_companies(links(c))


@query("H2_coinvestment_degree", """
    SELECT investor_id, count(*) FILTER (WHERE n > 1) AS shared_rounds, CAST(sum(n - 1) AS BIGINT) AS other_seats FROM (
        SELECT DISTINCT investor_id, ok FROM c_ed) JOIN (SELECT ok, count(DISTINCT sk) AS n FROM c_ed GROUP BY 1) USING (ok) GROUP BY 1""",
    covers="H2 J14")
def degree(c: Context) -> DataFrame:
    return relations.coinvestment_degree(seats(c))


@query("H2_coinvestors", f"""
    SELECT a.investor_id AS seed, b.investor_id, count(DISTINCT a.ok) AS shared_rounds FROM c_ed a JOIN c_ed b ON a.ok = b.ok AND a.sk <> b.sk
    WHERE a.investor_id IN {FUNDS} GROUP BY 1, 2""", covers="H2 J14")
def coinvestors(c: Context) -> DataFrame:
    return relations.coinvestors(seats(c), largest_funds(c))


BOARD = f"(SELECT person_id FROM aff WHERE role = 'board' AND company_id IN {TARGETS})"


@query("H3_former_colleagues", f"""
    SELECT DISTINCT a.person_id AS seed, b.person_id AS node FROM aff a JOIN aff b ON a.company_id = b.company_id AND a.person_id <> b.person_id
    WHERE a.is_past AND a.person_id IN {BOARD}""", covers="H3 J14")
def colleagues(c: Context) -> DataFrame:
    """Of the people on the boards of the largest targets."""
    people = links(c)
    targets = largest_targets(c).select(F.col("node").alias("company_id"))
    board = relations.affiliations(people).filter("role = 'board'").join(targets, "company_id", "left_semi")
    return relations.former_colleagues(people, relations.seeds(board, "person_id"))


@query("H4_investor_tags", """
    SELECT investor_id, tag, count(*) AS n_companies FROM (SELECT DISTINCT investor_id, ck FROM c_ed)
    JOIN (SELECT ck, tag1 AS tag FROM c_co UNION ALL SELECT ck, tag2 FROM c_co) USING (ck) WHERE tag IS NOT NULL GROUP BY ALL""")
def tags(c: Context) -> DataFrame:
    return relations.investor_tags(seats(c), c.m.lookups["companies"])


_SIMILAR = f"""
    SELECT s.seed, b.company_id AS node FROM {TARGETS} s
    JOIN staged a ON a.company_id = s.seed JOIN staged b ON b.sector_group = a.sector_group AND b.stage = a.stage AND b.company_id <> s.seed"""
_SIMILAR = _SIMILAR.replace("staged ", """(SELECT c_ro.company_id, any_value(sector_group) AS sector_group,
        arg_max(round_type, (announced, round_id)) AS stage FROM c_ro JOIN c_co USING (ck) GROUP BY 1) """)


@query("H5_comparables", _SIMILAR)
def similar(c: Context) -> DataFrame:
    return relations.comparables(c.m.dim_company, c.m.conformed["funding_rounds"], largest_targets(c))


@query("H5_comparable_investors_companies", f"""
    SELECT DISTINCT n.seed, x.company_id AS node FROM ({_SIMILAR}) n JOIN c_ed e ON e.company_id = n.node JOIN c_ed x ON x.sk = e.sk
    WHERE x.company_id <> n.seed AND NOT EXISTS (SELECT 1 FROM ({_SIMILAR}) m WHERE m.seed = n.seed AND m.node = x.company_id)""",
    covers="H5 J14")
def reached(c: Context) -> DataFrame:
    t = c.m.conformed
    return relations.backed_by_comparables_investors(c.m.dim_company, t["funding_rounds"], seats(c), largest_targets(c))


@query("H6_warm_intros", f"""
    SELECT seed, o.company_id, count(DISTINCT o.person_id) AS n_contacts FROM (
        SELECT DISTINCT i.seed, p.person_id FROM (SELECT DISTINCT s.seed, a.person_id FROM {TARGETS} s JOIN aff a ON a.company_id = s.seed) i
        JOIN aff q ON q.person_id = i.person_id AND q.company_id <> i.seed JOIN aff p ON p.company_id = q.company_id) n
    JOIN aff o ON o.person_id = n.person_id AND NOT o.is_past AND o.company_id <> n.seed
    WHERE o.company_id IN {PORTFOLIO} AND NOT EXISTS (SELECT 1 FROM aff z WHERE z.company_id = n.seed AND z.person_id = n.person_id)
    GROUP BY 1, 2""", covers="H6 J14")
def intros(c: Context) -> DataFrame:
    return relations.warm_intros(links(c), portfolio(c), largest_targets(c))


@query("H6_intro_paths", f"""
    SELECT * FROM (WITH RECURSIVE links AS (SELECT DISTINCT person_id, company_id FROM aff),
    walks AS (
        SELECT seed, seed AS node, [seed] AS path, 0 AS hops FROM {TARGETS}
        UNION ALL
        SELECT w.seed, CASE WHEN hops % 2 = 0 THEN l.person_id ELSE l.company_id END,
               list_append(path, CASE WHEN hops % 2 = 0 THEN l.person_id ELSE l.company_id END), hops + 1
        FROM walks w JOIN links l ON w.node = CASE WHEN hops % 2 = 0 THEN l.company_id ELSE l.person_id END
        WHERE hops < 3 AND NOT list_contains(path, CASE WHEN hops % 2 = 0 THEN l.person_id ELSE l.company_id END)),
    ends AS (
        SELECT DISTINCT seed, o.company_id, hops + 1 AS hops, list_append(path, o.company_id) AS path FROM walks w JOIN aff o ON o.person_id = w.node
        WHERE hops % 2 = 1 AND NOT o.is_past AND o.company_id <> seed AND o.company_id IN {PORTFOLIO} AND NOT list_contains(path, o.company_id))
    SELECT seed, company_id, CAST(hops AS INTEGER) AS hops, CAST(rank AS INTEGER) AS rank, array_to_string(path, ' > ') AS path FROM (
        SELECT *, row_number() OVER (PARTITION BY seed, company_id ORDER BY hops, path) AS rank, min(hops) OVER (PARTITION BY seed, company_id) AS fewest FROM ends)
    WHERE hops = fewest AND rank <= 3)""", covers="H6 J14")
def intro_paths(c: Context) -> DataFrame:
    out = relations.intro_paths(links(c), portfolio(c), largest_targets(c))
    return out.withColumn("path", F.array_join("path", " > "))


@query("H7_funds_sharing_board", f"""
    SELECT investor_id, count(DISTINCT ck) AS n_companies FROM c_ed
    WHERE ok IN (SELECT ok FROM c_ro WHERE round_type = 'Series B' AND year(announced) = 1998)
      AND ck IN (SELECT ck FROM c_co WHERE sector_group = 'Consumer')
      AND company_id IN (SELECT a.company_id FROM aff a JOIN aff b ON a.person_id = b.person_id AND a.company_id <> b.company_id
                         WHERE a.role = 'board' AND b.role = 'board' AND b.company_id IN {PORTFOLIO}) GROUP BY 1""")
def sharing(c: Context) -> DataFrame:
    t = c.m.conformed
    return relations.funds_sharing_board(
        seats(c), t["funding_rounds"], c.m.dim_company, links(c), "Consumer", "Series B", 1998, portfolio(c))


@query("H8_screening", """
    SELECT company_id, legal_name, sector_group, country FROM c_co WHERE sector_group IN ('Consumer', 'Industrials') AND founded <= DATE '1998-04-01'
      AND ck IN (SELECT ck FROM c_ro WHERE round_type = 'Series A' AND announced BETWEEN DATE '1998-01-01' AND DATE '1998-03-31')""",
    covers="H8 T6")
def screening(c: Context) -> DataFrame:
    return relations.screen(c.m.dim_company, c.m.conformed["funding_rounds"], "Series A", "1998-01-01", "1998-03-31",
                            ["Consumer", "Industrials"], "1998-04-01", "2002-01-01")


@query("H9_stage_steps", """
    SELECT deal_id, stage, next_stage, us // 1000000 AS seconds FROM steps""", covers="H9 W5")
def steps(c: Context) -> DataFrame:
    return relations.stage_steps(c.m.conformed["deals"]).select("deal_id", "stage", "next_stage", "seconds")


@query("H9_stage_report", """
    SELECT stage, count(*) AS entered, count(next_stage) AS moved_on, round(avg(h), 4) AS avg_hours, round(count(next_stage) / count(*), 6) AS conversion,
           avg(h) = max(avg(h)) OVER () AS is_bottleneck FROM (SELECT stage, next_stage, (us // 1000000) / 3600 AS h FROM steps) GROUP BY stage""",
    covers="H9 A9")
def stage_health(c: Context) -> DataFrame:
    df = relations.stage_report(relations.stage_steps(c.m.conformed["deals"]))
    return df.withColumns({"avg_hours": F.round("avg_hours", 4), "conversion": F.round("conversion", 6)})


@query("H10_why_value", """
    SELECT r.round_id, CASE WHEN in_a AND in_b THEN 'feed_a,feed_b' WHEN in_a THEN 'feed_a' ELSE 'feed_b' END AS sources,
           conflict_type, resolution_action, CASE WHEN conflict_type IS NOT NULL THEN 'stage_b' END AS resolved_by
    FROM c_ro r LEFT JOIN (SELECT * FROM log WHERE entity_type = 'funding_round') l ON l.entity_id = r.round_id""")
def why(c: Context) -> DataFrame:
    log = c.m.log  # writes the reconciled rounds, which the conformed ones are then read from
    df = relations.why_value(c.m.conformed["funding_rounds"], "round_id", log, "funding_round")
    return df.select("round_id", F.array_join("source_attribution", ",").alias("sources"), "conflict_type", "resolution_action", "resolved_by")

