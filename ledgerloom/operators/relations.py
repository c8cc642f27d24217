"""Relationship and workflow queries over edge tables.

Hops start from a set of seeds and carry (seed, node) pairs, made distinct after every hop, so work grows with what
the seeds reach. Nothing pairs up all members of a group: counts over a whole table are sums of group sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import json_tags
from ledgerloom.operators.temporal import as_of
from ledgerloom.sources.landing import looked_up, materialize

AFFILIATION = "array<struct<company_id:string,role:string,start_date:string,end_date:string,reason:string>>"
STAGE = "array<struct<at:string,stage:string>>"


def backing(investments: DataFrame) -> DataFrame:
    """Edge table investor, round, company; given back as it is if it is one already, so write it once and pass it."""
    if "is_current" not in investments.columns:
        return investments
    return investments.filter("is_current").select("investor_id", "round_id", "company_id")


def affiliations(people: DataFrame) -> DataFrame:
    """Edge table person, company, role, past or present, from the nested arrays; given back as it is if it is one already,
    so that the arrays need not be parsed for each hop."""
    if "is_past" in people.columns:
        return people
    def side(column: str, past: bool) -> DataFrame:
        return people.filter("is_current").select(
            "person_id", F.explode(F.from_json(column, AFFILIATION)).alias("a"), F.lit(past).alias("is_past"))

    both = side("current_affiliations", False).unionByName(side("historical_affiliations", True))
    return both.select(
        "person_id", "a.company_id", "a.role", F.try_to_date(F.col("a.start_date"), "yyyy-MM-dd").alias("start_date"),
        "is_past")


def hop(frontier: DataFrame, edges: DataFrame, source: str, target: str, keep_start: bool = False) -> DataFrame:
    """From (seed, node) to the distinct (seed, node) one edge further. Drops the way back to the seed."""
    links = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    out = frontier.join(links, frontier["node"] == links["_from"]).select("seed", F.col("_to").alias("node"))
    return (out if keep_start else out.filter(F.col("node") != F.col("seed"))).distinct()


def seeds(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("seed"), F.col(column).alias("node")).distinct()


def company_backers(investments: DataFrame) -> DataFrame:
    """H1: per company the number of distinct backers and rounds."""
    return backing(investments).groupBy("company_id").agg(
        F.count_distinct("investor_id").alias("n_investors"), F.count_distinct("round_id").alias("n_rounds"))


def portfolios(investments: DataFrame) -> DataFrame:
    """H1: per investor the number of distinct companies."""
    return backing(investments).groupBy("investor_id").agg(F.count_distinct("company_id").alias("n_companies"))


def person_companies(people: DataFrame) -> DataFrame:
    """H1: distinct person and company links, with whether any is current."""
    return affiliations(people).groupBy("person_id", "company_id").agg(
        F.bool_or(~F.col("is_past")).alias("is_active"), F.count(F.lit(1)).alias("n_links"))


def coinvestment_degree(investments: DataFrame) -> DataFrame:
    """H2: per investor the rounds shared with others and the seats of others in them.

    The seats are a sum of (round size - 1), so no pair of investors is ever formed. Round sizes come back
    by a join on the round, whose hot keys AQE splits.
    """
    seats = backing(investments).select("investor_id", "round_id").distinct()
    sizes = seats.groupBy("round_id").agg((F.count(F.lit(1)) - 1).alias("others"))
    return seats.join(sizes, "round_id").groupBy("investor_id").agg(
        F.count_if(F.col("others") > 0).alias("shared_rounds"), F.sum("others").alias("other_seats"))


def coinvestors(investments: DataFrame, start: DataFrame) -> DataFrame:
    """H2: for each seed investor, the others in its rounds and the number of rounds they share."""
    seats = backing(investments).select("investor_id", "round_id").distinct()
    rounds = start.join(seats, start["node"] == seats["investor_id"]).select("seed", "round_id")
    return (
        rounds.join(seats, "round_id").filter(F.col("investor_id") != F.col("seed"))
        .groupBy("seed", "investor_id").agg(F.count(F.lit(1)).alias("shared_rounds"))
    )


def former_colleagues(people: DataFrame, start: DataFrame) -> DataFrame:
    """H3: seed people, their past companies, other people at those companies."""
    links = affiliations(people)
    companies = hop(start, links.filter("is_past"), "person_id", "company_id", keep_start=True)
    return hop(companies, links, "company_id", "person_id")


def investor_tags(investments: DataFrame, companies: DataFrame) -> DataFrame:
    """H4: per investor and sector tag, the number of distinct portfolio companies."""
    tags = companies.filter("is_current").select(
        "company_id", F.explode(F.array_distinct(json_tags("sector_taxonomy"))).alias("tag"))
    held = backing(investments).select("investor_id", "company_id").distinct()
    return held.join(tags, "company_id").groupBy("investor_id", "tag").agg(F.count(F.lit(1)).alias("n_companies"))


def latest_stage(rounds: DataFrame) -> DataFrame:
    """Type of the last announced round per company."""
    last = F.max_by("round_type", F.struct("announced_date", "round_id"))
    return rounds.filter("is_current").groupBy("company_id").agg(last.alias("stage"))


def _placed(dim_company: DataFrame, rounds: DataFrame) -> DataFrame:
    """Sector group and latest stage of each company."""
    return dim_company.filter("is_current").select("company_id", "sector_group").join(latest_stage(rounds), "company_id")


def comparables(dim_company: DataFrame, rounds: DataFrame, start: DataFrame) -> DataFrame:
    """H5: companies of the seed's sector group and latest stage."""
    facts = _placed(dim_company, rounds)
    target = start.join(facts, start["node"] == facts["company_id"]).select("seed", "sector_group", "stage")
    return target.join(facts, ["sector_group", "stage"]).filter(F.col("company_id") != F.col("seed")).select(
        "seed", F.col("company_id").alias("node"))


def backed_by_comparables_investors(
    dim_company: DataFrame, rounds: DataFrame, investments: DataFrame, start: DataFrame,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """H5: target, comparables, their investors, the other companies those back.

    Worked out once for each sector group and stage that some seed is in, and only then paired with the seeds. An investor
    counts for a seed if it backs a company of the group that is not the seed: any of several, or its only one there.
    """
    group = ["sector_group", "stage"]
    facts = _placed(dim_company, rounds)
    target = keep(start.join(facts, start["node"] == facts["company_id"]).select("seed", *group).distinct())
    members = looked_up(keep(facts.join(target.select(*group).distinct(), group, "left_semi")))
    edges = backing(investments).select("investor_id", "company_id").distinct()
    backers = edges.join(members, "company_id").groupBy(*group, "investor_id").agg(
        (F.count(F.lit(1)) > 1).alias("several"), F.min("company_id").alias("one"))
    reached = backers.join(edges, "investor_id").groupBy(*group, F.col("company_id").alias("node")).agg(
        F.bool_or("several").alias("several"), F.min("one").alias("first"), F.max("one").alias("last"))
    others = reached.join(members.withColumnRenamed("company_id", "node"), [*group, "node"], "left_anti")
    other_than_seed = F.col("several") | (F.col("first") != F.col("seed")) | (F.col("last") != F.col("seed"))
    return target.join(others, group).filter(other_than_seed).select("seed", "node").distinct()


def warm_intros(people: DataFrame, portfolio: DataFrame, start: DataFrame) -> DataFrame:
    """H6: target company, its people, their companies, the people there who are at a portfolio company now.

    One row per seed and portfolio company with the number of people who can make the introduction.
    """
    links = affiliations(people)
    insiders = hop(start, links, "company_id", "person_id", keep_start=True)
    places = hop(insiders, links, "person_id", "company_id")
    contacts = hop(places, links, "company_id", "person_id", keep_start=True).join(
        insiders, ["seed", "node"], "left_anti")
    ours = portfolio.select(F.col(portfolio.columns[0]).alias("company_id")).distinct()
    present = links.filter("not is_past").join(ours, "company_id", "left_semi").select("person_id", "company_id").distinct()
    return (
        contacts.join(present, contacts["node"] == present["person_id"]).filter(F.col("company_id") != F.col("seed"))
        .groupBy("seed", "company_id").agg(F.count_distinct("person_id").alias("n_contacts"))
    )


def intro_paths(
    people: DataFrame, portfolio: DataFrame, start: DataFrame, k: int = 3, people_between: int = 2,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """H6: the ways from each seed company to each portfolio company, as arrays of ids: company, person, company, ..., company.

    Breadth first: a level holds the nodes that a seed reaches for the first time, with the `k` first of the shortest paths
    to each, in the order of their ids. The k first paths to a node go through k first paths to the nodes before it, so
    cutting there loses none. Over the last link somebody must be at the portfolio company now, and no way passes through the
    company it leads to; so for each portfolio company on a kept path, the k first paths that avoid it are kept too. Rows are
    bounded by the distinct (seed, node) of a level: with p people on the way at most k * (1 + k * p) for each.

    Gives seed, company_id, hops (links), rank and path, for the fewest hops only, up to `people_between` people on the
    way. Ties are broken by the ids on the path, from the seed on.
    """
    links = affiliations(people).select("person_id", "company_id", "is_past").distinct()
    links = keep(links)
    ours = portfolio.select(F.col(portfolio.columns[0]).alias("_to")).distinct()
    last_link = links.filter("not is_past").select(F.col("person_id").alias("_from"), F.col("company_id").alias("_to")).distinct()
    last_link = keep(last_link.join(ours, "_to", "left_semi"))
    edges = links.select("person_id", "company_id").distinct()

    def step(level: DataFrame, source: str, target: str, seen: DataFrame) -> DataFrame:
        out = level.join(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")), F.col("node") == F.col("_from"))
        out = out.select("seed", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"))
        out = out.join(seen, ["seed", "node"], "left_anti")
        first = keep(_first_paths(out, k))
        on_path = first.select("seed", "node", F.explode("path").alias("_to")).filter("_to <> seed and _to <> node")
        on_path = on_path.join(ours, "_to", "left_semi").distinct()
        around = out.join(on_path, ["seed", "node"]).filter(~F.array_contains("path", F.col("_to")))
        return first.unionByName(_first_paths(around, k, "_to").drop("_to")).distinct()

    level = keep(start.select("seed", "node", F.array("node").alias("path")).distinct())
    companies, persons, found = level.select("seed", "node"), None, None
    for n in range(people_between):
        level = keep(step(level, "company_id", "person_id", persons if persons is not None else companies.limit(0)))
        reached = level.select("seed", "node").distinct()
        persons = reached if persons is None else persons.unionByName(reached)
        done = level.join(last_link, F.col("node") == F.col("_from")).filter(~F.array_contains("path", F.col("_to"))).select(
            "seed", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"))
        if found is not None:
            done = done.join(found.select("seed", "node").distinct(), ["seed", "node"], "left_anti")
        done = keep(_first_paths(done, k))
        found = done if found is None else found.unionByName(done)
        if n + 1 < people_between:
            level = keep(step(level, "person_id", "company_id", companies))
            companies = companies.unionByName(level.select("seed", "node").distinct())
    rank = F.row_number().over(Window.partitionBy("seed", "node").orderBy("path"))
    return found.select("seed", F.col("node").alias("company_id"), (F.size("path") - 1).alias("hops"), rank.alias("rank"), "path")


def _first_paths(paths: DataFrame, k: int, *also: str) -> DataFrame:
    """The k first paths of each (seed, node), by their ids; Spark trims each task's rows before they are shuffled."""
    order = Window.partitionBy("seed", "node", *also).orderBy("path")
    return paths.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def funds_sharing_board(
    investments: DataFrame, rounds: DataFrame, dim_company: DataFrame, people: DataFrame, sector_group: str,
    round_type: str, year: int, portfolio: DataFrame,
) -> DataFrame:
    """H7: funds that backed the sector at a round type in a year, in companies sharing a board member with the set."""
    wanted_rounds = rounds.filter(
        F.col("is_current") & (F.col("round_type") == round_type) & (F.year("announced_date") == year)).select("round_id")
    wanted_companies = dim_company.filter(F.col("is_current") & (F.col("sector_group") == sector_group)).select("company_id")
    seats = affiliations(people).filter(F.col("role") == "board").select("person_id", "company_id").distinct()
    ours = portfolio.select(F.col(portfolio.columns[0]).alias("company_id")).distinct()
    # A company shares a member when someone on its board also sits on the board of another company of the set.
    in_set = seats.join(ours, "company_id", "left_semi").groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_set"), F.min("company_id").alias("one"))
    shared = seats.join(in_set, "person_id").filter((F.col("n_set") > 1) | (F.col("one") != F.col("company_id")))
    return (
        backing(investments)
        .join(wanted_rounds, "round_id", "left_semi")
        .join(wanted_companies, "company_id", "left_semi")
        .join(shared.select("company_id"), "company_id", "left_semi")
        .groupBy("investor_id").agg(F.count_distinct("company_id").alias("n_companies"))
    )


def screen(
    dim_company: DataFrame, rounds: DataFrame, round_type: str, first: str, last: str, groups: list[str], valid: str,
    known: str | None = None,
) -> DataFrame:
    """H8: companies with a round of the type announced in the period, in the given sectors, as the data stood."""
    at = as_of(rounds, valid, known).filter(
        (F.col("round_type") == round_type) & F.col("announced_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return as_of(dim_company, valid).filter(F.col("sector_group").isin(groups)).join(
        at.select("company_id"), "company_id", "left_semi").select("company_id", "legal_name", "sector_group", "country")


def stage_steps(deals: DataFrame) -> DataFrame:
    """One row per deal and stage with the whole seconds spent until the next.

    A history has one entry per stage at most, so the window of a deal is a handful of rows.
    """
    rows = deals.filter("is_current").select("deal_id", F.explode(F.from_json("stage_history", STAGE)).alias("s")).select(
        "deal_id", "s.stage", F.to_timestamp_ntz(F.col("s.at")).alias("at"))
    order = Window.partitionBy("deal_id").orderBy("at", "stage")
    return rows.withColumns({"next_stage": F.lead("stage").over(order), "next_at": F.lead("at").over(order)}).withColumn(
        "seconds", F.timestamp_diff("SECOND", F.col("at"), F.col("next_at")))


def stage_report(steps: DataFrame) -> DataFrame:
    """H9: per stage the deals that entered, moved on and their mean hours; the slowest stage is the bottleneck."""
    per = steps.groupBy("stage").agg(
        F.count(F.lit(1)).alias("entered"), F.count("next_stage").alias("moved_on"), (F.avg("seconds") / 3600).alias("avg_hours"))
    slowest = F.max("avg_hours").over(Window.partitionBy(F.lit(1)))
    return per.withColumns(
        {"conversion": F.try_divide("moved_on", "entered"),
         "is_bottleneck": F.coalesce(F.col("avg_hours") == slowest, F.lit(False))})


def why_value(entity: DataFrame, key: str, log: DataFrame, entity_type: str) -> DataFrame:
    """For each entity its sources, and per conflict what disagreed, how it was settled, when and by whom."""
    facts = log.filter(F.col("entity_type") == entity_type).select(
        F.col("entity_id").alias(key), "conflict_type", "conflict_detail", "resolution_action", "resolved_by", "resolved_date")
    return entity.filter("is_current").select(key, "source_attribution", "reconciliation_status").join(facts, key, "left")
