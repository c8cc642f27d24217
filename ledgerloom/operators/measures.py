"""Pooled portfolio measures over any slice of the star.

A measure is never averaged: every slice adds up the same few row-level sums and applies the ratios once, at its
own grain. The fact is summed per dimension key before any dimension is joined, so the join handles keys,
not fact rows, and a fund or company holding a third of the fact is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.landing import materialize

DAYS_PER_YEAR = 365.25
SUMS = ["total_invested", "nav", "cost_days", "matched_rows"]


@dataclass
class Star:
    fact: DataFrame
    company: DataFrame
    investor: DataFrame
    date: DataFrame


def row_worth() -> Column:
    """NAV of one fact."""
    amount = F.col("participation_amount")
    return F.when(F.col("is_realized"), amount * F.col("realised_return_multiple")).otherwise(amount)


def fact_sums(as_of: str) -> list[Column]:
    """A10: the additive parts of all measures. NULL amounts add nothing; a realised row without a multiple
    adds nothing to NAV. `as_of` stands for today."""
    amount = F.col("participation_amount")
    worth = row_worth()
    until = F.when(F.col("is_realized"), F.col("exit_date")).otherwise(F.lit(as_of).cast("date"))
    return [
        F.sum(amount).alias("total_invested"),
        F.sum(worth).alias("nav"),
        F.sum(amount * F.datediff(until, F.col("effective_date"))).alias("cost_days"),
        F.count(F.lit(1)).alias("matched_rows"),
    ]


def _resum(sums: Sequence[str] = SUMS) -> list[Column]:
    return [F.sum(c).alias(c) for c in sums]


def ratios() -> dict[str, Column]:
    """M3-M5 from the sums. A zero or missing denominator gives NULL."""
    invested = F.when(F.col("total_invested") != 0, F.col("total_invested"))
    moic = F.try_divide("nav", invested)
    years = F.try_divide(F.col("cost_days") / DAYS_PER_YEAR, invested)
    return {
        "years_held": years,
        "moic": moic,
        "irr": F.when(moic.isNotNull() & (years > 0), F.pow(moic, F.try_divide(F.lit(1.0), F.when(years > 0, years))) - 1),
    }


def _owner(star: Star, column: str) -> str:
    for name in ("company", "investor", "date"):
        if column in getattr(star, name).columns:
            return name
    if column in star.fact.columns:
        return "fact"
    raise KeyError(column)


KEYS = {"company": ("company_sk", "company_sk"), "investor": ("investor_sk", "investor_sk"),
        "date": ("effective_date_sk", "date_sk"), "exit": ("exit_date_sk", "date_sk")}


def _values(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def wanted(where: dict[str, object]) -> Column:
    """Every column has one of its wanted values; None stands for NULL."""
    cond = F.lit(True)
    for name, value in where.items():
        known = [x for x in _values(value) if x is not None]
        hit = F.coalesce(F.col(name).isin(known), F.lit(False)) if known else F.lit(False)
        cond = cond & (hit | F.col(name).isNull() if None in _values(value) else hit)
    return cond


def _by_date(star: Star, where: dict[str, object] | None) -> tuple[dict[str, object], dict[str, object]]:
    """Conditions on the date dimension, and the others."""
    on = {c: x for c, x in (where or {}).items() if _owner(star, c) == "date"}
    return on, {c: x for c, x in (where or {}).items() if c not in on}


def select_facts(star: Star, by: Sequence[str], where: dict[str, object] | None = None) -> DataFrame:
    """Single facts with the columns of `by` and under the conditions of `where`, wherever these columns are. A dimension is
    joined on its key; facts without a member have NULL there."""
    where = where or {}
    used = {c: _owner(star, c) for c in [*by, *where]}
    out = star.fact
    for dim in sorted({d for d in used.values() if d != "fact"}):
        fk, pk = KEYS[dim]
        columns = sorted({c for c, d in used.items() if d == dim})
        out = out.join(getattr(star, dim).select(F.col(pk).alias("_pk"), *columns), F.col(fk) == F.col("_pk"), "left").drop("_pk")
    return out.filter(wanted(where))


def slice_sums(
    star: Star, by: Sequence[str], where: dict[str, object] | None, as_of: str, date_role: str = "date"
) -> DataFrame:
    """The additive sums per group. `where` maps columns to a wanted value, or to a list of them.

    Columns may come from any dimension or the fact; only the dimensions named are joined. Facts without a
    matching member stay, in the NULL group, and a wanted None selects them (the blank member).
    `date_role="exit"` joins the date dimension on the exit date.
    """
    where = where or {}
    used = {c: _owner(star, c) for c in [*by, *where]}
    dims = sorted({d for d in used.values() if d != "fact"})
    fact_cols = sorted({c for c, d in used.items() if d == "fact"})
    keys = {d: KEYS[date_role if d == "date" else d] for d in dims}

    fact = star.fact
    on_fact = {c: x for c, x in where.items() if used[c] == "fact"}
    if on_fact:
        fact = fact.filter(wanted(on_fact))
    out = fact.groupBy(*fact_cols, *[fk for fk, _ in keys.values()]).agg(*fact_sums(as_of))
    for dim in dims:
        fk, pk = keys[dim]
        columns = sorted({c for c, d in used.items() if d == dim})
        members = getattr(star, dim).select(F.col(pk).alias("_pk"), *columns)
        filtered = {c: x for c, x in where.items() if used[c] == dim}
        blank = all(None in _values(x) for x in filtered.values())  # facts without a member are wanted too
        if filtered and not blank:
            members = members.filter(wanted(filtered))
        out = out.join(members, out[fk] == members["_pk"], "left" if blank else "inner").drop("_pk")
        if filtered and blank:
            out = out.filter(wanted(filtered))
    return out.groupBy(*by).agg(*_resum())


def measure(
    star: Star, by: Sequence[str] = (), where: dict[str, object] | None = None, as_of: str = "", date_role: str = "date"
) -> DataFrame:
    """All measures per group; without groups one row.

    `matched_rows` tells an empty slice (0) from a blank value (M14).
    """
    sums = slice_sums(star, by, where, as_of, date_role).withColumn("matched_rows", F.coalesce("matched_rows", F.lit(0)))
    return sums.withColumns(ratios()).select(*by, "total_invested", "nav", "years_held", "moic", "irr", "matched_rows")


def measure_slices(
    star: Star, slices: dict[str, Sequence[str]], where: dict[str, object] | None = None, as_of: str = "",
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """M8-M11, M15-M17 together: the measures of every slice from one scan of the fact.

    `slices` names sets of columns, () for the total. The fact is summed per dimension key once, and one aggregation over
    grouping sets gives the sums of all slices; ratios are applied at each grain. A column that a slice does not have is NULL
    there; the name of the slice tells that from the blank member. `concentration` is the share of the invested total
    under `where`. The sums are written once, and the total is read from them.
    """
    columns = list(dict.fromkeys(c for by in slices.values() for c in by))
    names = {_set_id(columns, by): name for name, by in slices.items()}
    if len(names) < len(slices):
        raise ValueError("two slices have the same columns")
    sets = [[F.col(c) for c in by] for by in {(): (), **{tuple(b): b for b in slices.values()}}.values()]
    base = slice_sums(star, columns, where, as_of) if columns else slice_sums(star, [], where, as_of).withColumn("_one", F.lit(1))
    grouped = base.groupingSets(sets, *(columns or ["_one"])).agg(F.grouping_id().cast("long").alias("_set"), *_resum())
    sums = keep(grouped)
    everything = _set_id(columns, ()) if columns else sums.agg(F.max("_set")).first()[0]
    total = sums.filter(F.col("_set") == everything).agg(F.max("total_invested").alias("t")).scalar()
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    out = sums.withColumn("slice", F.try_element_at(label, F.col("_set"))).filter("slice is not null")
    out = out.withColumn("matched_rows", F.coalesce("matched_rows", F.lit(0)))
    out = out.withColumns({**ratios(), "concentration": F.try_divide("total_invested", F.when(total != 0, total))})
    return out.select("slice", *columns, "total_invested", "nav", "years_held", "moic", "irr", "concentration", "matched_rows")


def _set_id(columns: Sequence[str], by: Sequence[str]) -> int:
    """Grouping id of a set: a bit for each column that it leaves out, the first column's the highest."""
    return sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in by)


def sector_concentration(
    star: Star, outer: Sequence[str] = (), where: dict[str, object] | None = None, as_of: str = "",
    sector: str = "sector_group",
) -> DataFrame:
    """Share of the invested total with only the sector filter removed, and M4 beside it."""
    where = dict(where or {})
    limited = sector in where
    chosen = where.pop(sector, None)
    sums = slice_sums(star, [*outer, sector], where, as_of)
    # One row per sector and outer group. `sector` must be a column of few values: one task holds an outer group's.
    total = F.sum("total_invested").over(Window.partitionBy(*(outer or [F.lit(1)])))
    out = sums.withColumns({**ratios(), "concentration": F.try_divide("total_invested", F.when(total != 0, total))})
    if limited:
        out = out.filter(wanted({sector: chosen}))
    return out.select(*outer, sector, "total_invested", "moic", "concentration")


def cumulative_nav(star: Star, where: dict[str, object] | None = None, as_of: str = "", grain: str = "date") -> DataFrame:
    """NAV of all facts dated up to each day, or up to the last day of each step, of the calendar.

    Conditions on dates choose the steps that are returned, and the last day within a step; they never cut the
    facts before it. Facts are summed per day first, so the running window holds one row per calendar day.
    """
    dates, rest = _by_date(star, where)
    daily = slice_sums(star, ["effective_date"], rest, as_of).select(F.col("effective_date").alias("_d"), "nav")
    spine = star.date.select(*dict.fromkeys(["date", grain, *dates]))
    steps = spine.join(daily, spine["date"] == daily["_d"], "left")
    running = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_upto", F.sum("nav").over(running)).filter(wanted(dates))
    return steps.groupBy(grain).agg(F.max_by("_upto", "date").alias("cumulative_nav"))


def cumulative_nav_at(star: Star, day: str, where: dict[str, object] | None = None, as_of: str = "") -> DataFrame:
    """One row; NULL when the day is outside the calendar, told apart by `in_calendar`, or outside the conditions on
    dates. Those only say whether the day is asked for; all facts up to it count."""
    dates, rest = _by_date(star, where)
    known = star.date.filter(F.col("date") == F.lit(day).cast("date")).agg(
        (F.count(F.lit(1)) > 0).alias("in_calendar"), (F.count_if(wanted(dates)) > 0).alias("asked"))
    upto = Star(star.fact.filter(F.col("effective_date") <= F.lit(day).cast("date")), star.company, star.investor, star.date)
    nav = slice_sums(upto, [], rest, as_of).select(
        "nav", known.select("in_calendar").scalar().alias("in_calendar"), known.select("asked").scalar().alias("asked"))
    return nav.select(
        F.lit(day).cast("date").alias("date"), F.when(F.col("asked"), F.col("nav")).alias("cumulative_nav"), "in_calendar")


def members(star: Star, column: str = "sector_group") -> DataFrame:
    """Distinct non-null values of a dimension column, sorted."""
    dim = getattr(star, _owner(star, column))
    return dim.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
