"""Stage E: date, company and investor dimensions, and the investment fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.functions.scalars import date_key, json_tags, surrogate_key, valid_at
from ledgerloom.operators.quality import Check, check_reference, evaluate, report, said

# The columns of the fact.
FACT_COLUMNS = [
    "investment_sk", "investment_id", "company_sk", "investor_sk", "effective_date_sk", "exit_date_sk", "round_id",
    "round_type", "instrument_type", "amount_raised", "currency", "pre_money_valuation", "post_money_valuation",
    "participation_amount", "is_lead", "board_seat_taken", "effective_date", "exit_date", "exit_type", "is_realized",
    "realised_return_multiple",
]


def date_dimension(dates: list[DataFrame], extra_days: int = 365) -> DataFrame:
    """One row per day from the first to the last date seen plus a year. Each frame has one date column."""
    ends = [d.agg(F.min(d.columns[0]).alias("mn"), F.max(d.columns[0]).alias("mx")) for d in dates]
    bounds = reduce(DataFrame.union, ends).agg(F.min("mn").alias("mn"), F.max("mx").alias("mx")).filter("mn is not null")
    days = bounds.select(F.explode(F.sequence("mn", F.date_add("mx", extra_days))).alias("date"))
    return days.select(
        "date",
        date_key("date").alias("date_sk"),
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.dayofweek("date").alias("day_of_week"),
        ((F.col("date") == F.last_day("date")) & (F.month("date") % 3 == 0)).alias("is_quarter_end"),
    )


def group_of_tag(tag: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """Sector group of a tag from the fixed taxonomy, NULL when unknown.

    A few dozen fixed entries, so a map inside the expression rather than a join.
    """
    pairs = [(t, g) for g, tags in (groups or v.SECTOR_GROUPS).items() for t in tags]
    lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.when(tag.isNotNull(), F.try_element_at(lookup, tag))


def company_dimension(companies: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Sector group from the first tag, key from company and version start."""
    first = F.get(json_tags("sector_taxonomy"), F.lit(0))
    return companies.select(
        surrogate_key("company_id", "valid_from").alias("company_sk"),
        "company_id", "legal_name", group_of_tag(first, groups).alias("sector_group"), "sector_taxonomy", "country",
        F.col("effective_date").alias("founded_date"), "valid_from", "valid_to", "is_current",
    )


def investor_dimension(investors: DataFrame) -> DataFrame:
    """G3."""
    return investors.select(
        surrogate_key("investor_id", "valid_from").alias("investor_sk"),
        "investor_id", "investor_type", "legal_name", "vintage_year", "fund_size", "geographic_focus", "sector_focus",
        "stage_focus", "valid_from", "valid_to", "is_current",
    )


def sector_bridge(companies: DataFrame) -> DataFrame:
    """One row per company version and tag."""
    return companies.select(
        surrogate_key("company_id", "valid_from").alias("company_sk"), "company_id",
        F.explode(F.array_distinct(json_tags("sector_taxonomy"))).alias("tag"),
    )


def pit_join(
    fact: DataFrame, at: str, dim: DataFrame, key: str, sk: str, slices: tuple[str, str, int] | None = None
) -> DataFrame:
    """Attach the dimension version valid at the fact's date, NULL when there is none.

    The key is an equality, so this is a hash or sort-merge join with the window as the rest of the
    condition: a small dimension is broadcast by measured size, and for a large one AQE splits the
    tasks of a hot key. Overlapping versions match more than once; the row-count check reports that.

    `slices=(first_day, last_day, days)` is for dimensions with long histories per key. Versions are repeated
    for each slice of so many days that they touch and the slice joins the equality, so facts meet only the
    versions of their own slice, and a hot key is spread over the slices. Choose `days` near the usual length of a
    version: shorter slices repeat versions, longer ones spread less. Dates outside the range fall in its end
    slices, which keeps the result the same. Repeated versions are many times what the dimension's files suggest, so the
    sliced join always sorts and merges: a broadcast planned by the files' size would not fit the driver.
    """
    d = dim.select(F.col(key).alias("_k"), F.col(sk).alias("_sk"), F.col("valid_from").alias("_vf"),
                   F.col("valid_to").alias("_vt"))
    f = fact.drop(sk)
    on = (F.col(key) == F.col("_k")) & valid_at(F.col(at), "_vf", "_vt")
    if slices:
        first, last = (F.lit(x).cast("date") for x in slices[:2])

        def slice_of(c: Column) -> Column:
            inside = F.least(F.greatest(c.cast("date"), first), last)  # NULL stays NULL
            return F.when(c.isNotNull(), F.floor(F.datediff(inside, first) / slices[2]).cast("int"))

        d = d.filter("_vf < _vt").withColumn(
            "_slice", F.explode(F.sequence(slice_of(F.col("_vf")), slice_of(F.date_sub("_vt", 1))))).hint("merge")
        f = f.withColumn("_at_slice", slice_of(F.col(at)))
        on = on & (F.col("_at_slice") == F.col("_slice"))
    joined = f.join(d, on, "left").withColumnRenamed("_sk", sk)
    return joined.drop("_k", "_vf", "_vt", "_slice", "_at_slice")


def investment_fact(
    investments: DataFrame, rounds: DataFrame, dim_company: DataFrame, dim_investor: DataFrame
) -> DataFrame:
    """Current investments with round attributes, both dimension versions of their day, and date keys."""
    round_attrs = rounds.filter("is_current").select(
        "round_id", "round_type", "instrument_type", "amount_raised", "currency", "pre_money_valuation",
        "post_money_valuation",
    )
    base = investments.filter("is_current").join(round_attrs, "round_id", "left")
    base = pit_join(base, "effective_date", dim_company, "company_id", "company_sk")
    base = pit_join(base, "effective_date", dim_investor, "investor_id", "investor_sk")
    return base.withColumns(
        {
            "investment_sk": surrogate_key("investment_id"),
            "effective_date_sk": date_key("effective_date"),
            "exit_date_sk": date_key("exit_date"),
            "is_realized": F.col("exit_date").isNotNull(),
        }
    ).select(*FACT_COLUMNS)


def unmatched_tags(dim_company: DataFrame) -> DataFrame:
    """Companies whose first tag is in no group."""
    return dim_company.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("sector_group").isNull()).alias("no_group"))


def certify(
    fact: DataFrame, dim_company: DataFrame, dim_investor: DataFrame, investments: DataFrame
) -> DataFrame:
    """The seven gold assertions."""
    c = F.col
    base = investments.filter("is_current").agg(F.count_distinct("investment_id").alias("n_base"))
    counts = fact.agg(
        F.count(F.lit(1)).alias("n_fact"),
        F.count_if(c("company_sk").isNull()).alias("no_company"),
        F.count_if(c("investor_sk").isNull()).alias("no_investor"),
    ).select("*", base.scalar().alias("n_base"))
    parts = [
        check_reference(v.CHECK_FACT_COMPANY, fact, "company_sk", dim_company, "company_sk"),
        check_reference(v.CHECK_FACT_INVESTOR, fact, "investor_sk", dim_investor, "investor_sk"),
        evaluate(
            counts,
            [
                # Rounds may close before the company's founding date, so this one only warns.
                Check(v.CHECK_PIT_COMPANY, c("no_company") == 0, said(v.DETAIL_PIT_COMPANY, c("no_company")), hard=False),
                Check(v.CHECK_PIT_INVESTOR, c("no_investor") == 0, said(v.DETAIL_PIT_INVESTOR, c("no_investor"))),
                Check(v.CHECK_FACT_ROWS, c("n_fact") == c("n_base"), said(v.DETAIL_FACT_ROWS, c("n_fact"), c("n_base"))),
            ],
        ),
    ]
    for name, dim, key in (("dim_company", dim_company, "company_id"), ("dim_investor", dim_investor, "investor_id")):
        multi = dim.filter("is_current").groupBy(key).count().agg(F.count_if(c("count") > 1).alias("multi"))
        check = Check(v.CHECK_ONE_CURRENT % name, c("multi") == 0, said(v.DETAIL_DIM_CURRENT, c("multi")))
        parts.append(evaluate(multi, [check]))
    return report(parts)
