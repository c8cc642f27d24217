"""Queries of the measure layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import measures
from ledgerloom.plans.registry import AS_OF, Context, query

ROUNDING = {"total_invested": 2, "nav": 4, "years_held": 6, "moic": 6, "irr": 6, "concentration": 6, "cumulative_nav": 4}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in ROUNDING.items() if c in df.columns})


SUMS = "sum(paid) AS ti, sum(worth) AS nv, sum(cost_days) AS cd, count(*) AS n"
ALL = """round(ti, 2) AS total_invested, round(nv, 4) AS nav, round(cd / 365.25 / nullif(ti, 0), 6) AS years_held,
    round(nv / nullif(ti, 0), 6) AS moic,
    round(CASE WHEN nv / nullif(ti, 0) IS NOT NULL AND cd / ti > 0 THEN pow(nv / ti, 1 / (cd / 365.25 / ti)) - 1 END, 6) AS irr,
    n AS matched_rows"""


def grouped(by: str, where: str = "true") -> str:
    return f"SELECT {by}, {ALL} FROM (SELECT {by}, {SUMS} FROM f WHERE {where} GROUP BY ALL)"


def single(column: str, where: str = "true") -> str:
    return f"SELECT {column} FROM (SELECT {ALL} FROM (SELECT {SUMS} FROM f WHERE {where}))"


@query("M1_total_invested", single("total_invested"), covers="M1 M10")
def total(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, as_of=AS_OF)).select("total_invested")


@query("M2_nav", single("nav"), covers="M2 M10 A10")
def nav(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, as_of=AS_OF)).select("nav")


@query("M3_years_held", grouped("investor_type").replace("SELECT investor_type, round", "SELECT investor_type, years_held FROM (SELECT investor_type, round", 1) + ")",
       covers="M3 M10")
def years(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, ["investor_type"], as_of=AS_OF)).select("investor_type", "years_held")


@query("M4_moic", single("moic"), covers="M4 M10 A11")
def moic(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, as_of=AS_OF)).select("moic")


@query("M5_irr", single("irr"), covers="M5 M10")
def irr(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, as_of=AS_OF)).select("irr")


@query("M6_sector_concentration", """
    SELECT sector_group, round(sum(paid), 2) AS total_invested, round(sum(worth) / sum(paid), 6) AS moic,
           round(sum(paid) / (SELECT sum(paid) FROM f), 6) AS concentration FROM f GROUP BY 1""", covers="M6 A12 W4")
def concentration(c: Context) -> DataFrame:
    return rounded(measures.sector_concentration(c.star, as_of=AS_OF))


@query("M6_concentration_filtered", """
    SELECT vintage_year, sector_group, round(ti, 2) AS total_invested, round(nv / ti, 6) AS moic, round(ti / total, 6) AS concentration FROM (
        SELECT *, sum(ti) OVER (PARTITION BY vintage_year) AS total FROM (
            SELECT vintage_year, sector_group, sum(paid) AS ti, sum(worth) AS nv FROM f WHERE vintage_year IN (1997, 1999) GROUP BY ALL)) WHERE sector_group = 'Consumer'""", covers="M6 M9 A12")
def concentration_filtered(c: Context) -> DataFrame:
    where = {"vintage_year": [1997, 1999], "sector_group": "Consumer"}
    return rounded(measures.sector_concentration(c.star, ["vintage_year"], where, AS_OF))


@query("M7_cumulative_nav", """
    SELECT date, round(sum(nv) OVER (ORDER BY date), 4) AS cumulative_nav FROM (
        SELECT date, sum(worth) AS nv FROM cal LEFT JOIN f ON effective = date GROUP BY date)""", covers="M7 W3 A13")
def cumulative(c: Context) -> DataFrame:
    return rounded(measures.cumulative_nav(c.star, as_of=AS_OF))


@query("M8_vintage_performance", grouped("vintage_year"), covers="M8 J10")
def vintage(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, ["vintage_year"], as_of=AS_OF))


@query("M9_sliced_measures", grouped("vintage_year", "vintage_year = 1998 AND sector_group = 'Industrials'"), covers="M9")
def sliced(c: Context) -> DataFrame:
    where = {"vintage_year": 1998, "sector_group": "Industrials"}
    return rounded(measures.measure(c.star, ["vintage_year"], where, AS_OF))


@query("M9_vintage_by_sector", grouped("vintage_year, sector_group"), covers="M9 J10")
def cross(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, ["vintage_year", "sector_group"], as_of=AS_OF))


@query("M10_scalar_measures", f"SELECT {ALL} FROM (SELECT {SUMS} FROM f WHERE sector_group = 'Consumer')")
def scalars(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, where={"sector_group": "Consumer"}, as_of=AS_OF))


@query("M11_sector_breakdown", """
    SELECT sector_group, round(sum(paid), 2) AS total_invested, round(sum(paid) / (SELECT sum(paid) FROM f WHERE vintage_year = 1996), 6) AS concentration
    FROM f WHERE vintage_year = 1996 GROUP BY 1""")
def breakdown(c: Context) -> DataFrame:
    df = measures.sector_concentration(c.star, where={"vintage_year": 1996}, as_of=AS_OF)
    return rounded(df).select("sector_group", "total_invested", "concentration")


@query("M13_cumulative_nav_at", """
    SELECT DATE '1999-06-30' AS date, round(sum(worth), 4) AS cumulative_nav, true AS in_calendar FROM f WHERE effective <= DATE '1999-06-30'
    UNION ALL SELECT DATE '2050-01-01', NULL, false""")
def cumulative_at(c: Context) -> DataFrame:
    days = [measures.cumulative_nav_at(c.star, d, as_of=AS_OF) for d in ("1999-06-30", "2050-01-01")]
    return rounded(days[0].unionByName(days[1]))


@query("M14_empty_or_blank", f"""
    SELECT 'no such vintage' AS slice, moic, matched_rows FROM (SELECT {ALL} FROM (SELECT {SUMS} FROM f WHERE vintage_year = 1900))
    UNION ALL SELECT 'no vintage', moic, matched_rows FROM (SELECT {ALL} FROM (SELECT {SUMS} FROM f WHERE vintage_year = 1995))""")
def empty_or_blank(c: Context) -> DataFrame:
    parts = [
        measures.measure(c.star, where={"vintage_year": y}, as_of=AS_OF).select(F.lit(name).alias("slice"), "moic", "matched_rows")
        for name, y in (("no such vintage", 1900), ("no vintage", 1995))
    ]
    return rounded(parts[0].unionByName(parts[1]))


@query("M15_kpi_row", """
    SELECT round(sum(paid), 2) AS total_invested, round(sum(worth), 4) AS nav, round(sum(worth) / sum(paid), 6) AS moic,
           round(pow(sum(worth) / sum(paid), 1 / (sum(cost_days) / 365.25 / sum(paid))) - 1, 6) AS irr FROM f""")
def kpis(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, as_of=AS_OF)).select("total_invested", "nav", "moic", "irr")


@query("M16_vintage_table", """
    SELECT vintage_year, round(sum(worth) / sum(paid), 6) AS moic,
           round(pow(sum(worth) / sum(paid), 1 / (sum(cost_days) / 365.25 / sum(paid))) - 1, 6) AS irr FROM f GROUP BY 1""", covers="M16 L1")
def vintage_table(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, ["vintage_year"], as_of=AS_OF)).select("vintage_year", "moic", "irr").orderBy("vintage_year")


@query("M17_sector_table", """
    SELECT sector_group, round(sum(worth) / sum(paid), 6) AS moic, round(sum(paid) / (SELECT sum(paid) FROM f), 6) AS concentration
    FROM f GROUP BY 1""", covers="M17 L3")
def sector_table(c: Context) -> DataFrame:
    df = rounded(measures.sector_concentration(c.star, as_of=AS_OF)).select("sector_group", "moic", "concentration")
    return df.orderBy(F.col("concentration").desc(), "sector_group")


@query("M18_cumulative_by_year", """
    SELECT year, round(sum(nv) OVER (ORDER BY year), 4) AS cumulative_nav FROM (
        SELECT CAST(year(date) AS INTEGER) AS year, sum(worth) AS nv FROM cal LEFT JOIN f ON effective = date GROUP BY 1)""", covers="M18 W3")
def by_year(c: Context) -> DataFrame:
    return rounded(measures.cumulative_nav(c.star, as_of=AS_OF, grain="year"))


@query("M7_cumulative_in_year", """
    SELECT date, round(cum, 4) AS cumulative_nav FROM (
        SELECT date, sum(nv) OVER (ORDER BY date) AS cum FROM (
            SELECT date, sum(worth) AS nv FROM cal LEFT JOIN (SELECT * FROM f WHERE sector_group = 'Consumer') ON effective = date GROUP BY date))
    WHERE year(date) = 1998""", covers="M7 M9 W3")
def cumulative_in_year(c: Context) -> DataFrame:
    return rounded(measures.cumulative_nav(c.star, {"year": 1998, "sector_group": "Consumer"}, AS_OF))


@query("M13_at_a_day_in_context", """
    SELECT DATE '1998-06-30' AS date, round(sum(worth), 4) AS cumulative_nav, true AS in_calendar FROM f
    WHERE effective <= DATE '1998-06-30' AND sector_group = 'Consumer'
    UNION ALL SELECT DATE '1999-06-30', NULL, true""", covers="M13 M9")
def cumulative_at_in_context(c: Context) -> DataFrame:
    where = {"year": 1998, "sector_group": "Consumer"}
    days = [measures.cumulative_nav_at(c.star, d, where, AS_OF) for d in ("1998-06-30", "1999-06-30")]
    return rounded(days[0].unionByName(days[1]))


@query("M18_cumulative_year_range", """
    SELECT year, round(cum, 4) AS cumulative_nav FROM (
        SELECT year, sum(nv) OVER (ORDER BY year) AS cum FROM (
            SELECT CAST(year(date) AS INTEGER) AS year, sum(worth) AS nv FROM cal LEFT JOIN f ON effective = date GROUP BY 1))
    WHERE year IN (1997, 1998)""", covers="M18 M9")
def by_year_range(c: Context) -> DataFrame:
    return rounded(measures.cumulative_nav(c.star, {"year": [1997, 1998]}, AS_OF, "year"))


@query("M9_blank_member", grouped("sector_group", "sector_group IS NULL OR sector_group = 'Mobility'"), covers="M9 M14")
def blank_member(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, ["sector_group"], {"sector_group": [None, "Mobility"]}, AS_OF))


@query("J10_star_join", grouped("country, investor_type"), covers="J10")
def star_join(c: Context) -> DataFrame:
    return rounded(measures.measure(c.star, ["country", "investor_type"], as_of=AS_OF))


@query("J11_exit_date_role", """
    SELECT CAST(year(exit_date) AS INTEGER) AS year, round(sum(paid), 2) AS total_invested, round(sum(worth), 4) AS nav, count(*) AS matched_rows
    FROM f GROUP BY 1""")
def exit_role(c: Context) -> DataFrame:
    df = measures.measure(c.star, ["year"], as_of=AS_OF, date_role="exit")
    return rounded(df).select("year", "total_invested", "nav", "matched_rows")
