"""Measures on a hand-made star."""

from datetime import date

import pytest

from ledgerloom.operators import measures
from ledgerloom.operators.measures import Star

AS_OF = "2022-01-01"
D = date


@pytest.fixture(scope="module")
def star(spark):
    fact = spark.createDataFrame(
        [
            ("c1", "i1", 100.0, False, None, None, D(2020, 1, 1)),
            ("c1", "i1", 50.0, True, D(2021, 1, 1), 2.0, D(2020, 1, 1)),
            ("c2", "i2", 80.0, True, D(2021, 7, 1), 0.0, D(2020, 7, 1)),
            ("c2", "i2", None, True, D(2021, 7, 1), 3.0, D(2020, 7, 1)),
            ("c3", "i1", 10.0, True, D(2021, 1, 1), None, D(2020, 1, 5)),
            (None, "i1", 40.0, False, None, None, D(2020, 3, 1)),
        ],
        "company_sk string, investor_sk string, participation_amount double, is_realized boolean, exit_date date, "
        "realised_return_multiple double, effective_date date",
    ).selectExpr("*", "cast(date_format(effective_date, 'yyyyMMdd') as int) effective_date_sk",
                 "cast(date_format(exit_date, 'yyyyMMdd') as int) exit_date_sk")
    company = spark.createDataFrame([("c1", "Tech"), ("c2", "Food"), ("c3", None)], "company_sk string, sector_group string")
    investor = spark.createDataFrame([("i1", 2018), ("i2", 2019), ("i3", 2020)], "investor_sk string, vintage_year int")
    dates = spark.sql("select explode(sequence(date'2020-01-01', date'2022-07-01')) date").selectExpr(
        "date", "cast(date_format(date, 'yyyyMMdd') as int) date_sk", "year(date) year")
    return Star(fact, company, investor, dates)


def one(df):
    return df.first().asDict()


def test_totals(star):
    row = one(measures.measure(star, as_of=AS_OF))
    assert row["total_invested"] == 280.0
    # open 100 and 40, realised 50 x 2, write-off 0, unknown multiple and unknown amount nothing
    assert row["nav"] == 240.0
    assert row["moic"] == pytest.approx(240 / 280)
    cost_days = 100 * 731 + 50 * 366 + 80 * 365 + 10 * 362 + 40 * 671
    assert row["years_held"] == pytest.approx(cost_days / 365.25 / 280)
    assert row["irr"] == pytest.approx((240 / 280) ** (1 / row["years_held"]) - 1)
    assert row["matched_rows"] == 6


def test_a_total_loss_is_minus_one(star):
    row = one(measures.measure(star, where={"vintage_year": 2019}, as_of=AS_OF))
    assert (row["moic"], row["irr"], row["matched_rows"]) == (0.0, -1.0, 2)


def test_empty_is_told_from_blank(star):
    empty = one(measures.measure(star, where={"vintage_year": 1900}, as_of=AS_OF))
    assert empty["matched_rows"] == 0 and empty["moic"] is None and empty["total_invested"] is None
    same_day = one(measures.measure(star, where={"vintage_year": 2018, "sector_group": "Tech"}, as_of="2020-01-01"))
    assert same_day["matched_rows"] == 2 and same_day["irr"] is not None


def test_unmatched_members_stay_in_totals(star):
    rows = {r["sector_group"]: r for r in measures.measure(star, ["sector_group"], as_of=AS_OF).collect()}
    assert rows[None]["total_invested"] == 50.0
    assert sum(r["total_invested"] for r in rows.values()) == 280.0


def test_pooled_is_not_the_mean_of_groups(star):
    groups = [r["moic"] for r in measures.measure(star, ["vintage_year"], as_of=AS_OF).collect()]
    assert one(measures.measure(star, as_of=AS_OF))["moic"] != pytest.approx(sum(groups) / len(groups))


def test_concentration_drops_only_the_sector_filter(star):
    rows = measures.sector_concentration(star, where={"sector_group": "Tech", "vintage_year": 2018}, as_of=AS_OF).collect()
    assert [(r["sector_group"], r["concentration"]) for r in rows] == [("Tech", 150 / 200)]
    full = measures.sector_concentration(star, ["vintage_year"], as_of=AS_OF).collect()
    for year in (2018, 2019):
        assert sum(r["concentration"] for r in full if r["vintage_year"] == year) == pytest.approx(1)


def test_cumulative(star):
    by_day = {r["date"]: r["cumulative_nav"] for r in measures.cumulative_nav(star, as_of=AS_OF).collect()}
    assert by_day[D(2020, 1, 1)] == 200.0 and by_day[D(2020, 2, 29)] == 200.0 and by_day[D(2020, 3, 1)] == 240.0
    assert by_day[D(2022, 7, 1)] == 240.0
    by_year = {r["year"]: r["cumulative_nav"] for r in measures.cumulative_nav(star, as_of=AS_OF, grain="year").collect()}
    assert by_year == {2020: 240.0, 2021: 240.0, 2022: 240.0}
    tech = measures.cumulative_nav(star, {"sector_group": "Tech"}, AS_OF, "year").collect()
    assert {r["cumulative_nav"] for r in tech} == {200.0}


def test_cumulative_at_a_day(star):
    row = one(measures.cumulative_nav_at(star, "2020-02-01", as_of=AS_OF))
    assert (row["cumulative_nav"], row["in_calendar"]) == (200.0, True)
    row = one(measures.cumulative_nav_at(star, "2050-01-01", as_of=AS_OF))
    assert (row["cumulative_nav"], row["in_calendar"]) == (None, False)


def test_conditions_on_dates_do_not_cut_earlier_facts(star):
    in_2021 = {r["year"]: r["cumulative_nav"] for r in measures.cumulative_nav(star, {"year": [2021, 2022]}, AS_OF, "year").collect()}
    assert in_2021 == {2021: 240.0, 2022: 240.0}
    days = measures.cumulative_nav(star, {"year": 2021, "sector_group": "Tech"}, AS_OF).collect()
    assert len(days) == 365 and {r["cumulative_nav"] for r in days} == {200.0}
    row = one(measures.cumulative_nav_at(star, "2021-06-01", {"year": 2021}, AS_OF))
    assert (row["cumulative_nav"], row["in_calendar"]) == (240.0, True)
    row = one(measures.cumulative_nav_at(star, "2021-06-01", {"year": 2020}, AS_OF))
    assert (row["cumulative_nav"], row["in_calendar"]) == (None, True)


def test_blank_member(star):
    """Facts whose company has no sector, and facts without a company, are the blank member."""
    assert one(measures.measure(star, where={"sector_group": None}, as_of=AS_OF))["total_invested"] == 50.0
    assert one(measures.measure(star, where={"sector_group": [None, "Tech"]}, as_of=AS_OF))["total_invested"] == 200.0
    shares = measures.sector_concentration(star, where={"sector_group": None}, as_of=AS_OF).collect()
    assert [(r["sector_group"], r["total_invested"]) for r in shares] == [(None, 50.0)]


def test_exit_date_role(star):
    rows = {r["year"]: r["matched_rows"] for r in measures.measure(star, ["year"], as_of=AS_OF, date_role="exit").collect()}
    assert rows == {2021: 4, None: 2}


def test_members(star):
    assert [r[0] for r in measures.members(star).collect()] == ["Food", "Tech"]


def test_unknown_column(star):
    with pytest.raises(KeyError):
        measures.measure(star, ["nothing"], as_of=AS_OF)
