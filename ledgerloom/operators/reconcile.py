"""Stage B: put the two feeds side by side, classify and resolve their conflicts, log and score them.

The feeds are aligned by one union and one aggregation on the canonical id. Partial aggregation runs before
the shuffle, so an id with a very large number of vendor rows never reaches a single task whole, which a
full outer join of the two feeds would do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.functions.scalars import any_of, days_apart, relative_gap, surrogate_key
from ledgerloom.sources.contracts import SOURCES

RECORD = "_record_id"


def align(feeds: dict[str, DataFrame], key: str, attrs: Sequence[str], order: str = RECORD) -> DataFrame:
    """One row per key with one struct column per feed, NULL where the feed lacks the key.

    A feed with several rows for a key is represented by the one with the smallest `order`.
    """
    parts = [
        df.select(F.col(key), F.lit(source).alias("_src"), F.col(order).alias("_ord"), F.struct(*attrs).alias("_row"))
        for source, df in feeds.items()
    ]
    union = reduce(DataFrame.unionByName, parts)
    picks = [F.min_by("_row", F.when(F.col("_src") == s, F.col("_ord"))).alias(s) for s in feeds]
    return union.groupBy(key).agg(*picks)


def best_row(sources: Sequence[str] = SOURCES) -> Column:
    """The whole row of the first feed that has the key."""
    return F.coalesce(*[F.col(s) for s in sources])


def best_source(sources: Sequence[str] = SOURCES) -> Column:
    """The name of the feed `best_row` takes the row from."""
    return F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources])


def best_value(attr: str, sources: Sequence[str] = SOURCES) -> Column:
    """The first non-null value of one attribute in feed order."""
    return F.coalesce(*[F.col(f"{s}.{attr}") for s in sources])


def attribution(sources: Sequence[str] = SOURCES) -> Column:
    """The feeds that contributed to the row."""
    return F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources]))


def thinned(aligned: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Aligned rows in which a feed that `best_row` does not take has NULL in all its fields. It still counts as having the
    key, so status, attribution and best row stay as they are, and joins behind move the best row's values alone. Not for
    entities whose feeds are compared afterwards."""
    out = {}
    for i, s in enumerate(sources[1:], 1):
        nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in aligned.schema[s].dataType])
        taken = any_of([F.col(earlier).isNotNull() for earlier in sources[:i]])
        out[s] = F.when(taken & F.col(s).isNotNull(), nothing).otherwise(F.col(s))
    return aligned.withColumns(out)


def in_all(sources: Sequence[str] = SOURCES) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in sources])


def status_of(flagged: Column, resolved: Column) -> Column:
    """Flagged outranks resolved outranks clean."""
    return F.when(flagged, v.FLAGGED).when(resolved, v.RESOLVED).otherwise(v.CLEAN)


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _two(sources: Sequence[str], attr: str) -> tuple[Column, Column]:
    return F.col(f"{sources[0]}.{attr}"), F.col(f"{sources[1]}.{attr}")


def conflict(kind: str, action: str, detail: Column, subtype: str | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("conflict_type"), F.lit(action).alias("resolution_action"),
        F.lit(subtype).cast("string").alias("existence_subtype"), detail.alias("conflict_detail"),
    )


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _versus(label: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(f"{label} "), _text(a), F.lit(" vs "), _text(b))


def _only_in(sources: Sequence[str] = SOURCES) -> Column:
    return F.concat(F.lit("in "), F.array_join(attribution(sources), ","), F.lit(" only"))


def _with_conflicts(df: DataFrame, candidates: list[tuple[Column, Column]]) -> DataFrame:
    found = F.array(*[F.when(_known(hit), row) for hit, row in candidates])
    return df.withColumn("conflicts", F.array_compact(found))


def reconcile_companies(aligned: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """In one feed only is a coverage gap, resolved with the feed at hand."""
    single = ~in_all(sources)
    out = aligned.withColumns(
        {"is_existence": single, "reconciliation_status": status_of(F.lit(False), single),
         "source_attribution": attribution(sources)}
    )
    return _with_conflicts(
        out, [(single, conflict(v.EXISTENCE_CONFLICT, v.AUTO_RESOLVED, _only_in(sources), v.COVERAGE_GAP))]
    )


def reconcile_rounds(
    aligned: DataFrame,
    sources: Sequence[str] = SOURCES,
    amount_tolerance: float = v.AMOUNT_TOLERANCE,
    days_tolerance: int = v.DAYS_TOLERANCE,
) -> DataFrame:
    """Dates over the tolerance resolve to the earliest, amounts over it are flagged, one feed only resolves.

    Expects `announced_date` (date) and `amount_raised` in the feed structs.
    """
    both = in_all(sources)
    day_a, day_b = _two(sources, "announced_date")
    amt_a, amt_b = _two(sources, "amount_raised")
    temporal = both & _known(days_apart(day_a, day_b) > days_tolerance)
    value = both & _known(relative_gap(amt_a, amt_b) > amount_tolerance)
    out = aligned.withColumns(
        {
            "is_temporal": temporal,
            "is_value": value,
            "is_existence": ~both,
            "announced_date": F.least(day_a, day_b),
            "amount_raised": F.coalesce(amt_a, amt_b),
            "reconciliation_status": status_of(value, temporal | ~both),
            "source_attribution": attribution(sources),
        }
    )
    return _with_conflicts(
        out,
        [
            (temporal, conflict(v.TEMPORAL_CONFLICT, v.AUTO_RESOLVED, _versus("announced", day_a, day_b))),
            (value, conflict(v.VALUE_CONFLICT, v.FLAGGED_FOR_REVIEW, _versus("amount_raised", amt_a, amt_b))),
            (~both, conflict(v.EXISTENCE_CONFLICT, v.AUTO_RESOLVED, _only_in(sources), v.COVERAGE_GAP)),
        ],
    )


def reconcile_investors(
    aligned: DataFrame, sources: Sequence[str] = SOURCES, tolerance: float = v.AMOUNT_TOLERANCE
) -> DataFrame:
    """Fund sizes further apart than the tolerance are flagged; the first feed's value is kept."""
    a, b = _two(sources, "fund_size")
    value = _known(relative_gap(a, b) > tolerance)
    out = aligned.withColumns(
        {"is_value": value, "fund_size": F.coalesce(a, b), "reconciliation_status": status_of(value, F.lit(False)),
         "source_attribution": attribution(sources)}
    )
    return _with_conflicts(
        out, [(value, conflict(v.VALUE_CONFLICT, v.FLAGGED_FOR_REVIEW, _versus("fund_size", a, b)))]
    )


def reconcile_investments(aligned: DataFrame, cover: DataFrame | None = None, sources: Sequence[str] = SOURCES) -> DataFrame:
    """An edge in one feed only is a genuine dispute when both feeds cover its company, else a coverage gap.

    Expects the canonical `company_id` beside the feed structs; `cover` is `identity.coverage`, or None if the company's
    `n_sources` is in the rows already. Only one-feed edges need the company's coverage, so edges in both feeds join on a
    key of their own, spread by edge id, instead of piling up under a large company.
    """
    both = in_all(sources)
    out = aligned
    if cover is not None:
        known = cover.select(F.col("canonical_id").alias("_cov"), "n_sources")
        lookup = F.when(both, F.concat(F.lit("\u0000"), F.col("canonical_id"))).otherwise(F.col("company_id"))
        out = aligned.withColumn("_lookup", lookup)
        out = out.join(known, out["_lookup"] == known["_cov"], "left").drop("_cov", "_lookup")
    genuine = ~both & _known(F.col("n_sources") >= 2)
    gap = ~both & (F.coalesce("n_sources", F.lit(0)) < 2)
    out = out.withColumns(
        {"is_genuine": genuine, "is_coverage": gap, "reconciliation_status": status_of(genuine, gap),
         "source_attribution": attribution(sources)}
    ).drop("n_sources")
    return _with_conflicts(
        out,
        [
            (F.col("is_genuine"), conflict(v.EXISTENCE_CONFLICT, v.FLAGGED_FOR_REVIEW, _only_in(sources), v.GENUINE)),
            (F.col("is_coverage"), conflict(v.EXISTENCE_CONFLICT, v.AUTO_RESOLVED, _only_in(sources), v.COVERAGE_GAP)),
        ],
    )


def conflict_log(reconciled: dict[str, DataFrame], resolved_at: str, key: str = "canonical_id") -> DataFrame:
    """One row per conflict over all entity types. Ids are hashes, so a rerun gives the same log."""
    parts = [
        df.filter(F.size("conflicts") > 0).select(
            F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"),
            F.col("source_attribution").alias("sources_involved"), F.explode("conflicts").alias("c"),
        )
        for kind, df in reconciled.items()
    ]
    log = reduce(DataFrame.unionByName, parts).select("entity_type", "entity_id", "sources_involved", "c.*")
    return log.withColumns(
        {
            "resolved_by": F.lit(v.RESOLVER),
            "resolved_date": F.to_timestamp(F.lit(resolved_at)),
            "reconciliation_id": surrogate_key("entity_type", "entity_id", "conflict_type", F.lit(resolved_at)),
        }
    )


def log_summary(log: DataFrame) -> DataFrame:
    """R14."""
    return log.groupBy("entity_type", "conflict_type", "resolution_action").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "entity_type", "conflict_type", "resolution_action"
    )


def expected_ledger(
    mapping: DataFrame,
    rounds: dict[str, DataFrame],
    investors: dict[str, DataFrame],
    edge_company: DataFrame,
    sources: Sequence[str] = SOURCES,
) -> DataFrame:
    """The conflicts the feeds must produce, worked out from the identity map outward.

    Starts from map rows and joins vendor rows in, where the log starts from vendor rows. `rounds` and
    `investors` are raw feeds keyed by vendor id; `edge_company` is (canonical_id, company_id).
    """
    a, b = sources
    spread = mapping.groupBy("entity_type", "canonical_id").agg(
        *[F.max(F.when(F.col("source_system") == s, F.col("vendor_id"))).alias(s) for s in sources]
    )

    def pairs(kind: str, feeds: dict[str, DataFrame], vendor_col: str, attrs: Sequence[str]) -> DataFrame:
        out = spread.filter((F.col("entity_type") == kind) & F.col(a).isNotNull() & F.col(b).isNotNull())
        for s in sources:
            side = feeds[s].select(F.col(vendor_col).alias(s), *[F.col(x).alias(f"{x}_{s}") for x in attrs])
            out = out.join(side, s, "inner")
        return out

    def rows(df: DataFrame, kind: str, hit: Column, conflict_type: str, subtype: Column, detail: Column) -> DataFrame:
        return df.filter(hit).select(
            F.lit(kind).alias("entity_type"), "canonical_id", F.lit(conflict_type).alias("conflict_type"),
            subtype.cast("string").alias("existence_subtype"), detail.alias("detail"),
        )

    none = F.lit(None)
    alone = F.col(a).isNull() | F.col(b).isNull()
    only = F.concat(F.lit("in "), F.when(F.col(a).isNotNull(), F.lit(a)).otherwise(F.lit(b)), F.lit(" only"))
    out = [
        rows(spread.filter(F.col("entity_type") == kind), kind, alone, v.EXISTENCE_CONFLICT, F.lit(v.COVERAGE_GAP), only)
        for kind in ("company", "funding_round")
    ]
    rp = pairs("funding_round", rounds, "vendor_round_id", ["announced_date", "amount_raised"])
    da, db = F.col(f"announced_date_{a}"), F.col(f"announced_date_{b}")
    ma, mb = F.col(f"amount_raised_{a}"), F.col(f"amount_raised_{b}")
    apart = F.abs(F.datediff(F.try_to_date(da, "yyyy-MM-dd"), F.try_to_date(db, "yyyy-MM-dd")))
    out.append(rows(rp, "funding_round", relative_gap(ma, mb) > v.AMOUNT_TOLERANCE, v.VALUE_CONFLICT,
                    none, _versus("amount_raised", ma, mb)))
    out.append(rows(rp, "funding_round", apart > v.DAYS_TOLERANCE, v.TEMPORAL_CONFLICT, none, _versus("announced", da, db)))
    ip = pairs("investor", investors, "vendor_investor_id", ["fund_size"])
    fa, fb = F.col(f"fund_size_{a}"), F.col(f"fund_size_{b}")
    out.append(rows(ip, "investor", (fa != 0) & (fb != 0) & (relative_gap(fa, fb) > v.AMOUNT_TOLERANCE),
                    v.VALUE_CONFLICT, none, _versus("fund_size", fa, fb)))
    seen = F.concat_ws(",", *[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources])
    covered = spread.filter(F.col("entity_type") == "company").select(
        F.col("canonical_id").alias("company_id"), (~alone).alias("_both"), seen.alias("_seen"))
    lone = spread.filter((F.col("entity_type") == "investment") & alone).join(edge_company, "canonical_id", "left")
    lone = lone.join(covered, "company_id", "left")
    out.append(rows(lone, "investment", F.lit(True), v.EXISTENCE_CONFLICT,
                    F.when(F.col("_both"), v.GENUINE).otherwise(v.COVERAGE_GAP),
                    F.concat(F.lit("edge "), only, F.lit("; company covered by "), F.coalesce("_seen", F.lit("")))))
    return reduce(DataFrame.unionByName, out)


def score_log(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Recall, precision and wrongly handled edges of the log against the ledger, as one row.

    One aggregation over the union of both sides replaces the intersect, the two distincts and the two joins.
    """
    sides = log.select(
        "entity_type", "entity_id", "conflict_type", F.lit(False).alias("expected"),
        F.lit(None).cast("string").alias("existence_subtype"), "resolution_action",
    ).unionByName(
        ledger.select(
            "entity_type", F.col("canonical_id").alias("entity_id"), "conflict_type", F.lit(True).alias("expected"),
            "existence_subtype", F.lit(None).cast("string").alias("resolution_action"),
        )
    )
    # Subtype and action need no set per key: booleans say which occurred.
    per = sides.groupBy("entity_type", "entity_id", "conflict_type").agg(
        F.bool_or("expected").alias("e"),
        F.bool_or(~F.col("expected")).alias("d"),
        F.bool_or(F.col("existence_subtype") == v.GENUINE).alias("genuine"),
        F.bool_or(F.col("existence_subtype") == v.COVERAGE_GAP).alias("gap"),
        F.count_if(F.col("resolution_action") != v.FLAGGED_FOR_REVIEW).alias("not_flagged"),
        F.count_if(F.col("resolution_action") != v.AUTO_RESOLVED).alias("not_auto"),
    )
    edge = F.col("entity_type") == "investment"
    totals = per.agg(
        F.count_if("e").alias("expected"),
        F.count_if("d").alias("detected"),
        F.count_if(F.col("e") & F.col("d")).alias("matched"),
        F.coalesce(F.sum(F.when(edge & F.col("genuine"), F.col("not_flagged"))), F.lit(0)).alias("genuine_mishandled"),
        F.coalesce(F.sum(F.when(edge & F.col("gap"), F.col("not_auto"))), F.lit(0)).alias("coverage_mishandled"),
    ).withColumns(
        {
            "recall": F.coalesce(F.try_divide("matched", "expected"), F.lit(0.0)),
            "precision": F.coalesce(F.try_divide("matched", "detected"), F.lit(0.0)),
        }
    )
    good = any_of([F.col("recall") < 1, F.col("precision") < 1, F.col("genuine_mishandled") > 0,
                   F.col("coverage_mishandled") > 0])
    return totals.withColumn("verdict", F.when(good, "REVIEW").otherwise("PASS"))


def rate_profile(company_map: DataFrame, reconciled_rounds: DataFrame, reconciled_edges: DataFrame) -> DataFrame:
    """Coverage counts, conflict rates over shared rounds and the split of one-feed edges, as one row."""
    a, b = SOURCES
    per = company_map.groupBy("canonical_id").agg(
        F.bool_or(F.col("source_system") == a).alias("a"), F.bool_or(F.col("source_system") == b).alias("b"))
    cover = per.agg(
        F.count_if("a").alias("companies_a"), F.count_if("b").alias("companies_b"),
        F.count_if(F.col("a") & F.col("b")).alias("companies_both"),
        F.count_if(F.col("a") != F.col("b")).alias("companies_single"),
        F.count(F.lit(1)).alias("companies_union"),
    )
    rounds = reconciled_rounds.filter(~F.col("is_existence")).agg(
        F.count(F.lit(1)).alias("shared_rounds"), F.count_if("is_value").alias("value_conflicts"),
        F.count_if("is_temporal").alias("temporal_conflicts"),
    )
    edges = reconciled_edges.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if("is_genuine").alias("genuine_disputes"),
        F.count_if("is_coverage").alias("coverage_gaps"),
    )
    more = [df.select(c).scalar().alias(c) for df in (rounds, edges) for c in df.columns]
    return cover.select("*", *more).withColumns(
        {
            "single_rate": F.try_divide("companies_single", "companies_union"),
            "value_rate": F.try_divide("value_conflicts", "shared_rounds"),
            "temporal_rate": F.try_divide("temporal_conflicts", "shared_rounds"),
            "genuine_rate": F.try_divide("genuine_disputes", "edges"),
            "gap_rate": F.try_divide("coverage_gaps", "edges"),
        }
    )
