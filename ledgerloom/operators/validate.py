"""Stage A: tag each feed row with the reasons it fails, split valid from quarantined (Q1-Q7)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.functions.scalars import blank
from ledgerloom.sources.contracts import FeedContract


@dataclass
class Gate:
    """A checked feed. `tagged` holds every input row once, with `_quarantine_reason` and `_valid`. `suspects`, if given, has
    a row if and only if `quarantine` has one, and `counts` has one row of `rows_in`, `valid` and `quarantined`; both are
    known without joining the feed."""

    tagged: DataFrame
    missing: list[str]
    suspects: DataFrame | None = None
    counts: DataFrame | None = None

    @property
    def valid(self) -> DataFrame:
        return self.tagged.filter("_valid")

    @property
    def quarantine(self) -> DataFrame:
        return self.tagged.filter("not _valid")


def repeated_keys(df: DataFrame, key: str, out: str = "_copies", clean: Column | None = None) -> DataFrame:
    """Keys that occur more than once with their number of rows, NULL included; counted before the shuffle. `_clean` is the
    number of those rows for which `clean` holds, if it is given."""
    counts = [F.count(F.lit(1)).alias(out)] + ([] if clean is None else [F.count_if(clean).alias("_clean")])
    return df.groupBy(F.col(key).alias("_k")).agg(*counts).filter(F.col(out) > 1)


def with_key_count(df: DataFrame, key: str, out: str = "_copies", repeated: DataFrame | None = None) -> DataFrame:
    """How many rows share the key, NULL keys counted together.

    Only repeated keys come back to the rows, so a key holding a third of the feed is one row in this join.
    A window over the key would put all its rows in one task. Pass `repeated` read from a written table and
    its size is known when the join is planned: under the broadcast threshold the feed is then tagged in
    place and never shuffled. Otherwise AQE decides, and splits the rows of a hot key over many tasks. The number of NULL
    keys is then read aside, so that the join is a plain equality and a next one on the key finds the rows in place.
    """
    if repeated is not None:
        nulls = repeated.filter("_k is null").agg(F.max(out)).scalar()
        known = repeated.filter("_k is not null").select("_k", out)
        tagged = df.join(known, df[key] == known["_k"], "left").drop("_k")
        copies = F.when(F.col(key).isNull(), nulls).otherwise(F.col(out))
        return tagged.withColumn(out, F.coalesce(copies, F.lit(1).cast("bigint")))
    repeated = repeated_keys(df, key, out)
    return (
        df.join(repeated, df[key].eqNullSafe(repeated["_k"]), "left")
        .drop("_k")
        .withColumn(out, F.coalesce(out, F.lit(1).cast("bigint")))
    )


def _tag(df: DataFrame, reasons: list[Column]) -> DataFrame:
    # concat_ws skips the NULLs left by reasons that do not apply.
    text = F.concat_ws("", *reasons)
    return df.withColumn("_quarantine_reason", F.when(text != "", text)).withColumn(
        "_valid", F.col("_quarantine_reason").isNull()
    )


def row_reasons(contract: FeedContract) -> list[Column]:
    """The reasons of Q1 that a row shows by itself."""
    reasons = [F.when(blank(c), F.lit(f"null:{c};")) for c in contract.non_null]
    return [*reasons, F.when(F.col(contract.pk).isNull(), F.lit(f"null_pk:{contract.pk};"))]


def clean_row(contract: FeedContract) -> Column:
    """Whether a row shows no reason by itself; its key may still be repeated."""
    return F.coalesce(*row_reasons(contract)).isNull()


def validate_feed(
    df: DataFrame, contract: FeedContract, lineage: bool = True, repeated: DataFrame | None = None
) -> Gate:
    """Q1: required columns, non-null columns, key present and unique.

    A missing required column fails the whole feed; otherwise each row gets its own reasons. `repeated` are the
    feed's repeated keys read from a written table, see `with_key_count`. With `_clean` in it the rows are counted without
    a join: valid are the clean rows less those under a repeated key.
    """
    need = set(contract.required) | (set(v.LINEAGE_REQUIRED) if lineage else set())
    missing = sorted(need - set(df.columns))
    if missing:
        reason = F.lit("missing_columns: " + ", ".join(missing))
        return Gate(df.withColumns({"_quarantine_reason": reason, "_valid": F.lit(False)}), missing)
    reasons = row_reasons(contract)
    suspects = counts = None
    if repeated is not None:
        suspects = repeated.select(F.lit(1).alias("one")).unionByName(
            df.filter(~clean_row(contract)).select(F.lit(1).alias("one")))
        if "_clean" in repeated.columns:
            under = F.coalesce(repeated.agg(F.sum("_clean")).scalar(), F.lit(0).cast("bigint"))
            counts = df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(clean_row(contract)).alias("_clean")).select(
                "rows_in", (F.col("_clean") - under).alias("valid"), (F.col("rows_in") - F.col("_clean") + under).alias("quarantined"))
    reasons.append(F.when(F.col("_copies") > 1, F.lit(f"dup_pk:{contract.pk};")))
    counted = with_key_count(df, contract.pk, repeated=repeated)
    return Gate(_tag(counted, reasons).drop("_copies"), [], suspects, counts)


def empty_like(df: DataFrame) -> DataFrame:
    """P10: no rows, same columns."""
    return df.limit(0)


def check_domains(df: DataFrame, contract: FeedContract) -> Gate:
    """Q2: enumerations, minimum of zero, parsable dates and numbers. NULL passes; presence is Q1's matter."""
    have = set(df.columns)
    reasons = [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(allowed), F.lit(f"domain:{c};"))
        for c, allowed in contract.enums.items() if c in have
    ]
    for c in contract.minimum_zero:
        if c in have:
            number = F.col(c).try_cast("double")
            reasons.append(F.when(F.col(c).isNotNull() & number.isNull(), F.lit(f"type:{c};")))
            reasons.append(F.when(number < 0, F.lit(f"minimum:{c};")))
    for c in contract.dates:
        if c in have:
            text = F.col(c).cast("string")
            reasons.append(F.when(text.isNotNull() & F.try_to_date(text, "yyyy-MM-dd").isNull(), F.lit(f"type:{c};")))
    return Gate(_tag(df, reasons or [F.lit(None).cast("string")]), [])


def check_references(df: DataFrame, fk: str, parent: DataFrame, parent_key: str) -> Gate:
    """Q3: a non-null foreign key must exist in the parent feed."""
    keys = parent.select(F.col(parent_key).alias("_p")).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(keys, df[fk] == keys["_p"], "left")
    orphan = F.when(F.col(fk).isNotNull() & F.col("_hit").isNull(), F.lit(f"orphan:{fk};"))
    return Gate(_tag(joined, [orphan]).drop("_p", "_hit"), [])


def freshness(feeds: dict[tuple[str, str], DataFrame], as_of: str, max_age_days: int) -> DataFrame:
    """Q4: age of the newest row of each feed against `as_of`."""
    parts = [
        df.agg(F.max(F.col("_ingestion_ts").try_cast("timestamp")).alias("newest")).select(
            F.lit(source).alias("source"), F.lit(entity).alias("entity"), "newest"
        )
        for (source, entity), df in feeds.items()
    ]
    age = F.datediff(F.lit(as_of).cast("date"), F.col("newest").cast("date"))
    return reduce(DataFrame.unionByName, parts).select(
        "source", "entity", F.date_format("newest", "yyyy-MM-dd").alias("newest"), age.alias("age_days"),
        F.when(age.isNull(), "EMPTY").when(age > max_age_days, "STALE").otherwise("FRESH").alias("status"),
    )


def summarize(gates: dict[tuple[str, str], Gate]) -> DataFrame:
    """Q5: rows in, valid and quarantined for each feed, one aggregate per feed; from the gate's counts where it has them."""
    parts = []
    for (source, entity), gate in gates.items():
        counts = gate.tagged.agg(
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(F.col("_valid")).alias("valid"),
            F.count_if(~F.col("_valid")).alias("quarantined"),
        ) if gate.counts is None else gate.counts
        status = (
            F.lit("STRUCTURAL FAIL") if gate.missing
            else F.when(F.col("quarantined") == 0, "OK").otherwise("QUARANTINED ROWS")
        )
        parts.append(
            counts.select(F.lit(source).alias("source"), F.lit(entity).alias("entity"), "rows_in", "valid",
                          "quarantined", status.alias("status"))
        )
    return reduce(DataFrame.unionByName, parts)


def check_lineage(df: DataFrame, source: str) -> DataFrame:
    """Q7: lineage columns present and the source stamp constant; one row with the counts."""
    missing = [c for c in v.LINEAGE_REQUIRED if c not in df.columns]
    wrong = F.lit(None).cast("bigint")
    if "_source_system" not in missing:
        wrong = F.count_if(~F.col("_source_system").eqNullSafe(F.lit(source)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), wrong.alias("wrong_source")).select(
        F.lit(source).alias("source"), "n_rows", "wrong_source", F.lit(len(missing)).cast("bigint").alias("missing_columns")
    )
