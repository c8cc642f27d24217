"""Vendor ids to canonical ids, and how many feeds cover an entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_canonical(
    df: DataFrame, mapping: DataFrame, entity_type: str, source: str, vendor_col: str, out: str = "canonical_id"
) -> DataFrame:
    """Look the vendor id up in the map of this entity type and source.

    The map grows with the feeds, so it is an ordinary equi-join: Catalyst broadcasts it only when its
    measured size is under the threshold. Unmapped rows get NULL.
    """
    ids = mapping.filter((F.col("entity_type") == entity_type) & (F.col("source_system") == source)).select(
        F.col("vendor_id").alias("_vendor_id"), F.col("canonical_id").alias(out)
    )
    return df.join(ids, df[vendor_col] == ids["_vendor_id"], "left").drop("_vendor_id")


def remap(
    df: DataFrame, mapping: DataFrame | Mapping[str, DataFrame], keys: dict[str, tuple[str, str]], source: str = "best_source",
    carried: Mapping[str, Sequence[str]] = {},
) -> DataFrame:
    """Foreign keys from vendor ids to canonical ids, by source and vendor id.

    `keys` maps the vendor column to (entity type, new column). Runs on one row per entity, after the best row
    is chosen, so each key is joined once and not once per feed. `mapping` may be given by entity type; `carried` names
    columns of a type's map that come along.
    """
    for vendor_col, (entity_type, out) in keys.items():
        ids = mapping[entity_type] if isinstance(mapping, Mapping) else mapping.filter(F.col("entity_type") == entity_type)
        ids = ids.select(
            F.col("vendor_id").alias("_vendor_id"), F.col("source_system").alias("_source"), F.col("canonical_id").alias(out),
            *carried.get(entity_type, ()))
        on = (df[vendor_col] == ids["_vendor_id"]) & (df[source] == ids["_source"])
        df = df.join(ids, on, "left").drop("_vendor_id", "_source")
    return df


def split_unmapped(df: DataFrame, id_col: str = "canonical_id") -> tuple[DataFrame, DataFrame]:
    """Rows with a canonical id, and the rest with the reason `unmapped`.

    Unmapped rows would never match in the alignment and each would look like an existence conflict.
    """
    unmapped = df.filter(F.col(id_col).isNull()).withColumn("_quarantine_reason", F.lit("unmapped"))
    return df.filter(F.col(id_col).isNotNull()), unmapped


def coverage(mapping: DataFrame, entity_type: str = "company") -> DataFrame:
    """R2/A3: distinct feeds per canonical entity."""
    return (
        mapping.filter(F.col("entity_type") == entity_type)
        .groupBy("canonical_id")
        .agg(F.count_distinct("source_system").alias("n_sources"))
    )
