"""Near-duplicate embeddings by random-hyperplane hashing (operator 8).

Equal vectors of a label form a class, and one of them goes on. Each class is hashed by the signs of random projections
into several tables; classes meet in a table if all bits of their code agree. How many bits a code has follows from the
number of classes, so that buckets stay small, and how many tables there are follows from the bits: two vectors with
the least cosine meet in some table but for a chance of `MISS`. A pair counts in the first table where it meets, and goes
on only if all its bits together agree as often as they must (again but for a chance below 1e-9). Then the cosine is
computed in double precision from the vectors. Bucket joins are ordinary joins, whose hot partitions Spark splits. A
vector with many links has that many rows in the join, since the result counts them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, are
linked with nothing and are their own component; vectors of unlike length are not compared; ids must be distinct and not
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.scratch import Scratch, keyed
from ledgerloom.llm.vectors import as_doubles, by_dim, matrix, usable

MISS = 1e-5
BUCKET = 8  # classes that a bucket would hold on average if they were spread evenly


def layout(classes: int, least: float) -> tuple[int, int, int]:
    """(bits of a code, tables, most differing bits) for so many classes and a least cosine."""
    agree = 1 - acos(least) / pi
    bits = min(60, max(6, ceil(log2(max(classes, 1) / BUCKET + 1))))
    tables = ceil(log(MISS) / log(1 - agree**bits))
    n = bits * tables
    return bits, tables, ceil(n * (1 - agree) + 6 * sqrt(n * agree * (1 - agree)) + 1)


def codes(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds codes, a list of `tables` numbers of `bits` bits."""
    schema = keyed(vectors, "id", "label int, dim int, codes array<bigint>")
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for dim, rows in by_dim(batch, 2):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                at = pa.array(rows)
                x = matrix(batch.column(2).take(at), dim)
                own = ((x @ planes[dim] >= 0).reshape(len(rows), tables, bits) * weights).sum(axis=2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([dim] * len(rows), pa.int32()),
                     pa.array(list(own), pa.list_(pa.int64()))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row. Scaled by the largest component first, so that no square overflows or vanishes."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    least: float = 0.98, seed: int = 11) -> DataFrame:
    """Key, n_links, component_id and kept of every vector."""
    scratch = Scratch(vectors.sparkSession, "vector-dedup")
    rows = as_doubles(vectors, key, vector, label).withColumnsRenamed({key: "id", vector: "v", label: "label"})
    rows = rows.withColumn("label", F.col("label").cast("int")).withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    marks = [F.xxhash64("v").alias("fa"), F.xxhash64(F.lit(1), F.col("v")).alias("fb")]
    # Adding zero turns a negative zero into a positive one, so that equal vectors hash alike.
    rows = scratch.keep(rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).select("id", "label", "v", "ok", *marks), "rows")
    classes = scratch.keep(
        rows.where("ok").groupBy("label", "fa", "fb").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = rows.where("ok").join(classes.select(F.col("rep").alias("id"), "size"), "id").select("id", "label", "v", "size")
    reps = scratch.keep(reps, "reps")
    bits, tables, most = layout(classes.count(), least)

    hashed = scratch.keep(codes(reps.select("id", "label", "v"), bits, tables, seed), "codes")
    placed = hashed.select("id", "label", "dim", "codes", F.posexplode("codes").alias("slot", "code"))
    left = placed.select("label", "dim", "slot", "code", F.col("id").alias("a"), F.col("codes").alias("ca"))
    right = placed.select("label", "dim", "slot", "code", F.col("id").alias("b"), F.col("codes").alias("cb"))

    @F.pandas_udf("boolean")
    def met(slot: pd.Series, ca: pd.Series, cb: pd.Series) -> pd.Series:
        x, y = np.stack(ca.to_numpy()), np.stack(cb.to_numpy())
        differ = np.bitwise_count(x ^ y)
        return pd.Series((np.argmax(differ == 0, axis=1) == slot.to_numpy()) & (differ.sum(axis=1) <= most))

    pairs = left.join(right, ["label", "dim", "slot", "code"]).where("a < b").where(met("slot", "ca", "cb")).select("a", "b")

    @F.pandas_udf("double")
    def cosine(va: pd.Series, vb: pd.Series) -> pd.Series:
        out = np.empty(len(va))
        lengths = va.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            out[at] = cosines(np.stack(va.to_numpy()[at]), np.stack(vb.to_numpy()[at]))
        return pd.Series(out)

    links = scratch.keep(
        scratch.keep(pairs, "pairs")
        .join(reps.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("size").alias("size_a")), "a")
        .join(reps.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("size").alias("size_b")), "b")
        .where(cosine("va", "vb") >= least).select("a", "b", "size_a", "size_b"), "links")
    scratch.drop("pairs", "codes")

    ends = links.select(F.col("a").alias("rep"), F.col("size_b").alias("n")).union(links.select("b", "size_a"))
    degree = ends.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = connected_components(links.select("a", "b"), scratch).withColumnRenamed("id", "rep")
    named = classes.join(degree, "rep", "left").join(groups, "rep", "left").select(
        "label", "fa", "fb", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("ok"))
    out = rows.select("id", "label", "fa", "fb", "ok").join(named, ["label", "fa", "fb", "ok"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (component == F.col("id")).alias("kept"))
