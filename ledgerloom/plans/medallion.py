"""The stages in order: landing, validate, reconcile, bitemporal load, certify, star.

`Medallion` only declares the frames; nothing runs until a frame is used. `run` writes every stage to tables and
builds the next stage from what was written, which is how a scheduled job on a cluster uses it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.operators import quality, reconcile, star, temporal
from ledgerloom.operators.identity import attach_canonical, coverage, remap, split_unmapped
from ledgerloom.operators.validate import Gate, clean_row, repeated_keys, summarize, validate_feed
from ledgerloom.session import shuffles_dropped
from ledgerloom.sources.contracts import CONTRACTS, ENTITY_KEYS, FEEDS, INTERNAL, INTERNAL_ENTITIES, SHARED_ENTITIES, SOURCES
from ledgerloom.sources.landing import drop_path, looked_up, save_if_any

Hook = Callable[[str, DataFrame], DataFrame]


class Lazy(Mapping):
    """Frames by name, each built once, the first time it is asked for."""

    def __init__(self, names: Iterable, build: Callable):
        self._names = list(names)
        self._build = build
        self._done: dict = {}
        self._locks = {name: threading.Lock() for name in self._names}

    def __getitem__(self, name):
        with self._locks[name]:
            if name not in self._done:
                self._done[name] = self._build(name)
            return self._done[name]

    def built(self, name) -> bool:
        return name in self._done

    def build(self, names: Iterable | None = None, workers: int = 4) -> None:
        """Build the named frames, or all; small tables written side by side keep the executors busy."""
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(self.__getitem__, self._names if names is None else names))

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)


# Columns of the feeds kept by the bitemporal load, keys, and the names of the reference checks.
ROUND_COLUMNS = ["round_type", "currency", "instrument_type", "pre_money_valuation", "post_money_valuation"]
INVESTOR_COLUMNS = ["investor_type", "legal_name", "vintage_year", "geographic_focus", "sector_focus", "stage_focus"]
EDGE_COLUMNS = [
    "participation_amount", "is_lead", "board_seat_taken", "exit_date", "exit_type", "realised_return_multiple",
]
PASS_THROUGH = {
    "people": (["person_id", "name", "current_affiliations", "historical_affiliations", "education"], [], True),
    "deals": (["deal_id", "company_id", "stage", "stage_history", "analyst_owner", "partner_owner",
               "proposed_check_size", "target_round_id", "ic_date", "ic_outcome"], [], False),
    "documents": (["document_id", "document_type", "subject_company_ids", "author_person_id", "sensitivity_label"],
                  ["created_date"], False),
}
CONFORMED_KEYS = {
    "companies": "company_id", "funding_rounds": "round_id", "investors": "investor_id", "investments": "investment_id",
    "people": "person_id", "deals": "deal_id", "documents": "document_id",
}
REFERENCES = [
    ("RI funding_rounds.company_id -> companies", "funding_rounds", "company_id", "companies", "company_id"),
    ("RI investments.investor_id -> investors", "investments", "investor_id", "investors", "investor_id"),
    ("RI investments.round_id -> funding_rounds", "investments", "round_id", "funding_rounds", "round_id"),
    ("RI investments.company_id -> companies", "investments", "company_id", "companies", "company_id"),
    ("RI deals.company_id -> companies", "deals", "company_id", "companies", "company_id"),
    ("RI documents.author_person_id -> people", "documents", "author_person_id", "people", "person_id"),
]
AXES = ["effective_date", "ingestion_date", "reconciliation_status", "source_attribution"]
TEMPORAL_CHECKED = ("companies", "funding_rounds", "investments", "documents")


def iso_date(c: str) -> Column:
    return F.try_to_date(F.col(c), "yyyy-MM-dd").alias(c)

# Attributes each feed brings to the alignment, typed.
ALIGNED = {
    "companies": lambda: [
        "legal_name", "sector_taxonomy", "country", "description", iso_date("founded_date"), "_ingestion_ts"],
    "funding_rounds": lambda: [
        "vendor_company_id", iso_date("announced_date"), "amount_raised", *ROUND_COLUMNS, "_ingestion_ts"],
    "investors": lambda: [*INVESTOR_COLUMNS, "fund_size", "_ingestion_ts"],
    "investments": lambda: [
        "vendor_company_id", "vendor_round_id", "vendor_investor_id",
        *[iso_date(c) if c == "exit_date" else c for c in EDGE_COLUMNS], "_ingestion_ts"],
}
# vendor column -> (entity type, canonical column)
FOREIGN_KEYS = {
    "funding_rounds": {"vendor_company_id": ("company", "company_id")},
    "investments": {
        "vendor_company_id": ("company", "company_id"),
        "vendor_round_id": ("funding_round", "round_id"),
        "vendor_investor_id": ("investor", "investor_id"),
    },
}


class Medallion:
    """`provider` needs `feed(source, entity)` and `mapping(entity_type=None)`.

    A provider whose feeds can be read again at little cost also has `delivered(source, entity)`, the feed without lineage, and
    `stamp(frame, source, entity)`, which adds it. Its feeds are then not copied, and record ids, 64 characters of hash a row,
    are worked out behind the joins and not carried through them.

    `keep(name, frame)` may write a frame and give back what it read; by default frames stay lazy. If it has `drop(name)`, that
    is called for tables that nothing reads any more.
    """

    def __init__(
        self, provider, resolved_at: str, sector_groups: dict[str, list[str]] | None = None, keep: Hook | None = None
    ):
        self.provider = provider
        self.resolved_at = resolved_at
        self.sector_groups = sector_groups
        self.keep = keep or (lambda name, df: df)
        self._looked_up = looked_up if keep else (lambda df: df)
        self._long: set[str] = set()  # types with an identity map too long for a broadcast
        self._drop = getattr(keep, "drop", lambda name: None)
        #: The identity map by entity type. A table that needs one type does not wait for the lines behind the edges' ids.
        self.maps: Mapping[str, DataFrame] = Lazy([kind for kind, _ in ENTITY_KEYS.values()], self._map)
        #: Keys that occur more than once, by feed: (_k, _copies, _clean). Read from a table of their own, so their size is known.
        self.repeated: Mapping[tuple[str, str], DataFrame | None] = Lazy(FEEDS, self._repeated)
        self._delivered: Mapping[tuple[str, str], Gate] = Lazy(FEEDS, self._delivered_gate)
        self._aligned: Mapping[str, DataFrame] = Lazy(SHARED_ENTITIES, self._align)

    # --- landing ---

    @cached_property
    def landing(self) -> Mapping[tuple[str, str], DataFrame]:
        """The feeds as delivered: the key count, the gate and the ledger read them again, so they are written unless the
        provider can give them again."""
        if self._again:
            return Lazy(FEEDS, lambda f: self.provider.feed(*f))
        return Lazy(FEEDS, lambda f: self.keep(f"landing_{f[0]}_{f[1]}", self.provider.feed(*f)))

    @property
    def _again(self) -> bool:
        return hasattr(self.provider, "delivered") and hasattr(self.provider, "stamp")

    def _map(self, kind: str) -> DataFrame:
        kept = self.keep(f"vendor_id_mapping/entity_type={kind}", self.provider.mapping(kind).drop("entity_type"))
        ids = self._looked_up(kept)
        if ids is not kept:
            self._long.add(kind)
        return ids.select("canonical_id", F.lit(kind).alias("entity_type"), "source_system", "vendor_id")

    @property
    def mapping(self) -> DataFrame:
        """The identity map of all types. Keep it partitioned by source: most uses read one slice."""
        self.maps.build()
        return reduce(DataFrame.unionByName, self.maps.values())

    # --- stage A ---

    def _repeated(self, feed: tuple[str, str]) -> DataFrame | None:
        landed, contract = self.landing[feed], CONTRACTS[feed[1]]
        if contract.pk not in landed.columns:
            return None
        clean = clean_row(contract) if set(contract.non_null) <= set(landed.columns) else None
        return self.keep(f"stg_repeated_{feed[0]}_{feed[1]}", repeated_keys(landed, contract.pk, clean=clean))

    @cached_property
    def gates(self) -> Mapping[tuple[str, str], Gate]:
        """Tagged feeds; not written, as each use reads other columns and the repeated keys are at hand."""
        def build(feed):
            gate = self._delivered[feed]
            return replace(gate, tagged=self._stamped(gate.tagged, *feed)) if self._again else gate

        return Lazy(FEEDS, build)

    def _delivered_gate(self, feed: tuple[str, str]) -> Gate:
        """The gate of a feed as delivered, without lineage where the provider can add it later."""
        own, contract, landed = self.repeated[feed], CONTRACTS[feed[1]], self.landing[feed]
        if not self._again:
            return validate_feed(landed, contract, repeated=own)
        return validate_feed(self.provider.delivered(*feed), contract, lineage=False, repeated=own)

    def _stamped(self, df: DataFrame, source: str, entity: str) -> DataFrame:
        """Tagged rows of a feed with their lineage, its columns in front."""
        landed = self.landing[source, entity].columns
        return self.provider.stamp(df, source, entity).select(*landed, *[c for c in df.columns if c not in landed])

    def valid(self, source: str, entity: str) -> DataFrame:
        return self.gates[source, entity].valid

    def validation_summary(self) -> DataFrame:
        self.gates.build()
        return summarize(dict(self.gates.items()))

    # --- stage B ---

    def identified(self, source: str, entity: str) -> DataFrame:
        """Valid rows of a feed with their canonical id; unmapped rows left out."""
        return split_unmapped(self._attached(source, entity))[0]

    def unmapped(self, source: str, entity: str) -> DataFrame:
        return split_unmapped(self._attached(source, entity))[1]

    def _attached(self, source: str, entity: str) -> DataFrame:
        kind, _ = ENTITY_KEYS[entity]
        valid = self._delivered[source, entity].valid
        attached = attach_canonical(valid, self.maps[kind], kind, source, CONTRACTS[entity].pk)
        return self._stamped(attached, source, entity) if self._again else attached

    def _ordered(self, source: str, entity: str) -> tuple[DataFrame, str]:
        """`identified` with the column that picks among several rows of an id. Stamped record ids are hex of one length: their
        first 60 bits as a number sort the same, up to one pair of rows of an id in 2^60, and are an eighth as long."""
        df = self.identified(source, entity)
        if not self._again:
            return df, reconcile.RECORD
        return df.withColumn("_order", F.conv(F.substring(reconcile.RECORD, 1, 15), 16, 10).cast("bigint")), "_order"

    def _align(self, entity: str) -> DataFrame:
        """The feeds side by side. Of entities that refer to others, the long ones, the identified feeds and the result are
        written: what one join or aggregation has shuffled is then off the disk when the next one begins. The identified feeds
        go when they are aligned."""
        feeds, attrs = {s: self._ordered(s, entity) for s in SOURCES}, ALIGNED[entity]()
        order = feeds[SOURCES[0]][1]
        if entity not in FOREIGN_KEYS:
            return reconcile.align({s: f for s, (f, _) in feeds.items()}, "canonical_id", attrs, order)
        kept = {s: self.keep(f"identified_{s}_{entity}", f.select("canonical_id", order, *attrs)) for s, (f, _) in feeds.items()}
        out = self.keep(f"aligned_{entity}", reconcile.align(kept, "canonical_id", kept[SOURCES[0]].columns[2:], order))
        for s in SOURCES:
            self._drop(f"identified_{s}_{entity}")
        return out

    def aligned(self, entity: str, covered: bool = False, closed: bool = False) -> DataFrame:
        """One row per canonical id, foreign keys of the best row remapped; the vendors' own are left behind then. With
        `covered` the company's key brings its coverage along, as `n_sources`, and no join of its own is needed for it; with
        `closed`, for edges, the round's key brings the day the round was announced, as `_close`, and the joins move the best
        row's values alone."""
        df = self._aligned[entity]
        keys = FOREIGN_KEYS.get(entity)
        if not keys:
            return df
        if closed:
            df = reconcile.thinned(df)
        best = df.withColumn("_best", reconcile.best_row()).withColumns(
            {"best_source": reconcile.best_source(), **{c: F.col(f"_best.{c}") for c in keys}})
        best = best.withColumns({s: F.col(s).dropFields(*keys) for s in SOURCES})
        maps, carried = {kind: self.maps[kind] for kind, _ in keys.values()}, {}
        if covered:
            maps["company"] = maps["company"].join(coverage(maps["company"]), "canonical_id", "left")
            carried["company"] = ["n_sources"]
        if closed:
            maps["funding_round"] = maps["funding_round"].join(self._round_days("canonical_id"), "canonical_id", "left")
            carried["funding_round"] = ["_close"]
        # A map with columns from elsewhere is a join, which Spark takes for no larger than the map's files.
        maps = {kind: df.hint("merge") if kind in self._long else df for kind, df in maps.items()}
        return remap(best.drop("_best"), maps, keys, carried=carried).drop(*keys, "best_source")

    def _round_days(self, key: str) -> DataFrame:
        return self.lookups["funding_rounds"].select(F.col("round_id").alias(key), F.col("announced_date").alias("_close"))

    @cached_property
    def reconciled(self) -> Mapping[str, DataFrame]:
        return Lazy(SHARED_ENTITIES, lambda entity: self.keep(f"reconciled_{entity}", self._reconcile(entity)))

    def _reconcile(self, entity: str, closed: bool = False) -> DataFrame:
        return {
            "companies": reconcile.reconcile_companies,
            "funding_rounds": reconcile.reconcile_rounds,
            "investors": reconcile.reconcile_investors,
            "investments": reconcile.reconcile_investments,
        }[entity](self.aligned(entity, covered=entity == "investments", closed=closed))

    def _source(self, entity: str) -> DataFrame:
        """The reconciled rows a conformed table is made of: read back if they were written, else straight from the
        alignment, and then edges have met the day of their round on the way, as `_close`."""
        if self.reconciled.built(entity):
            return self.reconciled[entity]
        return self._reconcile(entity, closed=entity == "investments")

    @cached_property
    def log(self) -> DataFrame:
        self.maps.build()
        self.gates.build([f for f in FEEDS if f[1] in SHARED_ENTITIES])
        self.reconciled.build()
        by_kind = {ENTITY_KEYS[e][0]: df for e, df in self.reconciled.items()}
        return self.keep("reconciliation_log", reconcile.conflict_log(by_kind, self.resolved_at))

    @cached_property
    def ledger(self) -> DataFrame:
        edges = None
        for s in SOURCES:
            ids = self.landing[s, "investments"].select("vendor_investment_id", "vendor_company_id")
            ids = attach_canonical(ids, self.maps["investment"], "investment", s, "vendor_investment_id")
            ids = attach_canonical(ids, self.maps["company"], "company", s, "vendor_company_id", "company_id")
            part = ids.filter(F.col("canonical_id").isNotNull()).select("canonical_id", "company_id")
            edges = part if edges is None else edges.unionByName(part)
        edges = edges.groupBy("canonical_id").agg(F.min("company_id").alias("company_id"))
        return self.keep("expected_ledger", reconcile.expected_ledger(
            self.mapping,
            {s: self.landing[s, "funding_rounds"] for s in SOURCES},
            {s: self.landing[s, "investors"] for s in SOURCES},
            edges,
        ))

    # --- stage C ---

    def _best(self, entity: str, columns: list[str], extra: list[str]) -> DataFrame:
        key = ENTITY_KEYS[entity][1]
        best = self._source(entity).withColumn("_best", reconcile.best_row())
        extra = extra + [c for c in ("_close",) if c in best.columns]
        return best.select(
            F.col("canonical_id").alias(key), *[F.col(f"_best.{c}").alias(c) for c in columns], *extra,
            F.col("_best._ingestion_ts").alias("_ingestion_ts"), "reconciliation_status", "source_attribution",
        )

    def _companies(self) -> DataFrame:
        columns = ["legal_name", "sector_taxonomy", "country", "description", "founded_date"]
        df = temporal.with_axes(self._best("companies", columns, []), "founded_date")
        return temporal.envelope(df.select("company_id", *columns[:-1], *AXES))

    def _funding_rounds(self) -> DataFrame:
        best = self._best("funding_rounds", ROUND_COLUMNS, ["company_id", "announced_date", "amount_raised"])
        df = temporal.with_axes(best, "announced_date")
        return temporal.envelope(
            df.select("round_id", "company_id", "announced_date", "amount_raised", *ROUND_COLUMNS, *AXES))

    def _investors(self) -> DataFrame:
        df = temporal.with_axes(self._best("investors", INVESTOR_COLUMNS, ["fund_size"]))
        df = df.withColumn("vintage_year", F.col("vintage_year").cast("int"))
        return temporal.envelope_from_genesis(df.select("investor_id", *INVESTOR_COLUMNS, "fund_size", *AXES))

    def _investments(self) -> DataFrame:
        best = self._best("investments", EDGE_COLUMNS, ["investor_id", "round_id", "company_id"])
        if "_close" not in best.columns:
            best = best.join(self._round_days("round_id"), "round_id", "left")
        df = temporal.with_axes(best, "_close")
        return temporal.envelope(
            df.select("investment_id", "investor_id", "round_id", "company_id", *EDGE_COLUMNS, *AXES))

    @cached_property
    def conformed(self) -> Mapping[str, DataFrame]:
        def build(entity):
            if entity in INTERNAL_ENTITIES:
                columns, effective, genesis = PASS_THROUGH[entity]
                df = temporal.pass_through(self.valid(INTERNAL, entity), columns, *effective, genesis=genesis)
            else:
                df = getattr(self, f"_{entity}")()
            return self.keep(f"conformed_{entity}", df)

        return Lazy(CONFORMED_KEYS, build)

    @cached_property
    def lookups(self) -> Mapping[str, DataFrame]:
        """Conformed tables as others look rows up in them."""
        return Lazy(CONFORMED_KEYS, lambda entity: self._looked_up(self.conformed[entity]))

    def build(self) -> None:
        """Build every stage up to gold, the tables of a stage side by side."""
        self.maps.build()
        self.gates.build()
        self.reconciled.build()
        self.conformed.build()
        _ = self.log, self.dim_date, self.fact

    def _build_shared(self) -> None:
        """The stages the fact rests on."""
        self.maps.build()
        self.gates.build([f for f in FEEDS if f[1] in SHARED_ENTITIES])
        self.conformed.build(SHARED_ENTITIES)

    # --- stage D ---

    def assertions(self) -> DataFrame:
        """The 45 checks: 6 references, 7 x 5 per table, 4 soft temporal."""
        t = self.conformed
        parts = [quality.check_reference(n, t[c], ck, t[p], pk) for n, c, ck, p, pk in REFERENCES]
        for entity, key in CONFORMED_KEYS.items():
            if entity in ENTITY_KEYS:
                kind = ENTITY_KEYS[entity][0]
                expected = quality.expected_from_map(self.maps[kind], kind)
            else:
                expected = quality.expected_from_feed(self.valid(INTERNAL, entity))
            parts.append(quality.check_entity(entity, t[entity], key, expected, entity in TEMPORAL_CHECKED))
        return quality.report(parts)

    # --- stage E ---

    @cached_property
    def dim_company(self) -> DataFrame:
        return self.keep("gold_dim_company", star.company_dimension(self.conformed["companies"], self.sector_groups))

    @cached_property
    def dim_investor(self) -> DataFrame:
        return self.keep("gold_dim_investor", star.investor_dimension(self.conformed["investors"]))

    @cached_property
    def dim_date(self) -> DataFrame:
        t = self.conformed
        dates = [t["companies"].select("effective_date"), t["funding_rounds"].select("effective_date"),
                 t["investments"].select("effective_date"), t["investments"].select("exit_date")]
        return self.keep("gold_dim_date", star.date_dimension(dates))

    @cached_property
    def fact(self) -> DataFrame:
        self._build_shared()
        dims = self._looked_up(self.dim_company), self._looked_up(self.dim_investor)
        return self.keep("gold_fact_investment",
                         star.investment_fact(self.conformed["investments"], self.lookups["funding_rounds"], *dims))

    def gold_assertions(self) -> DataFrame:
        return star.certify(self.fact, self.dim_company, self.dim_investor, self.conformed["investments"])


def write_stages(spark: SparkSession, out: str) -> Hook:
    """A `keep` that writes each frame once under `out` and continues from what it reads back.

    The stages then share no lineage: a lost executor costs the stage at hand, not the chain.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        path = f"{out.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if name.startswith("vendor_id_mapping/"):
            writer = writer.partitionBy("source_system")
        with shuffles_dropped(spark):
            writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    keep.drop = lambda name: drop_path(spark, f"{out.rstrip('/')}/{name}")
    return keep


def run(spark: SparkSession, provider, out: str, resolved_at: str, sector_groups=None) -> Medallion:
    """All stages, written under `out`. Raises when a hard assertion fails, after its report is written."""
    keep = write_stages(spark, out)
    m = Medallion(provider, resolved_at, sector_groups, keep)
    m.build()
    keep("validation_summary", m.validation_summary())

    def set_apart(feed: tuple[str, str]) -> None:
        name = f"{feed[0]}_{feed[1]}"
        save_if_any(m.gates[feed].quarantine, f"{out}/stg_quarantine_{name}", m.gates[feed].suspects)
        if feed[1] in ENTITY_KEYS:
            save_if_any(m.unmapped(*feed), f"{out}/stg_unmapped_{name}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(set_apart, FEEDS))
    quality.enforce(keep("dq_assertions_report", m.assertions()))
    quality.enforce(keep("gold_dq_assertions_report", m.gold_assertions()))
    return m
