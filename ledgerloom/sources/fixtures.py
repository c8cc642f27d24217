"""Projections of the given tables onto the domain feeds.

Plain arithmetic on keys, so the same rows can be derived in SQL. Money is worked out in whole cents.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.sources.landing import stamp_lineage

AS_OF = "2002-01-01"
INGESTED = "2002-01-01T00:00:00+00:00"
BATCH = "batch-0001"
# Market segment to sector group, event type to deal stage, affiliation roles.
SEGMENT_GROUPS = {
    "AUTOMOBILE": "Mobility", "BUILDING": "Industrials", "FURNITURE": "Consumer", "HOUSEHOLD": "Consumer",
    "MACHINERY": "Industrials",
}
EVENT_STAGES = {
    "signup": "sourcing", "view": "screening", "click": "due_diligence", "purchase": "closed_won", "error": "passed",
}
ROLES = ["founder", "ceo", "board", "advisor"]
INVESTOR_TYPE_BY_MOD = [
    "angel", "accelerator", "strategic", "vc_fund", "pe_fund", "corporate_vc", "family_office", "sovereign_fund",
    "vc_fund",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index + 1).cast("int"))


def tag(prefix: str, *parts: Column | str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *parts)


def cents(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("bigint")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


class Fixtures:
    """Feeds, identity map and internal entities over one data folder. Every method is lazy.

    `keep(name, frame)` may write a frame and give back what it read. The edges are kept: both feeds project them, and the
    join they rest on then moves the lines once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, keep: Callable[[str, DataFrame], DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.keep = keep
        self._edges: DataFrame | None = None
        self._lock = threading.Lock()

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def texts(self) -> DataFrame:
        """The documents, read by all cores: tokenising is the costly part."""
        return self.t("documents").select("doc_id", "text")

    # --- canonical bases: one row per real-world entity, with coverage by feed -------------------

    def company_base(self) -> DataFrame:
        k = F.col("c_custkey")
        nation = self.t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
        return self.t("customer").join(nation, "c_nationkey", "left").select(
            k.alias("ck"),
            tag("C", k.cast("string")).alias("company_id"),
            F.col("c_name").alias("legal_name"),
            F.when(k % 29 == 0, F.array().cast("array<string>"))
            .when(k % 5 == 0, F.array("c_mktsegment", F.lit("BUILDING")))
            .otherwise(F.array("c_mktsegment"))
            .alias("tags"),
            "country",
            F.date_add(F.lit("1994-06-01").cast("date"), (k * 37 % 900).cast("int")).alias("founded"),
            (k % 8 != 0).alias("in_a"),
            (k % 6 != 1).alias("in_b"),
        )

    def round_base(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        day = F.col("o_orderdate").cast("date")
        amount = cents("o_totalprice")
        return self.t("orders").select(
            k.alias("ok"),
            c.alias("ck"),
            day.alias("order_date"),
            tag("R", k.cast("string")).alias("round_id"),
            (c % 8 != 0).alias("in_a"),
            (c % 6 != 1).alias("in_b"),
            F.date_add(day, (k * 7 % 37).cast("int")).alias("announced_a"),
            F.date_add(day, (k * 13 % 71 + 10).cast("int")).alias("announced_b"),
            (F.when(k % 7 == 0, F.expr("(cast(round(o_totalprice * 100) as bigint) * 120 + 50) div 100")).otherwise(amount) / 100)
            .alias("amount_a"),
            (F.when(k % 11 == 0, F.expr("(cast(round(o_totalprice * 100) as bigint) * 85 + 50) div 100")).otherwise(amount) / 100)
            .alias("amount_b"),
            pick(v.ROUND_TYPES, k % 9).alias("round_type"),
            pick(v.INSTRUMENT_TYPES, k % 3).alias("instrument_type"),
            pick(v.CURRENCIES, c % 3).alias("currency"),
            F.when(k % 5 != 0, amount * 3 / 100).alias("pre_money_valuation"),
            F.when(k % 5 != 0, amount * 4 / 100).alias("post_money_valuation"),
            F.when(k % 6 == 0, F.array().cast("array<string>"))
            .otherwise(F.array(tag("I", (k % 10).cast("string")))).alias("leads"),
        )

    def investor_base(self) -> DataFrame:
        k = F.col("s_suppkey")
        nation = self.t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
        size = cents(F.abs("s_acctbal")) * 100
        fund = k % 9 >= 3
        return self.t("supplier").join(nation, "s_nationkey", "left").select(
            k.alias("sk"),
            tag("I", k.cast("string")).alias("investor_id"),
            pick(INVESTOR_TYPE_BY_MOD, k % 9).alias("investor_type"),
            F.col("s_name").alias("legal_name"),
            F.when(fund, (k % 7 + 1995).cast("int")).alias("vintage_year"),
            F.when(fund, size.cast("double")).alias("fund_size_a"),
            F.when(fund, F.when(k % 7 == 3, size * 125 / 100).otherwise(size.cast("double"))).alias("fund_size_b"),
            F.array("country").alias("geographic_focus"),
            F.array(F.lit("Consumer")).alias("sector_focus"),
            F.array(pick(v.STAGE_FOCUS, k % 5)).alias("stage_focus"),
        )

    def edge_base(self) -> DataFrame:
        """One row per lineitem row; (ok, ln) repeats, which the gate must catch."""
        ok, ln, pk, sk = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
        orders = self.t("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("ck"),
            F.col("o_orderdate").cast("date").alias("order_date"),
        )
        realised = F.col("l_returnflag") == "R"
        both = (F.col("ck") % 8 != 0) & (F.col("ck") % 6 != 1)
        drop_a = both & ((ok * 3 + ln) % 10 == 3)
        drop_b = both & ((ok + 5 * ln) % 12 == 5)
        lines = self.t("lineitem")
        return lines.join(orders, "l_orderkey").select(
            ok.alias("ok"), ln.alias("ln"), pk.alias("pk"), sk.alias("sk"), "ck", "order_date",
            tag("V", ok.cast("string"), ln.cast("string")).alias("investment_id"),
            ((F.col("ck") % 8 != 0) & ~drop_a).alias("in_a"),
            ((F.col("ck") % 6 != 1) & ~drop_b).alias("in_b"),
            F.col("l_extendedprice").alias("amount"),
            (ln == 1).alias("is_lead"),
            (pk % 4 == 0).alias("board_seat_taken"),
            F.when(realised, F.date_add("order_date", (pk % 700 + 900).cast("int"))).alias("exit_date"),
            F.when(realised, pick(v.EXIT_TYPES, pk % 4)).alias("exit_type"),
            F.when(realised & (pk % 23 != 0), F.when(pk % 4 == 3, F.lit(0.0)).otherwise(((sk * 31 + pk * 17) % 300 + 20) / 100))
            .alias("multiple"),
        )

    def edges(self) -> DataFrame:
        """The rows of `edge_base` that are in a feed, written once where frames are kept."""
        if self.keep is None:
            return self.edge_base()
        with self._lock:
            if self._edges is None:
                base = self.edge_base().filter(F.col("in_a") | F.col("in_b")).drop("investment_id", "order_date")
                self._edges = self.keep("edge_base", base)
            return self._edges

    # --- landing feeds --------------------------------------------------------------------------

    def feed(self, source: str, entity: str) -> DataFrame:
        return self.stamp(self.delivered(source, entity), source, entity)

    def delivered(self, source: str, entity: str) -> DataFrame:
        """The feed without its lineage columns; its first column is its key."""
        return getattr(self, entity)(source) if source != "internal" else getattr(self, entity)()

    def stamp(self, df: DataFrame, source: str, entity: str) -> DataFrame:
        """Lineage columns on `delivered` rows, or on such rows with more columns behind: the record id hashes the key."""
        return stamp_lineage(df, source, f"{source}/{entity}.parquet", INGESTED, BATCH, key=[df.columns[0]])

    def companies(self, source: str) -> DataFrame:
        side, pre = ("a", "A") if source == "feed_a" else ("b", "B")
        name = F.col("legal_name")
        if side == "b":
            name = F.when(F.col("ck") % 4 == 0, F.concat(name, F.lit(" Inc"))).otherwise(name)
        return self.company_base().filter(f"in_{side}").select(
            tag(f"{pre}-C", F.col("ck").cast("string")).alias("vendor_company_id"),
            name.alias("legal_name"),
            F.to_json("tags").alias("sector_taxonomy"),
            iso(F.col("founded")).alias("founded_date"),
            "country",
            F.concat(F.lit("Company "), F.col("ck").cast("string")).alias("description"),
        )

    def funding_rounds(self, source: str) -> DataFrame:
        side, pre = ("a", "A") if source == "feed_a" else ("b", "B")
        return self.round_base().filter(f"in_{side}").select(
            tag(f"{pre}-R", F.col("ok").cast("string")).alias("vendor_round_id"),
            tag(f"{pre}-C", F.col("ck").cast("string")).alias("vendor_company_id"),
            "round_type",
            iso(F.col(f"announced_{side}")).alias("announced_date"),
            F.col(f"amount_{side}").alias("amount_raised"),
            "currency", "pre_money_valuation", "post_money_valuation", "instrument_type",
            F.to_json("leads").alias("lead_investor_vendor_ids"),
        )

    def investors(self, source: str) -> DataFrame:
        side, pre = ("a", "A") if source == "feed_a" else ("b", "B")
        return self.investor_base().select(
            tag(f"{pre}-I", F.col("sk").cast("string")).alias("vendor_investor_id"),
            "investor_type", "legal_name",
            F.col("vintage_year").cast("double").alias("vintage_year"),
            F.col(f"fund_size_{side}").alias("fund_size"),
            F.to_json("geographic_focus").alias("geographic_focus"),
            F.to_json("sector_focus").alias("sector_focus"),
            F.to_json("stage_focus").alias("stage_focus"),
        )

    def investments(self, source: str) -> DataFrame:
        side, pre, hide = ("a", "A", 3) if source == "feed_a" else ("b", "B", 6)
        return self.edges().filter(f"in_{side}").select(
            tag(f"{pre}-V", F.col("ok").cast("string"), F.col("ln").cast("string")).alias("vendor_investment_id"),
            tag(f"{pre}-I", F.col("sk").cast("string")).alias("vendor_investor_id"),
            tag(f"{pre}-R", F.col("ok").cast("string")).alias("vendor_round_id"),
            tag(f"{pre}-C", F.col("ck").cast("string")).alias("vendor_company_id"),
            F.when(F.col("pk") % hide != 0, F.col("amount")).alias("participation_amount"),
            "is_lead", "board_seat_taken",
            iso(F.col("exit_date")).alias("exit_date"),
            "exit_type",
            F.col("multiple").alias("realised_return_multiple"),
        )

    def mapping(self, entity_type: str | None = None) -> DataFrame:
        """canonical_id, entity_type, source_system, vendor_id; edges only where (ok, ln) is unique."""
        unique = (
            self.t("lineitem").groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))
            .agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
        )
        both = (F.col("ck") % 8 != 0) & (F.col("ck") % 6 != 1)
        edges = unique.join(self.t("orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck")), "ok")
        edges = edges.select(
            tag("V", F.col("ok").cast("string"), F.col("ln").cast("string")).alias("id"),
            ((F.col("ck") % 8 != 0) & ~(both & ((F.col("ok") * 3 + F.col("ln")) % 10 == 3))).alias("in_a"),
            ((F.col("ck") % 6 != 1) & ~(both & ((F.col("ok") + 5 * F.col("ln")) % 12 == 5))).alias("in_b"),
        )
        k = F.col("c_custkey")
        c = F.col("o_custkey")
        parts = {
            "company": self.t("customer").select(
                tag("C", k.cast("string")).alias("id"), (k % 8 != 0).alias("in_a"), (k % 6 != 1).alias("in_b")),
            "funding_round": self.t("orders").select(
                tag("R", F.col("o_orderkey").cast("string")).alias("id"), (c % 8 != 0).alias("in_a"),
                (c % 6 != 1).alias("in_b")),
            "investor": self.t("supplier").select(
                tag("I", F.col("s_suppkey").cast("string")).alias("id"), F.lit(True).alias("in_a"),
                F.lit(True).alias("in_b")),
            "investment": edges,
        }
        out = None
        for kind, ids in parts.items():
            if entity_type not in (None, kind):
                continue
            rows = ids.select(
                F.col("id").alias("canonical_id"),
                F.lit(kind).alias("entity_type"),
                F.explode(
                    F.filter(
                        F.array(
                            F.struct(F.col("in_a").alias("covered"), F.lit("feed_a").alias("source_system"),
                                     F.concat(F.lit("A-"), "id").alias("vendor_id")),
                            F.struct(F.col("in_b").alias("covered"), F.lit("feed_b").alias("source_system"),
                                     F.concat(F.lit("B-"), "id").alias("vendor_id")),
                        ),
                        lambda s: s.covered,
                    )
                ).alias("s"),
            ).select("canonical_id", "entity_type", "s.source_system", "s.vendor_id")
            out = rows if out is None else out.unionByName(rows)
        return out

    # --- internal feeds -------------------------------------------------------------------------

    def affiliations(self) -> DataFrame:
        """Person to company links: seven consecutive orders make one person."""
        k = F.col("o_orderkey")
        start = F.col("o_orderdate").cast("date")
        past = F.col("o_orderstatus") == "F"
        return self.t("orders").select(
            tag("P", F.expr("o_orderkey div 7").cast("string")).alias("person_id"),
            tag("C", F.col("o_custkey").cast("string")).alias("company_id"),
            pick(ROLES, k % 4).alias("role"),
            start.alias("start_date"),
            F.when(past, F.date_add(start, 400)).alias("end_date"),
            past.alias("is_past"),
        )

    def people(self) -> DataFrame:
        link = F.struct("company_id", "role", iso(F.col("start_date")).alias("start_date"))
        past = F.struct("company_id", "role", iso(F.col("start_date")).alias("start_date"),
                        iso(F.col("end_date")).alias("end_date"), F.lit("left").alias("reason"))
        # Seven links per person at most, so the arrays are bounded.
        return self.affiliations().groupBy("person_id").agg(
            F.concat(F.lit("Person "), F.col("person_id")).alias("name"),
            F.to_json(F.array_sort(F.collect_list(F.when(~F.col("is_past"), link)))).alias("current_affiliations"),
            F.to_json(F.array_sort(F.collect_list(F.when(F.col("is_past"), past)))).alias("historical_affiliations"),
            F.lit("[]").alias("education"),
            F.lit("[]").alias("notable_prior_companies"),
        )

    def stage_events(self) -> DataFrame:
        """First time each deal entered each stage."""
        stage = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_STAGES.items() for x in kv]), F.col("event_type"))
        return (
            self.t("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("at"))
            .select(tag("DL", F.col("user_id").cast("string")).alias("deal_id"),
                    tag("C", F.col("user_id").cast("string")).alias("company_id"), stage.alias("stage"), "at")
        )

    def deals(self) -> DataFrame:
        at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        # One entry per stage, so the history is bounded by the number of stages.
        return self.stage_events().groupBy("deal_id", "company_id").agg(
            F.max_by("stage", "at").alias("stage"),
            F.to_json(F.array_sort(F.collect_list(F.struct(at.alias("at"), "stage")))).alias("stage_history"),
            F.lit("analyst").alias("analyst_owner"),
            F.lit("partner").alias("partner_owner"),
            (F.count(F.lit(1)) * 100000.0).alias("proposed_check_size"),
            F.lit(None).cast("string").alias("target_round_id"),
            F.lit(None).cast("string").alias("ic_date"),
            F.lit(None).cast("string").alias("ic_outcome"),
        )

    def labelled_texts(self) -> DataFrame:
        """The documents with a sensitivity label taken from the label table."""
        labels = self.t("labels")
        return self.t("documents").join(labels, "doc_id", "left").select(
            "doc_id", "text", "lang", "source",
            F.when(F.col("toxic") == 1, v.SENSITIVITY_LABELS[3])
            .when(F.col("quality") == 0, v.SENSITIVITY_LABELS[2])
            .when(F.col("quality") == 1, v.SENSITIVITY_LABELS[1])
            .otherwise(v.SENSITIVITY_LABELS[0]).alias("sensitivity_label"),
        )

    def documents(self) -> DataFrame:
        k = F.col("doc_id")
        return self.labelled_texts().select(
            tag("D", k.cast("string")).alias("document_id"),
            pick(v.DOCUMENT_TYPES, k % 6).alias("document_type"),
            F.to_json(F.array(tag("C", (k % 100).cast("string")))).alias("subject_company_ids"),
            F.lit("[]").alias("subject_deal_ids"),
            F.when(k % 4 != 0, tag("P", k.cast("string"))).alias("author_person_id"),
            iso(F.date_add(F.lit("1995-01-01").cast("date"), (k * 31 % 2400).cast("int"))).alias("created_date"),
            F.concat(F.lit("files/"), k.cast("string")).alias("storage_location"),
            F.col("text").alias("extracted_text"),
            F.lit(None).cast("string").alias("embedding_index_id"),
            "sensitivity_label",
        )

    def changes(self) -> DataFrame:
        """Ordered attribute changes by key, from the event stream."""
        return self.t("events").select(
            tag("U", F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("attr"), "ts", "event_id",
        )
