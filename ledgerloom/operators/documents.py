"""Fund documents written from the conformed tables, their references, and corpus audits."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v

DOC_COLUMNS = ["lp_document_id", "document_type", "investor_id", "effective_date", "body_text", "refs"]


def document_id(*parts: Column) -> Column:
    """A hash of what the document is about: stable on reruns, and no global counter is needed."""
    return F.concat(F.lit("LPD-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def _refs(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("entity_type"), c.alias("entity_id")) for k, c in pairs])


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def money(c: Column) -> Column:
    return F.format_number(c, 2)


def quarter_ends(as_of: str, limit: int = v.LETTER_QUARTERS) -> list[date]:
    """The last quarter ends on or before `as_of`, oldest first."""
    first = date.fromisoformat(as_of).replace(day=1)
    out = []
    # Step back month by month from the month after as_of; a quarter ends the day before Jan, Apr, Jul, Oct begin.
    start = (first.replace(day=28) + timedelta(days=4)).replace(day=1)
    while len(out) < limit:
        end = start - timedelta(days=1)
        if start.month % 3 == 1 and end <= date.fromisoformat(as_of):
            out.append(end)
        start = end.replace(day=1)
    return out[::-1]


def funds(investors: DataFrame) -> DataFrame:
    """Only funds, the investors with a vintage, write to limited partners."""
    return investors.filter(F.col("is_current") & F.col("vintage_year").isNotNull()).select(
        "investor_id", F.col("legal_name").alias("fund_name"), "vintage_year")


def _names(companies: DataFrame) -> DataFrame:
    return companies.filter("is_current").select("company_id", F.col("legal_name").alias("company_name"))


def quarterly_letters(investments: DataFrame, investors: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """Per fund and trailing quarter end since its vintage, two to four holdings in an order set by a hash.

    Holdings are made distinct first; the ranking keeps at most four rows per letter, and Spark trims to that
    before the shuffle, so a fund with very many holdings is never sorted in one task.
    """
    holdings = investments.filter("is_current").select("investor_id", "company_id").distinct()
    counts = holdings.groupBy("investor_id").agg(F.count(F.lit(1)).alias("n_companies"))
    quarters = F.array(*[F.lit(q.isoformat()).cast("date") for q in quarter_ends(as_of)])
    since = F.filter(quarters, lambda q: F.year(q) >= F.col("vintage_year"))
    # Funds meet their holdings before there is a row for each quarter: those rows are many times the funds' files.
    held = holdings.join(funds(investors), "investor_id").withColumn("quarter_end", F.explode(since))
    seed = F.concat_ws("|", "investor_id", _iso(F.col("quarter_end")))
    size = v.HIGHLIGHTS_MIN + F.conv(F.substring(F.md5(seed), 1, 6), 16, 10).cast("int") % (
        v.HIGHLIGHTS_MAX - v.HIGHLIGHTS_MIN + 1)
    order = F.md5(F.concat_ws("|", "investor_id", _iso(F.col("quarter_end")), "company_id"))
    picked = (
        held
        .withColumn("_rank", F.row_number().over(Window.partitionBy("investor_id", "quarter_end").orderBy(order, "company_id")))
        .filter((F.col("_rank") <= v.HIGHLIGHTS_MAX) & (F.col("_rank") <= size))
        .join(_names(companies), "company_id", "left")
    )
    # At most four rows per letter from here on.
    grouped = picked.groupBy("investor_id", "quarter_end", "fund_name").agg(
        F.array_sort(F.collect_list(F.struct("company_id", "company_name"))).alias("top"))
    out = grouped.join(counts, "investor_id")
    return out.select(
        document_id(F.lit("quarterly_letter"), F.col("investor_id"), _iso(F.col("quarter_end"))).alias("lp_document_id"),
        F.lit("quarterly_letter").alias("document_type"),
        "investor_id",
        F.col("quarter_end").alias("effective_date"),
        F.format_string(v.LETTER_TEXT, "fund_name", _iso(F.col("quarter_end")), F.col("n_companies").cast("string"),
                        F.array_join("top.company_name", ", ")).alias("body_text"),
        F.concat(
            _refs(("investor", F.col("investor_id"))),
            F.transform("top.company_id", lambda c: F.struct(F.lit("company").alias("entity_type"), c.alias("entity_id"))),
        ).alias("refs"),
    )


def _fund_investments(investments: DataFrame, investors: DataFrame, companies: DataFrame) -> DataFrame:
    return investments.filter("is_current").join(funds(investors), "investor_id").join(_names(companies), "company_id")


def capital_calls(investments: DataFrame, investors: DataFrame, rounds: DataFrame, companies: DataFrame) -> DataFrame:
    """One notice per fund participation with a disclosed amount."""
    terms = rounds.filter("is_current").select("round_id", "round_type", "currency")
    rows = _fund_investments(investments, investors, companies).join(terms, "round_id")
    return rows.filter(F.col("participation_amount").isNotNull()).select(
        document_id(F.lit("capital_call_notice"), F.col("investment_id")).alias("lp_document_id"),
        F.lit("capital_call_notice").alias("document_type"),
        "investor_id", "effective_date",
        F.format_string(v.CALL_TEXT, "fund_name", money(F.col("participation_amount")), "currency", "company_name",
                        "round_type", _iso(F.col("effective_date"))).alias("body_text"),
        _refs(("investor", F.col("investor_id")), ("round", F.col("round_id")), ("company", F.col("company_id"))).alias("refs"),
    )


def exit_memos(investments: DataFrame, investors: DataFrame, companies: DataFrame) -> DataFrame:
    """One memo per realised fund investment; an unknown multiple is said to be undisclosed."""
    rows = _fund_investments(investments.filter(F.col("exit_date").isNotNull()), investors, companies)
    multiple = F.col("realised_return_multiple")
    said = F.when(multiple.isNotNull(), F.concat(F.regexp_replace(money(multiple), ",", ""), F.lit("x cost")))
    return rows.select(
        document_id(F.lit("memo"), F.col("investment_id")).alias("lp_document_id"),
        F.lit("memo").alias("document_type"),
        "investor_id", F.col("exit_date").alias("effective_date"),
        F.format_string(v.MEMO_TEXT, "fund_name", "company_name", "exit_type", _iso(F.col("exit_date")),
                        F.coalesce(said, F.lit(v.UNDISCLOSED_MULTIPLE))).alias("body_text"),
        _refs(("investor", F.col("investor_id")), ("company", F.col("company_id")), ("round", F.col("round_id"))).alias("refs"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document and referenced entity."""
    return docs.select("lp_document_id", F.explode("refs").alias("r")).select("lp_document_id", "r.entity_type", "r.entity_id")


def manifest_orphans(rows: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """References by type, and how many resolve to no entity. `known` maps type to a one-column frame.

    References are counted per entity before the join, so a much cited entity is one row there.
    """
    refs = rows.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    keys = None
    for kind, df in known.items():
        part = df.select(F.lit(kind).alias("entity_type"), F.col(df.columns[0]).alias("entity_id")).distinct()
        keys = part if keys is None else keys.unionByName(part)
    joined = refs.join(keys.withColumn("_hit", F.lit(True)), ["entity_type", "entity_id"], "left")
    return joined.groupBy("entity_type").agg(
        F.sum("n").alias("n_refs"),
        F.sum(F.when(F.col("_hit").isNull(), F.col("n")).otherwise(0)).alias("unresolved"),
    )


def index_text(docs: DataFrame) -> DataFrame:
    """Header lines and body, as one text to index."""
    return docs.select(
        "lp_document_id",
        F.format_string(v.ENVELOPE_TEXT, "lp_document_id", "document_type", "investor_id", _iso(F.col("effective_date")),
                        "body_text").alias("index_text"),
    )


def corpus_audit(corpus: DataFrame, attached: DataFrame, key: str) -> DataFrame:
    """One row on corpus documents missing and files that are extra, with the verdict.

    `attached` has one row per file with the document key and a status. The verdict is complete when nothing is
    missing or extra and completed files equal the corpus. `status_counts` has the files of each status.
    """
    per = corpus.select(key, F.lit(1).alias("_c"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("_f")).unionByName(
        attached.select(key, F.lit(0).alias("_c"), "status", F.lit(1).alias("_f")))
    per = per.groupBy(key).agg(
        F.max("_c").alias("in_corpus"), F.sum("_f").alias("n_files"), F.count_if(F.col("status") == "completed").alias("completed"))
    return per.agg(
        F.count_if(F.col("in_corpus") == 1).alias("corpus_size"),
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("attached"),
        F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"),
        F.count_if((F.col("in_corpus") == 1) & (F.col("n_files") == 0)).alias("missing"),
        F.count_if(F.col("in_corpus") == 0).alias("extra"),
    ).withColumn(
        "complete", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("completed") == F.col("corpus_size")))


def status_counts(attached: DataFrame) -> DataFrame:
    """Files of every status that occurs, whatever it is called; NULL is a status of its own."""
    return attached.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def corpus_differences(corpus: DataFrame, attached: DataFrame, key: str) -> DataFrame:
    """The ids themselves: missing, extra or failed."""
    have = attached.select(key).distinct()
    return (
        corpus.select(key).join(have, key, "left_anti").withColumn("problem", F.lit("missing"))
        .unionByName(have.join(corpus.select(key), key, "left_anti").withColumn("problem", F.lit("extra")))
        .unionByName(attached.filter("status = 'failed'").select(key).distinct().withColumn("problem", F.lit("failed")))
    )


def orphaned_failures(attached: DataFrame, key: str) -> DataFrame:
    """Failed files that may go, as their document also has a completed one."""
    done = attached.filter("status = 'completed'").select(key).distinct()
    return attached.filter("status = 'failed'").join(done, key, "left_semi")
