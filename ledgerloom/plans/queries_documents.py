"""Queries over generated fund documents, retrieval and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import mentions_number
from ledgerloom.operators import documents, evaluate, measures, retrieval
from ledgerloom.plans.registry import AS_OF, Context, query


def letters(c: Context) -> DataFrame:
    t = c.m.lookups
    return documents.quarterly_letters(c.m.conformed["investments"], t["investors"], t["companies"], AS_OF)


def calls(c: Context) -> DataFrame:
    t = c.m.lookups
    return documents.capital_calls(c.m.conformed["investments"], t["investors"], t["funding_rounds"], t["companies"])


def memos(c: Context) -> DataFrame:
    t = c.m.lookups
    return documents.exit_memos(c.m.conformed["investments"], t["investors"], t["companies"])


def corpus(c: Context) -> DataFrame:
    return c.kept("lp_documents", lambda: letters(c).unionByName(calls(c)).unionByName(memos(c)))


def manifest(c: Context) -> DataFrame:
    return c.kept("lp_document_manifest", lambda: documents.manifest(corpus(c)))


_DOC = "lp_document_id, document_type, investor_id, effective_date, body_text"


@query("X6_quarterly_letters", f"SELECT {_DOC} FROM lp_letter", covers="X6 W6")
def quarterly(c: Context) -> DataFrame:
    return letters(c).drop("refs")


@query("X7_capital_calls", f"SELECT {_DOC} FROM lp_call")
def notices(c: Context) -> DataFrame:
    return calls(c).drop("refs")


@query("X8_exit_memos", f"SELECT {_DOC} FROM lp_memo")
def exits(c: Context) -> DataFrame:
    return memos(c).drop("refs")


@query("X9_reference_manifest", """
    SELECT lp_document_id, 'investor' AS entity_type, investor_id AS entity_id FROM lp
    UNION ALL SELECT lp_document_id, 'company', unnest(cs) FROM lp
    UNION ALL SELECT lp_document_id, 'round', round_id FROM lp WHERE round_id IS NOT NULL""")
def references(c: Context) -> DataFrame:
    return manifest(c)


@query("X10_manifest_integrity", """
    SELECT 'investor' AS entity_type, count(*) AS n_refs, CAST(0 AS BIGINT) AS unresolved FROM lp
    UNION ALL SELECT 'company', CAST(sum(len(cs)) AS BIGINT), 0 FROM lp
    UNION ALL SELECT 'round', count(*), count(*) FILTER (WHERE r.ok IS NULL) FROM lp
              LEFT JOIN (SELECT * FROM ro WHERE ok % 9 <> 0) r ON r.round_id = lp.round_id WHERE lp.round_id IS NOT NULL""",
    covers="X10 J12 U7")
def integrity(c: Context) -> DataFrame:
    t = c.m.conformed
    # Rounds of one type are left out, so some references must show as unresolved.
    known = {
        "investor": t["investors"].select("investor_id"),
        "company": t["companies"].select("company_id"),
        "round": t["funding_rounds"].filter("round_type <> 'Pre-Seed'").select("round_id"),
    }
    return documents.manifest_orphans(manifest(c), known)


@query("X1_index_text", """
    SELECT lp_document_id, 'Document ID: ' || lp_document_id || chr(10) || 'Type: ' || document_type || chr(10) || 'Fund (investor_id): ' ||
           investor_id || chr(10) || 'Effective date: ' || effective_date || chr(10) || chr(10) || body_text || chr(10) AS index_text FROM lp""")
def envelopes(c: Context) -> DataFrame:
    return documents.index_text(corpus(c))


@query("X11_fact_extraction", """
    SELECT lp_document_id, document_type, CASE document_type WHEN 'memo' THEN format('{:.2f}', stated) || 'x'
           WHEN 'quarterly_letter' THEN CAST(CAST(stated AS BIGINT) AS VARCHAR) ELSE format('{:,.2f}', stated) END AS expected_text,
           round(stated, 2) AS expected_value, CAST(effective_date AS VARCHAR) AS fact_date FROM lp WHERE stated IS NOT NULL""")
def facts(c: Context) -> DataFrame:
    return evaluate.extract_facts(corpus(c)).select(
        "lp_document_id", "document_type", "expected_text", F.round("expected_value", 2).alias("expected_value"), "fact_date")


def _near(factor: float) -> str:
    """SQL: some number of the text lies within half a percent of the stated figure times `factor`, in any scale."""
    tests = " OR ".join(
        f"abs(x - stated * {factor} {scale}) <= 0.005 * greatest(abs(stated * {factor} {scale}), 1e-9)"
        for scale in ("* 1", "* 100", "/ 1e3", "/ 1e6", "/ 1e9"))
    return f"len([x FOR x IN nums IF x IS NOT NULL AND ({tests})]) > 0"


@query("X12_numeric_containment", rf"""
    SELECT lp_document_id, {_near(1.004)} AS near, {_near(3.7)} AS far FROM (
        SELECT lp_document_id, stated,
               [TRY_CAST(replace(t, ',', '') AS DOUBLE) FOR t IN regexp_extract_all(body_text, '-?\d[\d,]*\.?\d*')] AS nums
        FROM lp WHERE stated IS NOT NULL)""")
def containment(c: Context) -> DataFrame:
    df = evaluate.extract_facts(corpus(c))
    value = F.col("expected_value")
    return df.select("lp_document_id", mentions_number("body_text", value * 1.004, 0.005).alias("near"),
                     mentions_number("body_text", value * 3.7, 0.005).alias("far"))


@query("W6_cases_per_type", """
    SELECT lp_document_id, document_type FROM (
        SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY lp_document_id) AS rk FROM lp WHERE stated IS NOT NULL) WHERE rk <= 2""",
    covers="W6 L2")
def cases(c: Context) -> DataFrame:
    df = evaluate.extract_facts(corpus(c)).select("lp_document_id", "document_type", F.lit(0).alias("same"))
    return retrieval.top_k(df, ["document_type"], "same", "lp_document_id", 2).select("lp_document_id", "document_type")


# --- retrieval over the given texts, with the benchmark passages as questions ---


def asked(c: Context) -> DataFrame:
    return c.t("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def held(c: Context) -> DataFrame:
    """Postings of all labelled texts, shared by both rankings."""
    return c.kept("bm25_postings", lambda: retrieval.postings(c.fixtures.labelled_texts(), asked(c), labels=["sensitivity_label"]))


def ranked(c: Context) -> DataFrame:
    return c.kept("bm25_top", lambda: retrieval.ranked_by_bm25(held(c), asked(c), 5))


@query("X2_lexical_top_k", "SELECT item_id AS question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 5",
       covers="X2 L4")
def lexical(c: Context) -> DataFrame:
    return ranked(c)


@query("X3_vector_top_k", """
    SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
                   (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
            FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) q)) WHERE rank <= 10""",
    covers="X3 L4")
def vector(c: Context) -> DataFrame:
    e = c.t("embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q"))
    asked_vectors = first.select(F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("query"))
    return retrieval.nearest(e, asked_vectors, 10)


ALL_VECTORS = """
    SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
                   (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
            FROM embeddings e, embeddings q)) WHERE rank <= 3"""


@query("X3_all_vectors", ALL_VECTORS, covers="X3 L4")
def all_vectors(c: Context) -> DataFrame:
    e = c.t("embeddings")
    return retrieval.nearest(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)


@query("X4_keyword_search", """
    SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM documents
    WHERE contains(lower(text), 'the') AND regexp_matches(text, '[0-9]{3}') GROUP BY 1""", covers="X4")
def keyword(c: Context) -> DataFrame:
    return retrieval.keyword_search(c.t("documents"), ["The"], pattern="[0-9]{3}").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("X4_entity_search", """
    SELECT 'C-' || (doc_id % 100) AS company_id, count(*) AS n_docs, count(*) FILTER (WHERE label = 'Public') AS n_public
    FROM lab GROUP BY 1""", covers="X4")
def entity_search(c: Context) -> DataFrame:
    return retrieval.subjects(c.m.conformed["documents"]).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("sensitivity_label") == "Public").alias("n_public"))


@query("X5_label_filtered", """
    SELECT item_id AS question_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM (SELECT b.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, b.doc_id) AS r2
          FROM bm25v b) WHERE r2 <= 3""", covers="X5")
def filtered(c: Context) -> DataFrame:
    return retrieval.ranked_by_bm25(retrieval.visible(held(c), "Internal"), asked(c), 3).select("question_id", "doc_id", "rank")


def answers(c: Context) -> DataFrame:
    """The best document per passage is the answer; any document holding the passage would be right."""
    top = ranked(c).filter("rank = 1").select("question_id", "doc_id")
    docs = c.t("documents").select("doc_id", "text")
    items = asked(c)
    found = items.join(top, "question_id", "left").join(docs, "doc_id", "left")
    return found.select(
        F.col("question_id").cast("string").alias("case"), F.coalesce("text", F.lit("")).alias("answer"),
        F.col("question").alias("expected_text"), F.lit(None).cast("double").alias("expected_value"),
        F.col("doc_id").cast("string").alias("expected_id"),
        F.when(F.col("doc_id").isNotNull(), F.array(F.col("doc_id").cast("string"))).alias("cited_ids"),
        F.lit("document").alias("leg"),
    )


@query("X13_passage_scores", """
    SELECT CAST(b.item_id AS VARCHAR) AS "case", coalesce(contains(lower(d.text), lower(b.text)), false) AS grounded, m.doc_id IS NOT NULL AS any_citation
    FROM benchmark b LEFT JOIN (SELECT item_id, doc_id FROM bm25 WHERE rank = 1) m USING (item_id) LEFT JOIN documents d ON d.doc_id = m.doc_id""")
def passage_scores(c: Context) -> DataFrame:
    return evaluate.score_answers(answers(c)).select("case", "grounded", "any_citation")


def document_answers(c: Context) -> DataFrame:
    """Each document answers its own question; some cite nothing, some cite another document of the same fund."""
    df = evaluate.extract_facts(corpus(c))
    h = F.conv(F.substring("lp_document_id", 5, 2), 16, 10).cast("int")
    own = F.col("lp_document_id")
    wrong = F.concat(own, F.lit("-other"))
    return df.select(
        own.alias("expected_id"), F.col("document_type").alias("leg"), "expected_text", "expected_value",
        F.when(h % 7 == 0, "I do not know.").otherwise(F.col("body_text")).alias("answer"),
        F.when(h % 5 == 0, F.array().cast("array<string>")).when(h % 3 == 0, F.array(wrong)).otherwise(F.array(own)).alias("cited_ids"),
    )


@query("X13_score_report", """
    SELECT document_type AS leg, count(*) AS cases, count(*) FILTER (WHERE h % 7 <> 0) AS grounded, count(*) FILTER (WHERE h % 5 <> 0) AS with_citation,
           count(*) FILTER (WHERE h % 5 <> 0 AND h % 3 <> 0) AS cited_correctly, round(count(*) FILTER (WHERE h % 7 <> 0) / count(*), 6) AS grounded_rate,
           round(count(*) FILTER (WHERE h % 5 <> 0 AND h % 3 <> 0) / count(*) FILTER (WHERE h % 5 <> 0), 6) AS citation_accuracy,
           round(count(*) FILTER (WHERE h % 5 <> 0) / count(*), 6) AS citation_coverage
    FROM (SELECT *, CAST('0x' || substr(lp_document_id, 5, 2) AS INTEGER) AS h FROM lp WHERE stated IS NOT NULL) GROUP BY 1""",
    covers="X13 A9")
def report(c: Context) -> DataFrame:
    df = evaluate.score_report(evaluate.score_answers(document_answers(c)), "leg")
    return df.withColumns({x: F.round(x, 6) for x in ("grounded_rate", "citation_accuracy", "citation_coverage")})


# --- the metric leg: measures as expected values, answers as rows ---

#: Case, measure and slice; answers are whole numbers of basis points or units, off by more than the tolerance in some cases.
METRIC_CASES = [
    ("overall_moic", "moic", {}), ("overall_total_invested", "total_invested", {}), ("vintage_moic", "moic", {"vintage_year": 1998}),
    ("vintage_irr", "irr", {"vintage_year": 1998}), ("sector_nav", "nav", {"sector_group": "Mobility"}),
    ("sector_concentration", "concentration", {"sector_group": "Industrials"}),
]
#: By case the factor between the measure and what the answer says: within two percent, or not.
SAID = {"vintage_moic": 1.019, "vintage_irr": 1.05, "sector_nav": 0.985, "sector_concentration": 100.0}


def metric_expected(c: Context) -> DataFrame:
    parts = []
    for name, measure, where in METRIC_CASES:
        if measure == "concentration":
            df = measures.sector_concentration(c.star, where=where, as_of=AS_OF)
        else:
            df = measures.measure(c.star, where=where, as_of=AS_OF)
        parts.append(df.select(F.lit(name).alias("case"), F.col(measure).alias("expected_value")))
    return c.kept("metric_expected", lambda: reduce(DataFrame.unionByName, parts))


def metric_answers(c: Context) -> DataFrame:
    factor = F.lit(1.0)
    for name, x in SAID.items():
        factor = F.when(F.col("case") == name, x).otherwise(factor)
    value = F.format_number(F.col("expected_value") * factor, 6)
    return metric_expected(c).select(
        "case", "expected_value", F.lit(None).cast("string").alias("expected_text"), F.lit(None).cast("string").alias("expected_id"),
        F.array().cast("array<string>").alias("cited_ids"), F.concat(F.lit("It is "), value, F.lit(".")).alias("answer"), F.lit("metric").alias("leg"))


_METRICS = """
    SELECT 'overall_moic' AS name, sum(worth) / sum(paid) AS x FROM f UNION ALL SELECT 'overall_total_invested', sum(paid) FROM f
    UNION ALL SELECT 'vintage_moic', sum(worth) / sum(paid) FROM f WHERE vintage_year = 1998
    UNION ALL SELECT 'vintage_irr', pow(sum(worth) / sum(paid), 1 / (sum(cost_days) / 365.25 / sum(paid))) - 1 FROM f WHERE vintage_year = 1998
    UNION ALL SELECT 'sector_nav', sum(worth) FROM f WHERE sector_group = 'Mobility'
    UNION ALL SELECT 'sector_concentration', sum(paid) FILTER (WHERE sector_group = 'Industrials') / sum(paid) FROM f"""


@query("X13_metric_leg", f"""
    SELECT name AS "case", round(x, 6) AS expected_value, name <> 'vintage_irr' AS grounded FROM ({_METRICS})""", covers="X13")
def metric_leg(c: Context) -> DataFrame:
    scored = evaluate.score_answers(metric_answers(c), tolerance=0.02)
    return scored.select("case", F.round("expected_value", 6).alias("expected_value"), "grounded")


@query("X13_both_legs", """
    SELECT 'metric' AS leg, CAST(6 AS BIGINT) AS cases, CAST(5 AS BIGINT) AS grounded, CAST(0 AS BIGINT) AS with_citation, CAST(0 AS BIGINT) AS cited_correctly
    UNION ALL SELECT 'document', count(*), count(*) FILTER (WHERE h % 7 <> 0), count(*) FILTER (WHERE h % 5 <> 0), count(*) FILTER (WHERE h % 5 <> 0 AND h % 3 <> 0)
    FROM (SELECT *, CAST('0x' || substr(lp_document_id, 5, 2) AS INTEGER) AS h FROM lp WHERE stated IS NOT NULL)""", covers="X13 A9")
def both_legs(c: Context) -> DataFrame:
    columns = ["leg", "grounded", "any_citation", "cited_correctly"]
    metric = evaluate.score_answers(metric_answers(c), tolerance=0.02).select(*columns)
    document = evaluate.score_answers(document_answers(c)).withColumn("leg", F.lit("document")).select(*columns)
    return evaluate.score_report(metric.unionByName(document), "leg").select("leg", "cases", "grounded", "with_citation", "cited_correctly")


@query("X11_questions", """
    SELECT document_type, count(*) AS n, count(*) AS with_investor FROM lp WHERE stated IS NOT NULL GROUP BY 1""", covers="X11")
def asked_questions(c: Context) -> DataFrame:
    df = evaluate.questions(evaluate.extract_facts(corpus(c)))
    return df.groupBy("document_type").agg(
        F.count("question").alias("n"), F.count_if(F.contains("question", "investor")).alias("with_investor"))


# --- corpus audits over an index state derived from the document table ---


def index_state(c: Context) -> DataFrame:
    k = F.col("doc_id")
    docs = c.t("documents").select("doc_id")
    name = k.cast("string").alias("doc")
    status = F.when(k % 13 == 0, "failed").when(k % 41 == 5, "in_progress").when(k % 43 == 7, "cancelled").otherwise("completed").alias("status")
    done = F.lit("completed").alias("status")
    indexed = docs.filter(k % 17 != 3)
    return (
        indexed.select(name, status)
        .unionByName(indexed.filter(k % 39 == 0).select(name, done))
        .unionByName(docs.filter(k % 97 == 0).select(F.concat(F.lit("old-"), k.cast("string")).alias("doc"), done))
    )


def index_corpus(c: Context) -> DataFrame:
    return c.t("documents").select(F.col("doc_id").cast("string").alias("doc"))


@query("X14_corpus_audit", """
    SELECT (SELECT count(*) FROM documents) AS corpus_size, count(*) AS attached, count(*) FILTER (WHERE status = 'completed') AS completed,
           (SELECT count(*) FILTER (WHERE doc_id % 17 = 3) FROM documents) AS missing, count(*) FILTER (WHERE doc LIKE 'old-%') AS extra, false AS complete FROM files""",
    covers="X14 U5 A2")
def audit(c: Context) -> DataFrame:
    return documents.corpus_audit(index_corpus(c), index_state(c), "doc")


@query("X14_status_counts", "SELECT status, count(*) AS n_files FROM files GROUP BY 1", covers="X14 A2")
def statuses(c: Context) -> DataFrame:
    return documents.status_counts(index_state(c))


@query("X14_complete_corpus", """
    SELECT count(*) AS corpus_size, count(*) AS attached, count(*) AS completed, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, true AS complete
    FROM documents""", covers="X14")
def complete(c: Context) -> DataFrame:
    body = index_corpus(c)
    return documents.corpus_audit(body, body.withColumn("status", F.lit("completed")), "doc")


@query("X14_corpus_differences", """
    SELECT CAST(doc_id AS VARCHAR) AS doc, 'missing' AS problem FROM documents WHERE doc_id % 17 = 3
    UNION ALL SELECT doc, 'extra' FROM files WHERE doc LIKE 'old-%'
    UNION ALL SELECT doc, 'failed' FROM files WHERE status = 'failed'""", covers="X14 U5")
def differences(c: Context) -> DataFrame:
    return documents.corpus_differences(index_corpus(c), index_state(c), "doc")


@query("X15_orphaned_failures", """
    SELECT doc, status FROM files WHERE status = 'failed' AND doc IN (SELECT doc FROM files WHERE status = 'completed')""")
def orphans(c: Context) -> DataFrame:
    return documents.orphaned_failures(index_state(c), "doc")
