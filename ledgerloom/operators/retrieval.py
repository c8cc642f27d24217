"""Ranked retrieval over stored text and vectors, with label filtering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.functions.scalars import json_tags
from ledgerloom.sources.landing import materialize

K1, B = 1.2, 0.75


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def top_k(scored: DataFrame, group: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """The best k rows per group, ties by id. Spark trims each partition to k before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def postings(
    docs: DataFrame, questions: DataFrame, doc_id: str = "doc_id", text: str = "text", question: str = "question",
    labels: Sequence[str] = (),
) -> DataFrame:
    """(_doc, labels, _len, term, _tf) for the terms that some question uses, and one row per document under the empty
    term, which carries the corpus size and mean length. Every text is split once, and its tokens meet the question
    terms at once. Write the result: any part of the corpus that the labels tell apart can then be ranked from it.
    """
    vocabulary = questions.select(F.explode(F.array_distinct(tokens(question))).alias("term"))
    vocabulary = vocabulary.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    split = docs.select(F.col(doc_id).alias("_doc"), *labels, tokens(text).alias("_tokens"))
    split = split.select("_doc", *labels, F.size("_tokens").alias("_len"), F.explode(F.array_append("_tokens", F.lit(""))).alias("term"))
    return split.join(vocabulary, "term").groupBy("_doc", *labels, "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))


def ranked_by_bm25(
    held: DataFrame, questions: DataFrame, k: int, doc_id: str = "doc_id", question_id: str = "question_id",
    question: str = "question", digits: int = 6, keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """The best k documents per question from written postings, or the part of them that passes a filter, whose own
    statistics then count. The weights are written and read back: they have a known size when the scores are
    planned, so they, and not the postings, are what may be broadcast.
    """
    asked = questions.select(question_id, F.explode(F.array_distinct(tokens(question))).alias("term"))
    corpus = held.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"))
    used = held.filter("term <> ''")
    n, df = corpus.select("n").scalar(), F.col("_df")
    weights = keep(asked.join(used.groupBy("term").agg(F.count(F.lit(1)).alias("_df")), "term").select(
        question_id, "term", F.log1p((n - df + 0.5) / (df + 0.5)).alias("_idf")))
    mean = corpus.select("mean").scalar()
    tf = F.col("_tf")
    gain = used.withColumn("_gain", tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / mean)))
    scored = (
        gain.join(weights, "term").groupBy(question_id, "_doc")
        .agg(F.round(F.sum(F.col("_idf") * F.col("_gain")), digits).alias("score"))
        .withColumnRenamed("_doc", doc_id)
    )
    return top_k(scored, [question_id], "score", doc_id, k)


def bm25(
    docs: DataFrame, questions: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text",
    question_id: str = "question_id", question: str = "question", digits: int = 6,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """The best k documents per question by BM25 over whole texts."""
    held = keep(postings(docs, questions, doc_id, text, question))
    return ranked_by_bm25(held, questions, k, doc_id, question_id, question, digits, keep)


def _unit(c: Column) -> Column:
    """The vector over its length, in double precision; NULL where it has none or holds a NULL."""
    x = F.transform(c, lambda e: e.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    return F.when(length > 0, F.transform(x, lambda e: e / length))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding",
    query_id: str = "query_id", query: str = "query", digits: int = 6, chunk: int = 4096, block: int = 4096,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """The best k vectors per query by cosine, exact, for any number of queries.

    Vectors are dealt by a hash into chunks of about `chunk` rows and queries into blocks of about `block`. A chunk meets
    a block in one task of bounded size, which multiplies two matrices of unit vectors and returns k rows per query; no
    (query, vector) pair becomes a row before that. Vectors without a cosine (NULL, zero, NULL or NaN inside) are not
    ranked, and vectors of unlike length are not compared. Ids must be unique.
    """
    held = keep(vectors.select(F.col(vec_id).alias("_v"), _unit(F.col(embedding)).alias("_x"))).filter("_x is not null")
    asked = keep(queries.select(F.col(query_id).alias("_q"), _unit(F.col(query)).alias("_y"))).filter("_y is not null")
    n_chunks, n_blocks = (max(1, -(-df.count() // n)) for df, n in ((held, chunk), (asked, block)))

    def dealt(df: DataFrame, key: str, vec: str, n: int, own: str, other: str, copies: int) -> DataFrame:
        return df.select(key, vec, F.size(vec).alias("_dim"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = left.column("_q"), right.column("_v")
        score = _rows(left.column("_y")) @ _rows(right.column("_x")).T if len(left) and len(right) else np.zeros((0, 0))
        score = np.round(score, digits)
        best = [np.lexsort((np.asarray(v), -s))[:k] for s in score]  # ties by id
        row = [i for i, b in enumerate(best) for _ in b]
        at = np.concatenate(best) if best else np.zeros(0, int)
        return pa.table({"q": q.take(pa.array(row, pa.int64())), "v": v.take(pa.array(at, pa.int64())),
                         "score": pa.array(score[row, at] if row else [], pa.float64())})

    by = ["_dim", "_chunk", "_block"]
    grid = dealt(asked, "_q", "_y", n_blocks, "_block", "_chunk", n_chunks).groupBy(*by).cogroup(
        dealt(held, "_v", "_x", n_chunks, "_chunk", "_block", n_blocks).groupBy(*by))
    kinds = [queries.schema[query_id].dataType.simpleString(), vectors.schema[vec_id].dataType.simpleString()]
    found = grid.applyInArrow(rank, f"q {kinds[0]}, v {kinds[1]}, score double")
    scored = found.filter("not isnan(score)").select(
        F.col("q").alias(query_id), F.col("v").alias(vec_id), F.round("score", digits).alias("score"))
    return top_k(scored, [query_id], "score", vec_id, k)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = np.asarray(column.combine_chunks().flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def keyword_search(docs: DataFrame, words: Sequence[str], text: str = "text", pattern: str | None = None) -> DataFrame:
    """Texts with every word, as given but for case, and matching the pattern if there is one."""
    out = docs
    for word in words:
        out = out.filter(F.contains(F.lower(F.col(text)), F.lit(word.lower())))
    return out.filter(F.col(text).rlike(pattern)) if pattern else out


def subjects(docs: DataFrame) -> DataFrame:
    """One row per document and company it is about, for search by entity."""
    return docs.select("document_id", "sensitivity_label", F.explode(json_tags("subject_company_ids")).alias("company_id"))


def visible(docs: DataFrame, clearance: str, label: str = "sensitivity_label") -> DataFrame:
    """Documents labelled at or below the clearance. Unknown labels are never visible."""
    allowed = v.SENSITIVITY_LABELS[: v.SENSITIVITY_LABELS.index(clearance) + 1]
    return docs.filter(F.col(label).isin(allowed))
