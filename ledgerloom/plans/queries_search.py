"""Queries over block bounds and trigram postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import search_index, vector_cells
from ledgerloom.plans.queries_documents import ALL_VECTORS, asked, held
from ledgerloom.plans.registry import Context, query


def in_blocks(c: Context) -> tuple[DataFrame, DataFrame]:
    return search_index.ranked_in_blocks(held(c), asked(c), 5)


@query("X2_block_max_top_k", "SELECT item_id AS question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 5", covers="X2 L4")
def block_max(c: Context) -> DataFrame:
    return in_blocks(c)[0]


@query("X2_postings_scored", "SELECT true AS fewer", covers="X2")
def postings_scored(c: Context) -> DataFrame:
    """Whether the bounds left out postings of the questions' terms."""
    counts = in_blocks(c)[1].agg(F.sum("n_scored").alias("scored"), F.sum("n_postings").alias("all"))
    return counts.select((F.col("scored") < F.col("all")).alias("fewer"))


def index(c: Context) -> DataFrame:
    if "trigrams" not in c._kept:  # its layout counts, so it is not written once more
        c._kept["trigrams"] = search_index.trigram_index(c.t("documents"), f"{c.dir}/trigram_index")
    return c._kept["trigrams"]


#: Words, and a pattern that the texts must match as well.
SEARCHES = {
    "one word": (["loser"], None), "a phrase": (["all rights reserved"], None), "two words": (["the", "Apache"], None),
    "letters and a pattern": (["token"], "= \"[0-9a-f]{8}"), "a short word": (["q", "licen"], None), "a pattern": ([], "version 2[.]0"),
    "nothing has it": (["zzzzqqq"], None),
}


def _sql(name: str, words: list[str], pattern: str | None) -> str:
    tests = [f"contains(lower(text), '{w.lower()}')" for w in words] + ([f"regexp_matches(text, '{pattern}')"] if pattern else [])
    return f"SELECT '{name}' AS search, doc_id FROM documents WHERE {' AND '.join(tests)}"


@query("X4_indexed_search", " UNION ALL ".join(_sql(n, w, p) for n, (w, p) in SEARCHES.items()), covers="X4")
def indexed(c: Context) -> DataFrame:
    parts = [
        search_index.indexed_search(c.t("documents"), index(c), words, pattern=pattern)[0].select(F.lit(name).alias("search"), "doc_id")
        for name, (words, pattern) in SEARCHES.items()]
    return reduce(DataFrame.unionByName, parts)


@query("X4_texts_read", "SELECT 'a pattern behind a word' AS search, true AS fewer FROM (SELECT 1)", covers="X4")
def texts_read(c: Context) -> DataFrame:
    docs = c.t("documents")
    read = search_index.indexed_search(docs, index(c), ["token"], pattern="[0-9a-f]{8}")[1].agg(F.count(F.lit(1)).alias("n"))
    every = docs.agg(F.count(F.lit(1)).alias("n"))
    return read.select(F.lit("a pattern behind a word").alias("search"), (F.col("n") < every.scalar()).alias("fewer"))


def _all_vectors(c: Context) -> tuple[DataFrame, DataFrame]:
    e = c.t("embeddings")
    return vector_cells.nearest_in_cells(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)


@query("X3_all_vectors_in_cells", ALL_VECTORS, covers="X3")
def all_in_cells(c: Context) -> DataFrame:
    return _all_vectors(c)[0].select("query_id", "vec_id", "score", "rank")


@query("X3_products_done", "SELECT count(*) * count(*) AS n_all, true AS counted FROM embeddings", covers="X3")
def products(c: Context) -> DataFrame:
    """All pairs, and whether no more of them were multiplied."""
    return _all_vectors(c)[1].select("n_all", (F.col("n_products") <= F.col("n_all")).alias("counted"))
