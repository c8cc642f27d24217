"""Block bounds and trigram postings against the full ranking and the full scan."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval, search_index, vector_cells
from ledgerloom.session import shared_dir
from ledgerloom.sources.landing import materialize
from tests.conftest import rows_of


@pytest.mark.parametrize("seed", [1, 2])
def test_block_bounds_change_no_row(frame, seed):
    """Rare and frequent terms, ties, repeated texts, questions with unknown terms and with fewer than k hits."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))) for _ in range(600)]
    docs = frame([(k, t) for k, t in enumerate(texts + texts[:30] + [None, "", "rare", "rare w0"])], "doc_id int, text string")
    questions = frame([(k, " ".join(rng.sample(words, 3))) for k in range(8)] + [(90, "rare nothing"), (91, "unknown"), (92, "w0")],
                      "question_id int, question string")
    held = materialize(retrieval.postings(docs, questions))
    want = retrieval.ranked_by_bm25(held, questions, 5)
    got, counts = search_index.ranked_in_blocks(held, questions, 5, block_docs=8)
    assert rows_of(got, "question_id", "doc_id", "score", "rank") == rows_of(want, "question_id", "doc_id", "score", "rank")
    scored = {r["question_id"]: (r["n_scored"], r["n_postings"]) for r in counts.collect()}
    assert all(a <= b for a, b in scored.values()) and sum(a for a, _ in scored.values()) < sum(b for _, b in scored.values())


def test_block_bounds_without_documents_or_questions(frame):
    docs, questions = frame([(1, "a b")], "doc_id int, text string"), frame([(1, "a")], "question_id int, question string")
    for d, q in ((docs.limit(0), questions), (docs, questions.limit(0))):
        assert search_index.ranked_in_blocks(materialize(retrieval.postings(d, q)), q, 3)[0].count() == 0


TEXTS = ["aaaaaa", "aaa", "aa", "", None, "Ban anana band", "ANANAS", "straße 漢字漢字 🙂🙃🙂", "STRASSE", "x" * 5000 + "needle", "needl e",
         "all rights reserved", "All\nrights", "12-345 token = ab", "token = 12345678", "tok en", "İstanbul", "ab" * 40]


@pytest.mark.parametrize("words", [["aaa"], ["aaaa"], ["aaaaaaa"], ["anana"], ["ANANAS"], ["漢字漢"], ["🙂🙃🙂"], ["needle"], ["all rights reserved"],
                                   ["ba", "nana"], ["x"], ["ababababab", "aba"], ["zzzz"], ["needle", "xxxx"]])
def test_lookups_equal_the_scan(spark, frame, words):
    docs = frame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    index = search_index.trigram_index(docs, f"{shared_dir(spark)}/t")
    got, read = search_index.indexed_search(docs, index, words)
    assert rows_of(got, "doc_id") == rows_of(retrieval.keyword_search(docs, words), "doc_id")
    if all(len(w) >= 3 for w in words):
        assert read.count() == 0  # settled by the postings alone


def test_patterns_read_the_survivors_alone(spark, frame):
    docs = frame(list(enumerate(TEXTS)), "doc_id int, text string")
    index = search_index.trigram_index(docs, f"{shared_dir(spark)}/t")
    for words, pattern, most in ((["token"], "[0-9]{8}", 2), ([], "token = [0-9]{8}", 2), ([], "a(b|c)", len(TEXTS)), ([], "toke?n? =", 18)):
        got, read = search_index.indexed_search(docs, index, words, pattern=pattern)
        assert rows_of(got, "doc_id") == rows_of(retrieval.keyword_search(docs, words, pattern=pattern), "doc_id")
        assert read.count() <= most


@pytest.mark.parametrize(("pattern", "parts"), [
    ("token = [0-9]{8}", ["token = "]), ("abcd*efg", ["abc", "efg"]), ("abcd+efg", ["abcd", "efg"]), ("a|bcdef", []), ("(abc)def", []),
    (r"abc\.def", ["abc", "def"]), ("abc{2}defg", ["defg"]), ("^abc$", ["abc"]), ("[abc]def", ["def"]), ("", [])])
def test_literal_parts_are_in_every_match(pattern, parts):
    assert search_index.literals_of(pattern) == parts
    for text in ("token = 12345678", "abccefg", "abcefg", "abcdefg", "abcddefg", "abc.def", "abccdefg", "abc", "adef"):
        if re.search(pattern, text):
            assert all(p in text for p in parts)


def test_a_gram_that_all_texts_have_lies_in_many_files(spark):
    docs = spark.range(0, 4000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("the "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = search_index.trigram_index(docs, f"{shared_dir(spark)}/t")
        files = index.filter(F.col("gram") == int(search_index._grams("the")[0][0])).groupBy(F.col("_metadata.file_path")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in files) == 4000
    whole = index.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count"), F.sum("count")).first()
    assert whole[0] < whole[1] / 20


def test_postings_travel_packed_and_lose_no_place(spark, frame):
    """More texts than a pack takes, texts without a trigram, and places beyond 15 bits."""
    texts = [f"text {k % 7} of {k}" for k in range(300)] + ["", "ab", "x" * 70_000 + " needle"]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "t": texts})
    packed = search_index._postings(batch, 0, 100)
    assert packed.num_rows == len({g for t in texts[:100] for g in search_index._grams(t)[0].tolist()})
    docs = frame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    index = search_index.trigram_index(docs, f"{shared_dir(spark)}/t")
    want = {}
    for doc, text in enumerate(texts):
        gram, at = search_index._grams(text)
        for g, place in zip(gram.tolist(), at.tolist(), strict=True):
            want.setdefault((g, doc), []).append(place)
    assert {(r["gram"], r["doc"]): r["places"] for r in index.collect()} == want and index.count() == len(want)


def test_cells_change_no_row_and_save_products(spark):
    """Clustered vectors, ties, repeated rows, two lengths, and vectors that have no cosine."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 8))
    x = (middles[rng.integers(12, size=900)] + 0.05 * rng.normal(size=(900, 8))).round(3)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[k % 5].tolist()) for k in range(40)]
    rows += [(2000 + k, [1.0, float(k)]) for k in range(5)] + [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(4)
    asks = df.filter("vec_id % 10 = 0 or vec_id >= 2000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = retrieval.nearest(df, asks, 4)
    got, counted = vector_cells.nearest_in_cells(df, asks, 4)
    assert rows_of(got, "query_id", "vec_id", "score", "rank") == rows_of(want, "query_id", "vec_id", "score", "rank")
    n = counted.first()
    assert 0 < n["n_products"] < n["n_all"] / 3
    assert vector_cells.nearest_in_cells(df.limit(0), asks, 4)[0].count() == 0
    assert vector_cells.nearest_in_cells(df, asks.limit(0), 4)[0].count() == 0
    more = vector_cells.nearest_in_cells(df, asks, 2000)[0]  # more than there are
    assert rows_of(more, "query_id", "vec_id") == rows_of(retrieval.nearest(df, asks, 2000), "query_id", "vec_id")


def test_a_large_cell_is_dealt_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector_cells, "CHUNK", 50)
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") % 3 > 0, F.lit(0.5)).otherwise(F.col("id") / 10)).alias("embedding"))
    asks = df.filter("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = vector_cells.nearest_in_cells(df, asks, 5)[0]
    assert rows_of(got, "query_id", "vec_id", "rank") == rows_of(retrieval.nearest(df, asks, 5), "query_id", "vec_id", "rank")


def test_a_task_holds_a_block_of_the_queries_of_a_cell(spark, monkeypatch):
    rows_at_once = vector_cells._rows

    def small(column):
        if len(column) > 250:
            raise ValueError(f"{len(column)} vectors in one task")
        return rows_at_once(column)

    rng = np.random.default_rng(5)
    data = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(600)], "vec_id long, embedding array<double>")
    asks = data.selectExpr("vec_id query_id", "embedding query")
    want = sorted(map(tuple, vector_cells.nearest_in_cells(data, asks, 3)[0].collect()))
    monkeypatch.setattr(vector_cells, "_rows", small)
    for name, value in (("FIT_ROWS", 100), ("CELLS", 1), ("CHUNK", 100), ("BLOCK", 100), ("AT_ONCE", 7)):
        monkeypatch.setattr(vector_cells, name, value, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, vector_cells.nearest_in_cells(data, asks, 3)[0].collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_go_to_a_bundle_of_cells_and_not_to_each(spark, monkeypatch):
    """Vectors spread evenly, so that all cells are visited: each goes to a few tasks all the same."""
    rows_of_column, handed = vector_cells._rows, spark.sparkContext.accumulator(0)

    def counted(column):
        handed.add(len(column))
        return rows_of_column(column)

    rng = np.random.default_rng(9)
    data = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=24)]) for i in range(500)], "vec_id long, embedding array<double>")
    asks = data.selectExpr("vec_id query_id", "embedding query")
    want = rows_of(retrieval.nearest(data, asks, 3))
    monkeypatch.setattr(vector_cells, "_rows", counted)
    got, n = vector_cells.nearest_in_cells(data, asks, 3)
    assert rows_of(got) == want and n.first()["n_all"] == 250_000
    assert handed.value <= 10 * 500  # twice the sample and the bounds, and once each side of either visit
    monkeypatch.setattr(vector_cells, "_rows", rows_of_column)
    for name, value in (("CHUNK", 60), ("BLOCK", 70), ("AT_ONCE", 11), ("PRODUCTS", 200), ("LEAST", 1), ("HELD", 24 * 50)):
        monkeypatch.setattr(vector_cells, name, value)
    assert rows_of(vector_cells.nearest_in_cells(data, asks, 3)[0]) == want
    same = spark.range(300).selectExpr("id vec_id", "array(1.0D, 2.0D) embedding")  # all tie
    asks = same.selectExpr("vec_id query_id", "embedding query")
    assert rows_of(vector_cells.nearest_in_cells(same, asks, 3)[0]) == rows_of(retrieval.nearest(same, asks, 3))
