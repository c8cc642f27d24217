"""Neighbours against brute force, byte-level BPE against tiktoken, the pipeline, and the guard around the subpackage."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import ann, byte_bpe
from ledgerloom.llm.scratch import vocabulary

RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


def brute_neighbours(rows, k, asks):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if asks(i):
            near = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in good if j != i and len(x) == len(q))
            out[i] = near[:k]
    return out


def test_neighbours_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()], 10, lambda i: i % 20 == 0)
    got = ann.search(df, lambda key: key % 20 == 0).collect()
    held = {(r["query_id"], r["vec_id"]) for r in got}
    hits = sum((q, j) in held for q, near in want.items() for _, j in near)
    assert hits >= 0.9 * sum(map(len, want.values())) and len(got) == sum(map(len, want.values()))
    for q in want:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)


def test_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(k, same) for k in range(8)] + [(100, [1.0, 2.0, 4.0]), (200, None), (201, [0.0, 0.0, 0.0]), (202, [float("nan"), 1.0, 1.0]),
                                            (203, [None, 1.0, 1.0]), (204, []), (300, [5.0]), (400, [7.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")
    got = ann.search(df, lambda key: key % 100 == 0).collect()
    want = brute_neighbours(rows, 10, lambda i: i % 100 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(
        (q, n + 1, j, d) for q, near in want.items() for n, (d, j) in enumerate(near))
    assert ann.search(df.limit(0), lambda key: key % 100 == 0).count() == 0


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(1)
    x, q, centre, turn = rng.standard_normal((4000, 64)), rng.standard_normal(64), np.zeros(64), ann.rotation(64, 5)
    code, norm, c = ann.encode(x, centre, turn)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    u = q / np.linalg.norm(q)
    error = np.abs(signs @ (u @ turn) / 8 / c - (x / norm[:, None]) @ u)
    assert (error > ann.BOUND * np.sqrt(1 - c * c) / c / np.sqrt(63)).mean() < 0.02


@pytest.fixture(scope="module")
def both():
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


PIECES = ["a", "b", " ", "  ", "\n", " \n", "\t", "'s", "'", "é", "ß", "9", "٣", "²", "中文", "👍🏽", "\u0301", "\x00", "\xa0", "\x85", "\x1c",
          "_", "...", "!", "\u200d", "ﬀ", "İ", "Σς", "ing", "tion", " the"]


def test_ids_are_tiktokens_and_come_back(both):
    codec, plain = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "x" * 3000, "ab" * 2000, " " * 3000, "1234567890" * 40, "word " * 5000]
    ids = codec.encode(texts)
    for text, got in zip(texts, ids):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode_ordinary(text), text
    assert codec.decode(ids) == [t.encode() for t in texts]
    again = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    assert again.encode(texts[::-1])[::-1] == ids


def test_recursion_and_heap_agree(both):
    codec, plain = both
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghinorst é") for _ in range(rng.randint(2, 100))).encode() for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec._merge(words)] == [byte_bpe.merge_by_heap(codec.ranks, w) for w in words]


def test_bpe_over_rows(spark, both):
    rows = [(1, None), (2, ""), (3, "Hello, world!  ok\n"), (3, "Hello, world!  ok\n"), (4, "é" * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    got = byte_bpe.encode_and_decode(df, RANKS, public_tokenizers.PATTERN)
    want = sorted((k, (t or "").encode(), tuple(both[1].encode_ordinary(t or ""))) for k, t in rows)
    assert sorted((r["doc_id"], bytes(r["decoded"]), tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in got.collect()) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got.collect())
    assert byte_bpe.encode_and_decode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_vectors_without_an_id_take_no_part(spark):
    rows = [(None, [1.0, 0.1]), (0, [1.0, 0.0]), (1, [1.0, 0.2]), (1, [1.0, 0.2]), (2, [0.0, 1.0]), (None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, lambda key: key % 100 == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]  # repeated rows are candidates of their own


def test_pipeline(spark, sf_dir, tmp_path):
    """Each stage against its own input: columns stay, rejected and repeated documents go, spans are masked, the rest is packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("more", F.lit("x"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good, distinct, masked, packed = (spark.read.parquet(str(tmp_path / n)) for n, _ in corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lost = labels.where("quality = 1").join(good, "doc_id", "left_anti").count()
    assert lost <= 0.02 * labels.count() and good.join(labels.where("quality = 0"), "doc_id").count() <= 2
    assert distinct.select("text").distinct().count() == distinct.count() == masked.count()
    assert distinct.select("text").distinct().count() == good.select("text").distinct().count() or distinct.count() < good.count()
    assert masked.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count() == 0 and masked.where("n_chars <> length(text)").count() == 0
    assert packed.select("doc_id").distinct().count() == masked.count()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_keeps_one_row_of_each_group(spark, sf_dir):
    """Null ids, repeated rows, and one id with two texts of which one has a near copy."""
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(60))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2) + " end"), (1, text(2)), (2, text(3)), (2, text(3)),
            (3, text(4)), (3, text(5)), (4, text(4) + " end"), (5, text(5)), (6, text(6)), (7, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, more string")
    got = corpus_pipeline.distinct(spark, docs, sf_dir)
    want = [(None, text(0)), (None, text(1)), (1, text(2)), (2, text(3)), (3, text(4)), (3, text(5)), (6, text(6)), (7, None)]
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_without_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
