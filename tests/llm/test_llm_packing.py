"""Packing: ids against the tokenizer, the plan against best-fit decreasing piece by piece, and odd rows."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.scratch import vocabulary

VOCABULARY = vocabulary("word_bpe_49k.json")


def best_fit_bins(lengths, capacity):
    """Number of bins that best-fit decreasing opens, one piece after the other."""
    left, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(left, n)
        if at == len(left):
            bins, room = bins + 1, capacity
        else:
            room = left.pop(at)
        insort(left, room - n)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100, 4096])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, max(1, capacity // 6)) for _ in range(rng.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.packing_plan(counts, capacity)
    held, placed = {}, dict.fromkeys(counts, 0)
    for length, rank, first, each, offset in plan.tolist():
        following = plan[(plan[:, 0] == length) & (plan[:, 1] > rank), 1]
        end = int(following.min()) if len(following) else counts[length]
        for r in range(rank, end):
            held.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
            placed[length] += 1
    assert placed == counts
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == best_fit_bins(lengths, capacity)


def test_tree_finds_the_tightest():
    tree, rng, held = packing.CapacityTree(50), random.Random(1), set()
    for _ in range(2000):
        x = rng.randint(0, 50)
        (held.discard if x in held else held.add)(x)
        tree.set(x, x in held)
        least = rng.randint(0, 50)
        assert tree.tightest(least) == min((h for h in held if h >= least), default=-1)


ODD = ["", " ", "Don't STOP's now", "a\u00a0b\u2003c", "x\x1cy\x85z", "<|endoftext|> a<|startoftext|>b", "ÉCOLE, straße!! 中文 ½ Ⅷ ٣",
       "e\u0301 \u0301x", "İstanbul ΣΑΣ", "a_b-c'd", "9" * 300, "w" * 500, "\n\n\t", "café… «ok»", "'''s 's", "😀👍🏽 ok"]


def test_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(VOCABULARY)
    tk = packing.WordTokenizer(VOCABULARY)
    rng = random.Random(5)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'s", "'", "<", "!", "9", "中", "_", ",", "ß", "ﬁ", "\u0301"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for _ in range(2):  # again from memory
        for text, ids in zip(texts, tk.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def check(got, texts, capacity, end_id=1):
    plain = Tokenizer.from_file(VOCABULARY)
    want = []
    for key, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        want += [(key, k // capacity, k, len(p), zlib.crc32(p.tobytes())) for k in range(0, len(ids), capacity) for p in [ids[k : k + capacity]]]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= capacity
    assert got.sequence_id.nunique() == best_fit_bins(got.length.tolist(), capacity)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    got = packing.pack_documents(docs, VOCABULARY).toPandas()
    check(got, [tuple(r) for r in docs.select("doc_id", "text").collect()], 4096)


def test_nulls_long_and_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, 9, 9, "x"), (2, "", 9, 9, "x"), (3, "word " * 500, 9, 9, "x"), (3, "word " * 500, 9, 9, "x"), (4, "a", 9, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int, sequence_id int, place string")
    got = packing.pack_documents(docs, VOCABULARY, capacity=64).toPandas()
    check(got, [r[:2] for r in rows], 64)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    got = packing.pack_documents(docs, VOCABULARY)
    assert got.count() == 0 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_lengths_outside_the_capacity_are_refused(spark):
    pieces = spark.createDataFrame(pd.DataFrame({"part": [0], "place": [0], "length": [9]}))
    with pytest.raises(ValueError):
        packing.pack(pieces, capacity=8)
