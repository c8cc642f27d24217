"""Near duplicates of documents and vectors, and components, against brute force."""

import random

import numpy as np
import pytest

from ledgerloom.llm import near_dup, vector_dedup
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.scratch import Scratch


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(200)]
    links += [(5000, 5001 + k) for k in range(300)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "a bigint, b bigint")
    want = Groups({x for link in links for x in link})
    for a, b in links:
        want.join(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = connected_components(df, Scratch(spark, "test"))
    assert sorted(map(tuple, got.collect())) == sorted((x, want.find(x)) for x in linked)
    assert connected_components(df.limit(0), Scratch(spark, "test")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, hundredths=85):
    sets, groups = {k: shingles(t) for k, t in rows}, Groups([k for k, _ in rows])
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= hundredths * len(x | y):
                groups.join(a, b)
    return {k: (len(sets[k]), groups.find(k)) for k in keys}


def found(df, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert len(got) == len(rows)
    return got


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize(("seed", "hundredths", "rounds"), [(1, 85, 0), (2, 80, 2), (3, 95, 1), (2, 80, 0)])
def test_documents_match_brute_force(spark, seed, hundredths, rounds):
    """Chains of edits around the threshold, one large group of near copies, a passage that many share, and odd texts."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", "  \t ", "one two three", "One  TWO\nthree", "a b c d", "x" * 100_000, "É é", "é É", "same " * 300]
    big = words(200)
    texts += [edited(big, rng.randint(0, 4), rng) for _ in range(80)]
    for _ in range(15):
        step = " ".join(words(rng.choice([6, 30, 120])))
        for _ in range(rng.randint(1, 5)):
            texts.append(step)
            step = edited(step.split(), 1, rng)
    passage = words(60)
    texts += [" ".join(words(rng.randint(5, 60)) + passage) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, n int, id string")
    got = near_dup.near_duplicates(df, hundredths=hundredths, rounds=rounds)
    assert found(got, rows) == brute(rows, hundredths)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("edits", [7, 10])
def test_a_large_group_of_near_copies_makes_about_as_many_pairs_as_members(spark, monkeypatch, edits):
    """1,000 copies of one text; at 10 edits the worst lie around 0.8 of the text itself and below it of each other; the rows of pairs whose sketches are compared are counted."""
    rng = random.Random(edits)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(k, edited(base, rng.randint(0, edits), rng)) for k in range(1000)]
    made = []
    similarity = near_dup._similarity

    def counted(pairs, *rest):
        made.append(pairs.count())
        return similarity(pairs, *rest)

    monkeypatch.setattr(near_dup, "_similarity", counted)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), hundredths=80)
    near = [(r["doc_id"], r["component_id"]) for r in got.collect()]
    assert dict(near) == {k: c for k, (_, c) in brute_fast(rows, 80).items()}
    assert sum(made) <= 4 * len(rows), made


def brute_fast(rows, hundredths):
    """As `brute`, by matrix products."""
    sets = [shingles(t) for _, t in rows]
    at = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(rows), len(at)), np.float32)
    for k, x in enumerate(sets):
        held[k, [at[y] for y in x]] = 1
    size = held.sum(axis=1)
    common = held @ held.T
    links = np.argwhere(100 * common >= hundredths * (size[:, None] + size[None, :] - common))
    groups = Groups([k for k, _ in rows])
    for a, b in links.tolist():
        groups.join(rows[a][0], rows[b][0])
    return {k: (int(n), groups.find(k)) for (k, _), n in zip(rows, size)}


def test_documents_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert found(near_dup.near_duplicates(df), rows) == brute(rows)


def test_bounds_follow_from_the_threshold(spark):
    assert near_dup.least_shared(0.8) < near_dup.least_shared(0.85) < 0.85 * near_dup.SKETCH
    assert near_dup.most_differing(0.85) < near_dup.most_differing(0.8)
    with pytest.raises(ValueError):
        near_dup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"), hundredths=79)


def test_no_documents(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_union_estimate_is_exact_for_small_sets():
    a, b = np.array([1, 2, 3, 9]), np.array([2, 3, 4])
    assert near_dup.union_estimate(a, b) == 2 / 5 and near_dup.union_estimate(a, a[:0]) == 0.0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, centre = [], rng.standard_normal((12, 16))
    for k in range(400):
        v = centre[k % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.08, 0.15, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 2)))
    rows += [(500 + k, rows[0][1], 0) for k in range(30)] + [(600, rows[0][1], 1)]  # equal vectors, one with another label
    rows += [(700, [x * 3 for x in rows[0][1]], 0), (701, None, 0), (702, [], 0), (703, [0.0] * 16, 0), (704, [float("nan")] * 16, 0)]
    rows += [(705, [None] * 16, 0), (706, [float("inf")] + [1.0] * 15, 0), (707, rows[0][1], None), (708, rows[0][1][:8], 0), (709, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, id int, n_links int")
    good = [(k, np.array(v, float), l) for k, v, l in rows
            if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    groups, links = Groups([r[0] for r in rows]), dict.fromkeys((r[0] for r in rows), 0)
    for i, (a, x, l) in enumerate(good):
        for b, y, m in good[i + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == {k: (links[k], groups.find(k), groups.find(k) == k) for k in links}
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_layout_grows_with_the_classes():
    assert [vector_dedup.layout(n, 0.98)[0] for n in (0, 1000, 10**6, 10**9)] == sorted(vector_dedup.layout(n, 0.98)[0] for n in (0, 1000, 10**6, 10**9))
