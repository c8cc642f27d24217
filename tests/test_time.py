"""Knowledge intervals, as-of merges, running totals and introduction paths against brute force, hot keys included."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bitemporal, ordered, relations, star, temporal
from ledgerloom.sources.landing import materialize
from tests.conftest import rows_of
from tests.test_skew import cluster_like, final_plan

START = datetime(2020, 1, 1)
BATCH = "key string, a string, b int, at timestamp_ntz, seq int, gone boolean"


def t(n):
    return START + timedelta(days=int(n))


def learn(table, batch, known):
    if table is None:
        table = bitemporal.nothing_known(batch, "key", ["a", "b"], "at")
    out = bitemporal.learn(table, batch, "key", ["a", "b"], "at", str(known), ["seq"], "gone")
    return bitemporal.Knowledge(materialize(out.state), out.rejected)


def replay(batches, known, valid):
    """Attributes of each key at `valid` from the batches known by then, one by one."""
    told = {}
    for k, rows in batches:
        if k <= known:
            for key, a, b, at, seq, gone in sorted(rows, key=lambda r: r[4]):
                if key is not None and at is not None:
                    told[key, at] = None if gone else (a, b)
    out = {}
    for (key, at), said in sorted(told.items(), key=lambda x: x[0][1]):
        if said and at <= valid:
            out[key] = (*said, at)
    return sorted([(k, *x) for k, x in out.items()], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_what_was_known_is_what_a_replay_gives(frame, seed):
    rng = np.random.default_rng(seed)
    batches, table = [], None
    for n in range(4):
        rows = [
            (["hot", "hot", "k1", "k2", None][rng.integers(5)], "xyz"[rng.integers(3)] if rng.random() < 0.8 else None, int(rng.integers(2)),
             t(rng.integers(12)) if rng.random() < 0.95 else None, i, bool(rng.random() < 0.2))
            for i in range(25)]
        batches.append((t(100 + 10 * n), rows))
        got = learn(table, frame(rows, BATCH).repartition(3), t(100 + 10 * n))
        assert got.rejected.count() == sum(r[0] is None or r[3] is None for r in rows)
        table = got.state
    for known in (t(99), t(100), t(115), t(120), t(200)):
        for valid in (t(-1), t(0), t(5), t(11), t(50)):
            seen = temporal.as_of(table, F.lit(valid).cast("timestamp_ntz"), F.lit(known).cast("timestamp_ntz"))
            assert rows_of(seen, "key", "a", "b", "valid_from") == replay(batches, known, valid), (known, valid)
    now = temporal.as_of(table, F.lit(t(50)).cast("timestamp_ntz"))
    assert rows_of(now, "key", "a", "b", "valid_from") == replay(batches, t(200), t(50))
    again = learn(table, frame(batches[-1][1], BATCH), t(300)).state
    assert rows_of(again) == rows_of(table)


def test_only_known_to_is_ever_rewritten(frame):
    first = learn(None, frame([("k", "x", 1, t(0), 0, False), ("other", "y", 1, t(3), 0, False)], BATCH), t(100)).state
    second = learn(first, frame([("k", "z", 1, t(5), 0, False)], BATCH), t(110)).state
    end = datetime(9999, 12, 31)
    assert rows_of(second, "key", "a", *bitemporal.INTERVALS) == sorted([
        ("k", "x", t(0), end, t(100), t(110)), ("k", "x", t(0), t(5), t(110), end), ("k", "z", t(5), end, t(110), end),
        ("other", "y", t(3), end, t(100), end)], key=repr)
    late = learn(second, frame([("k", "w", 1, t(2), 0, False)], BATCH), t(120)).state
    assert rows_of(late.filter("known_to > '9000-01-01'"), "key", "a", "valid_from", "valid_to") == sorted([
        ("k", "x", t(0), t(2)), ("k", "w", t(2), t(5)), ("k", "z", t(5), end), ("other", "y", t(3), end)], key=repr)


def test_learning_of_a_hot_key_is_cut(spark):
    rows = spark.range(0, 30_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("key"),
        F.col("id").cast("string").alias("a"), F.lit(1).alias("b"),
        F.timestamp_micros(F.col("id") * 1000000).cast("timestamp_ntz").alias("at"), F.lit(0).alias("seq"), F.lit(False).alias("gone"))
    sizes = []

    def keep(df):
        out = materialize(df)
        if "_part" in df.columns:
            sizes.append(max(r["count"] for r in out.groupBy("_part").count().collect()))
        return out

    with cluster_like(spark):
        table = bitemporal.nothing_known(rows, "key", ["a", "b"], "at")
        got = bitemporal.learn(table, rows, "key", ["a", "b"], "at", "2021-01-01", ["seq"], "gone", keep).state
        assert got.filter("key = 'hot'").count() == 10_000 and max(sizes) < 5_000
        assert got.filter("key = 'hot' and valid_to = valid_from + interval 3 seconds").count() == 9_999


FACT, DIM = "id int, k string, at date, x string", "k string, sk string, valid_from date, valid_to date"


@pytest.mark.parametrize("seed,crossing", [(1, False), (2, True), (3, True)])
def test_asof_join_equals_the_join_by_window(frame, seed, crossing):
    rng = np.random.default_rng(seed)
    keys = ["hot"] * 4 + ["a", "b", None]
    facts = [(i, keys[rng.integers(7)], t(rng.integers(60)).date() if rng.random() < 0.95 else None, "x" * int(rng.integers(3))) for i in range(300)]
    versions = []
    for k in ("hot", "a", "none"):
        cuts = sorted(rng.choice(60, 12, replace=False))
        for n, (p, q) in enumerate(zip(cuts, cuts[1:])):
            longer = int(rng.integers(-2, 20)) if crossing and rng.random() < 0.4 else 0
            versions.append((k, f"{k}{n}", t(p).date(), t(q + longer).date()))
    versions += [(None, "null", t(0).date(), t(90).date()), ("a", "empty", t(9).date(), t(9).date()), ("a", "open", t(1).date(), None)]
    fact, dim = frame(facts, FACT), frame(versions, DIM)
    want = star.pit_join(fact, "at", dim, "k", "sk")
    got = ordered.asof_join(fact.repartition(5), "at", dim, "k", "sk")
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_asof_join_without_facts_or_versions(frame):
    fact, dim = frame([(1, "a", t(1).date(), "x")], FACT), frame([("a", "s", t(0).date(), t(9).date())], DIM)
    assert rows_of(ordered.asof_join(fact, "at", dim.limit(0), "k", "sk"), "id", "sk") == [(1, None)]
    assert ordered.asof_join(fact.limit(0), "at", dim, "k", "sk").count() == 0


def test_asof_join_cuts_a_hot_key_on_both_sides(spark):
    """A third of the facts and of the versions belong to one key."""
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")))
    fact = spark.range(0, 40_000, numPartitions=8).select("id", hot.alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9000).cast("int")).alias("at"))
    dim = spark.range(0, 9_000, numPartitions=8).select(
        F.lit("hot").alias("k"), F.col("id").cast("string").alias("sk"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("valid_from"))
    dim = dim.withColumn("valid_to", F.date_add("valid_from", 1))
    sizes = []

    def keep(df):
        out = materialize(df)
        if "_part" in df.columns:
            sizes.append(max(r["count"] for r in out.groupBy("_part").count().collect()))
        return out

    with cluster_like(spark):
        out = ordered.asof_join(fact, "at", dim, "k", "sk", keep)
        assert out.count() == 40_000 and out.filter("k = 'hot' and sk <> cast(id % 9000 as string)").count() == 0
        assert out.filter("sk is not null").count() == out.filter("k = 'hot'").count()
        assert max(sizes) < 8_000  # of 49,000 rows, 22,000 of them of the hot key


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_running_totals_equal_a_plain_walk(frame, keys):
    rng = np.random.default_rng(len(keys))
    rows = [(i, [None, "a", "b", "hot", "hot", "hot"][rng.integers(6)], int(rng.integers(2)), int(rng.integers(50)), int(rng.integers(9)) if rng.random() < 0.8 else None)
            for i in range(400)]
    df = frame(rows, "id int, k string, j int, at int, v int").repartition(7)
    got = ordered.running_total(df, keys, ["at", "id"], {"total": F.col("v"), "n": F.lit(1)})
    want, sums = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        group = tuple(r[1 + ["k", "j"].index(c)] for c in keys)
        total, n = sums.get(group, (None, 0))
        total = total if r[4] is None else (total or 0) + r[4]
        sums[group] = (total, n + 1)
        want.append((r[0], total, n + 1))
    assert rows_of(got, "id", "total", "n") == sorted(want, key=repr)
    assert got.columns == [*df.columns, "total", "n"]


def test_running_totals_have_no_task_with_all_rows(spark):
    df = spark.range(0, 50_000, numPartitions=8).select("id", F.lit("hot").alias("k"))
    sizes = []

    def keep(rows):
        out = materialize(rows)
        sizes.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out

    with cluster_like(spark):
        out = ordered.running_total(df, ["k"], ["id"], {"total": F.col("id")}, keep)
        assert "SinglePartition" not in final_plan(out)
        assert max(sizes) < 8_000 and sum(sizes) == 50_000
        assert out.filter(F.col("total") != F.col("id") * (F.col("id") + 1) / 2).count() == 0


AFF = "person_id string, company_id string, role string, start_date date, is_past boolean"


def brute_paths(links, ours, seeds, k, people):
    edges = {}
    for p, c, _ in links:
        edges.setdefault(p, set()).add(c)
        edges.setdefault(c, set()).add(p)
    now = {(p, c) for p, c, past in links if not past}
    out = []
    for s in seeds:
        found, dist, paths = {}, {s: 0}, [(s,)]
        for hops in range(1, 2 * people + 1):
            if hops % 2 == 0:
                for path in paths:
                    for c in ours:
                        if (path[-1], c) in now and c not in path:
                            found.setdefault(c, {}).setdefault(hops, set()).add((*path, c))
            paths = [(*path, x) for path in paths for x in edges.get(path[-1], ()) if dist.get(x, hops) >= hops]
            for path in paths:
                dist[path[-1]] = hops
        for c, by in found.items():
            fewest = min(by)
            out += [(s, c, fewest, n + 1, list(path)) for n, path in enumerate(sorted(by[fewest])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intro_paths_equal_a_walk_with_a_hub_person(frame, seed):
    rng = np.random.default_rng(seed)
    links = {(f"P{rng.integers(30):02}", f"C{rng.integers(25):02}", bool(rng.random() < 0.5)) for _ in range(60)}
    links |= {("P00", f"C{c:02}", bool(rng.random() < 0.5)) for c in range(0, 25)}  # a third of the links are one person's
    ours, seeds = [f"C{c:02}" for c in range(0, 25, 3)], ["C01", "C02", "C03"]
    people = frame([(p, c, "r", None, past) for p, c, past in links], AFF)
    start = frame([(s, s) for s in seeds], "seed string, node string")
    got = relations.intro_paths(people, frame([(c,) for c in ours], "company_id string"), start, k=2)
    assert rows_of(got, "seed", "company_id", "hops", "rank", "path") == brute_paths(links, ours, seeds, 2, 2)
