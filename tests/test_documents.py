"""Documents, retrieval and scoring on small inputs, retrieval against brute force."""

import math
import re
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import mentions_number, numbers_in
from ledgerloom.operators import documents, evaluate, retrieval
from ledgerloom.plans.queries_documents import corpus
from tests.conftest import rows_of

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize("as_of, first, last", [
    ("2002-01-01", date(2000, 3, 31), date(2001, 12, 31)),
    ("2001-12-31", date(2000, 3, 31), date(2001, 12, 31)),
    ("2001-12-30", date(1999, 12, 31), date(2001, 9, 30)),
    ("2024-02-29", date(2022, 3, 31), date(2023, 12, 31)),
])
def test_quarter_ends(as_of, first, last):
    got = documents.quarter_ends(as_of)
    assert len(got) == 8 and got[0] == first and got[-1] == last and got == sorted(got)


def test_facts_read_back_what_was_written(ctx):
    docs = corpus(ctx)
    facts = evaluate.extract_facts(docs)
    told = docs.filter(~F.col("body_text").contains("undisclosed"))
    assert facts.count() == told.count()
    calls = facts.filter("document_type = 'capital_call_notice'").join(docs.select("lp_document_id", "refs"), "lp_document_id")
    assert calls.filter(F.size("refs") != 3).count() == 0
    scored = evaluate.score_answers(
        facts.select("expected_text", "expected_value", F.col("body_text").alias("answer"),
                     F.col("lp_document_id").alias("expected_id"), F.array("lp_document_id").alias("cited_ids")))
    assert scored.filter(~F.col("grounded") | ~F.col("cited_correctly")).count() == 0


def test_letters_name_two_to_four_holdings(ctx):
    letters = corpus(ctx).filter("document_type = 'quarterly_letter'").select((F.size("refs") - 1).alias("n"))
    low, high = letters.agg(F.min("n"), F.max("n")).first()
    assert 2 <= low <= high <= 4


def test_document_ids_are_unique(ctx):
    docs = corpus(ctx)
    assert docs.select("lp_document_id").distinct().count() == docs.count()


def test_manifest_orphans(frame):
    rows = frame([("d1", "company", "c1"), ("d1", "company", "c9"), ("d2", "company", "c9"), ("d2", "round", "r1")],
                 "lp_document_id string, entity_type string, entity_id string")
    known = {"company": frame([("c1",)], "id string"), "round": frame([("c9",), ("r1",)], "id string")}
    assert rows_of(documents.manifest_orphans(rows, known)) == [("company", 3, 2), ("round", 1, 0)]


def test_audit(frame):
    body = frame([("a",), ("b",), ("c",)], "doc string")
    state = frame([("a", "completed"), ("b", "failed"), ("b", "completed"), ("x", "completed")], "doc string, status string")
    row = documents.corpus_audit(body, state, "doc").first()
    assert (row["corpus_size"], row["attached"], row["missing"], row["extra"], row["completed"], row["complete"]) == (3, 4, 1, 1, 3, False)
    more = state.unionByName(frame([("y", "cancelled"), ("z", None)], "doc string, status string"))
    assert rows_of(documents.status_counts(more)) == sorted([("completed", 3), ("failed", 1), ("cancelled", 1), (None, 1)], key=repr)
    whole = frame([("a", "completed"), ("b", "completed"), ("c", "completed")], "doc string, status string")
    assert documents.corpus_audit(body, whole, "doc").first()["complete"] is True
    assert rows_of(documents.orphaned_failures(state, "doc")) == [("b", "failed")]
    assert documents.orphaned_failures(state.filter("status = 'failed'"), "doc").count() == 0


def brute_bm25(docs, questions, k):
    split = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    bags = {i: split(t) for i, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    out = []
    for q, text in questions:
        scored = []
        for i, bag in bags.items():
            total = 0.0
            for term in set(split(text)):
                tf, df = bag.count(term), sum(term in b for b in bags.values())
                if tf:
                    total += math.log1p((len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
            if any(t in bag for t in set(split(text))):
                scored.append((-round(total, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


WORDS = st.lists(st.sampled_from("red Blue green, étoile x1 the".split()), min_size=0, max_size=12).map(" ".join)


@SLOW
@given(st.lists(WORDS, min_size=1, max_size=8), st.lists(WORDS, min_size=1, max_size=3))
def test_bm25_against_brute_force(frame, texts, asked):
    docs, questions = list(enumerate(texts)), list(enumerate(asked))
    df = retrieval.bm25(frame(docs, "doc_id int, text string"), frame(questions, "question_id int, question string"), 3)
    got = sorted(tuple(r) for r in df.select("question_id", "doc_id", "score", "rank").collect())
    want = brute_bm25(docs, questions, 3)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_nearest_against_brute_force(frame):
    vecs = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(8)]) for i in range(60)] + [(99, [0.0] * 8)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    queries = vecs[3:6]
    got = retrieval.nearest(frame(vecs, "vec_id int, embedding array<float>"), frame(queries, "query_id int, query array<float>"), 5)
    want = []
    for q, v in queries:
        best = sorted(((-round(cos(v, e), 6), i) for i, e in vecs if any(e)))[:5]
        want += [(q, i, r + 1) for r, (_, i) in enumerate(best)]
    assert rows_of(got, "query_id", "vec_id", "rank") == sorted(want, key=repr)


def test_nearest_for_more_queries_than_a_block(frame):
    """Every vector asks, in several blocks and chunks; NULL, zero and shorter vectors are not compared."""
    vecs = [(i, [math.sin((i + 1) * (j + 1)) for j in range(4)]) for i in range(1001)] + [(2000, None), (2001, [0.0] * 4), (2002, [1.0, 2.0])]
    df = frame(vecs, "vec_id bigint, embedding array<double>")
    asked = df.selectExpr("vec_id as query_id", "embedding as query")
    got = retrieval.nearest(df, asked, 2, chunk=300, block=400).collect()
    assert len(got) == 1001 * 2 + 1 and {r["vec_id"] for r in got if r["query_id"] == 2002} == {2002}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in vecs[:1001]}
    for q in range(0, 1001, 100):
        best = sorted((-round(sum(a * b for a, b in zip(unit[q], u)), 6), i) for i, u in unit.items())[:2]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]


def test_nearest_without_queries(frame):
    vecs = frame([(1, [1.0])], "vec_id int, embedding array<float>")
    assert retrieval.nearest(vecs, frame([], "query_id int, query array<float>"), 5).count() == 0


def test_labels(frame):
    df = frame([(1, "Public"), (2, "Internal"), (3, "Confidential"), (4, "Highly Confidential"), (5, None), (6, "odd")],
               "id int, sensitivity_label string")
    ids = lambda level: [r["id"] for r in retrieval.visible(df, level).orderBy("id").collect()]
    assert ids("Public") == [1] and ids("Confidential") == [1, 2, 3] and ids("Highly Confidential") == [1, 2, 3, 4]


def test_numbers(frame):
    df = frame([("paid 1,234.50 and -3, 4. then 5,,6 x7",)], "t string").select(numbers_in("t").alias("n"))
    assert df.first()["n"] == [1234.5, -3.0, 4.0, 56.0, 7.0]


@SLOW
@given(st.lists(st.tuples(st.floats(0.01, 1e7), st.sampled_from([1, 100, 1e-3, 1e-6, 1e-9, 7.77]), st.floats(0.97, 1.03)), min_size=1, max_size=25))
def test_mentions_number(frame, cases):
    rows = [(i, f"about {v * scale * noise:,.12f} in all", v) for i, (v, scale, noise) in enumerate(cases)]
    df = frame(rows, "i int, t string, v double").select("i", mentions_number("t", "v", 0.02).alias("hit"))
    got = {r["i"]: r["hit"] for r in df.collect()}
    for i, text, value in rows:
        n = float(text.split()[1].replace(",", ""))
        want = any(abs(n - c) <= 0.02 * max(abs(c), 1e-9) for c in (value, value * 100, value / 1e3, value / 1e6, value / 1e9))
        assert got[i] == want


def test_scores(frame):
    df = frame([("m", "it is 5.0 million", "n/a", 5e6, "d1", ["d1"]), ("m", "no idea", "42x", 42.0, "d2", []),
                ("m", "about 42X", "42x", None, "d3", ["d9"]), ("m", "none", "q", None, "d4", None)],
               "leg string, answer string, expected_text string, expected_value double, expected_id string, cited_ids array<string>")
    row = evaluate.score_report(evaluate.score_answers(df), "leg").first()
    assert (row["cases"], row["grounded"], row["with_citation"], row["cited_correctly"]) == (4, 2, 2, 1)
    assert (row["grounded_rate"], row["citation_accuracy"], row["citation_coverage"]) == (0.5, 0.5, 0.5)
