"""Quality classifier, personal data and language model: held-out accuracy, brute force and sums over all outcomes."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bit_mixing, lm, pii, quality

# ---- quality


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good = got.quality == 1
    assert len(got) > 50 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    assert (got.predicted[good] == 1).mean() >= 0.97 and (got.predicted[~good] == 0).mean() >= 0.85


def test_folds(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    for r in quality.classify(docs, labels).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end quality")
    scores = lambda l: sorted(map(tuple, quality.classify(docs, l).select("doc_id", "score").collect()))
    assert scores(labels) == scores(turned)


def test_odd_documents(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (3, "word " * 60_000, 0.5), (None, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 0), (9, 1)], "doc_id bigint, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {1.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(d))]
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),  # noqa: B023
                "card": lambda: 14 <= len(d) <= 19 and sum(n // 10 + n % 10 for n in twice) % 10 == 0,  # noqa: B023
                "phone": lambda: 10 <= len(d) <= 15}[kind]()  # noqa: B023
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(0)
    texts = ["a@b.c@d.e", "a@@b.c", "a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "0001.2.3.4", "1.2.3.0255 1.2.3.256", "4111 1111-1111 1111",
             "+1 (555) 123-4567 4111111111111111", "5" * 60, "é@b.c", "١٢٣.1.2.3", ""]
    pieces = ["a", "@", ".", "b-c", " ", "+1", "(555)", "12", "255", "4111111111111111", "\n", "é", "%", "1.2.3.4", "-"]
    texts += ["".join(rng.choice(pieces, rng.integers(0, 25))) for _ in range(4000)]
    for text in texts:
        assert pii.base_spans(text) == brute_base(text), text


def card(k):
    """Sixteen digits that pass the checksum."""
    head = f"45{k * 7919 % 10**6:06d}{k * 104729 % 10**7:07d}"
    return next(head + str(x) for x in range(10) if pii.luhn(head + str(x)))


@pytest.fixture(scope="module")
def field():
    texts = [f"some {w} words to mail{k}.{k}@host{k % 9}.example.com and {k % 256}.1.{k % 99}.7 then password={k:x}fe{k * 7919:x}a9{k * k:x}c0 end "
             f"+1 (5{k % 90 + 10}) 555-{1000 + k} or AKIA{'QWERTYUIOP'[k % 10]}7{'ZXCVBNMLKJ'[k // 10 % 10]}4QD9RK2PWM{k % 90 + 10} and {k} of {k * 13}, {card(k)} paid"
             for k, w in enumerate(["grey", "loud", "thin"] * 40)]
    return pii.fit(texts)


def test_added_spans(field):
    base, spans = pii.find("call +1 (269) 555-3296 4524132264652876 or password=7602ad27cf5550de1c now, page 12 of 300", field)
    text = "call +1 (269) 555-3296 4524132264652876 or password=7602ad27cf5550de1c now, page 12 of 300"
    assert base == brute_base(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [
        ("phone", "+1 (269) 555-3296"), ("card", "4524132264652876"), ("secret", "7602ad27cf5550de1c")]


def test_program_matches_all_segmentations(field):
    """The best segmentation and every marginal, against enumeration."""
    text = "x password=7602ad27cf5550de1c 1.2.3.4 +1 (555) 55"
    for atoms in pii.windows(text):
        cands = pii.candidates(text, atoms)

        def all_from(i):
            if i >= len(cands):
                yield []
                return
            for rest in all_from(i + 1):
                yield rest
            for j, f in cands[i]:
                for kind in pii.KINDS:
                    for rest in all_from(j):
                        yield [(kind, i, j, field.score(kind, f)), *rest]

        ways = list(itertools.islice(all_from(0), 200_000))
        if len(ways) == 200_000:
            continue
        total = sum(math.exp(sum(s[3] for s in way)) for way in ways)
        best = max(sum(s[3] for s in way) for way in ways)
        by = [dict(c) for c in cands]
        assert math.isclose(sum(field.score(k, by[i][j]) for k, i, j in field.best(cands)), best, abs_tol=1e-9)
        want = Counter()
        for way in ways:
            for kind, i, j, _ in way:
                want[i, j, kind] += math.exp(sum(s[3] for s in way)) / total
        got = field.expected(cands)
        assert all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)


def test_spans_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.detect(docs).collect():
        base = brute_base(texts[r["doc_id"]])
        assert r["base"] == pii.written(base)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert set(r["base"].split(",")) <= set(r["spans"].split(","))


def test_odd_texts_and_masks(spark, field):
    rows = [(1, None), (2, ""), (2, ""), (3, "a@b.co and 1.2.3.4!"), (4, "a" * 100_000 + "1" * 100_000 + "." * 1000), (5, "a1 " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: r for r in pii.detect(df, field=field).collect()}
    assert got[1]["spans"] == got[2]["spans"] == "" and got[3]["spans"] == "email:0:6,ip:11:18"
    masks = {r["doc_id"]: r["m"] for r in df.select("doc_id", pii.masked(field).alias("m")).collect()}
    assert masks[1] is None and masks[2] == "" and masks[3] == "<email> and <ip>!"
    assert pii.detect(df.limit(0)).count() == 0


def ordinary(k):
    return (f"row {k}: write to mail{k}.x@host{k % 9}.example.com or {'abcdefghij'[k % 10]}bc@{['build', 'localhost', 'relay'][k % 3]} from {k % 256}.1.{k % 99}.7, "
            f"password={k:x}fe{k * 7919:x}a9{k * k:x}c0, +1 (5{k % 90 + 10}) 555-{1000 + k}, page {k} of {k * 13}, {card(k)} paid")


def test_one_long_text_does_not_fill_the_fit(spark):
    """2,000 numbers in one text, before and after others in hash order, leave what the other texts teach."""
    numbers = " ".join(str(k * 37 % 10_007) for k in range(2_000))
    rows = [(k, ordinary(k)) for k in range(60)] + [(100 + k, f"{numbers} {k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    field = pii.fit_on(docs)
    text = "now jane@localhost, password=7602ad27cf5550de1c and +1 (269) 555-3296; page 12 of 300 by sum@2 x"
    spans = [(k, text[a:b]) for k, a, b in pii.find(text, field)[1]]
    assert [x for x in spans if x[0] != "email"] == [("secret", "7602ad27cf5550de1c"), ("phone", "+1 (269) 555-3296")]
    assert ("email", "jane@localhost") in spans
    assert pii.fit([t for _, t in rows]).w == field.w
    assert pii.fit_on(docs.repartition(7)).w == field.w


def test_windows_are_cut_between_entities():
    text = " ".join([*(str(k) for k in range(500)), "+1 (269) 555-3296 x", *(str(k) for k in range(700)), "1." * 3000, "9" * 5000])
    found = pii.taught_windows(text, each=1000)
    assert sum(w[0] == "phone" for w in found) == 1 and len(found) > 5
    for kind, _, around, lo, hi, spans in found:
        assert hi - lo <= pii.FIT_CHARS + 50 and len(around) <= hi - lo + 2 * pii.AROUND
        assert all(lo <= a and b <= hi for _, a, b in spans) and kind == (spans[0][0] if spans else "")
    assert len(pii.taught_windows(text)) <= 3 * pii.FIT_EACH


# ---- language model


def test_base_scores_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = {r["doc_id"]: [*r["text"].encode().lower().split(), b""] for r in docs.collect()}
    out = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    c = Counter(t for k, ts in tokens.items() if not out[k] for t in ts)
    total = sum(c.values())
    rows = lm.score_documents(docs).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        ts = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(ts), sum(c[t] > 0 for t in ts), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 0.1) / (total + 0.1 * (len(c) + 1))) for t in ts), rel_tol=1e-9)
        assert r["score"] < 0 and math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / r["n_bytes"])


def test_scores_do_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    monkeypatch.setattr(lm, "BLOCK", 20_000)
    scores = lambda df: {r["doc_id"]: (r["n_known"], r["base_score"]) for r in lm.score_documents(df).collect()}
    one, many = scores(docs.coalesce(1)), scores(docs.repartition(5))
    assert one.keys() == many.keys() and all(one[k][0] == many[k][0] and math.isclose(one[k][1], many[k][1], rel_tol=1e-12) for k in one)


def test_word_codes_are_a_distribution():
    """Over all words of up to two bytes, with what the longer ones have left: never more than one."""
    words = [b"a", b"ab", b"ba", b"abc", b"b", b""] * 5
    table = np.zeros((bit_mixing.SLOTS, 2), np.uint32)
    bit_mixing.count(words, table)
    mixer = bit_mixing.Mixer(bit_mixing.squeezed(table))
    mixer.learn(words)
    letters = [bytes([b]) for b in range(256) if b != 32]
    every = [b"", *letters, *(a + b for a in letters for b in letters)]
    p = np.exp2(-mixer.bits(every))
    assert p.sum() <= 1 + 1e-6 and p[every.index(b"a")] > p[every.index(b"z")]


def test_mixing_learns(spark):
    table = np.zeros((bit_mixing.SLOTS, 2), np.uint32)
    rng = np.random.default_rng(0)
    word = lambda: b"".join(rng.choice([b"ba", b"ko", b"li", b"ti", b"nu"], rng.integers(1, 5)))
    words = [word() for _ in range(3000)]
    bit_mixing.count(words, table)
    mixer = bit_mixing.Mixer(bit_mixing.squeezed(table))
    before = mixer.bits([word() for _ in range(300)]).mean()
    mixer.learn(words)
    assert mixer.bits([word() for _ in range(300)]).mean() < before < 40


def test_tails_are_those_of_the_running_text():
    words = [b"a", b"bc", b"", b"long word".replace(b" ", b"-"), b"xyz", b"wxyz"]
    texts = [[0, 0, 0, 1, 0, 2], [2], [3, 4, 0, 5, 1, 1, 2]]
    before, tail = lm.running(np.array(sum(texts, [])), np.array([0, 6, 7]), words)
    at = 0
    for ids in texts:
        for k in range(len(ids)):
            ahead = b"\n\n\n\n" if not k else (b"\n\n\n\n " + b" ".join(words[i] for i in ids[:k]))[-4:]
            assert before[at] == (ids[k - 1] if k else -1) and int(tail[at]).to_bytes(4, "big") == ahead
            at += 1


def test_order_of_words_counts(spark):
    """A held-out text in the training texts' order against the same words turned round."""
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    chain = [f"w{k * 7919 % 97}" for k in range(97)]
    turn = lambda k: " ".join((chain[k % 97 :] + chain[: k % 97])[:40])
    rows = [(k, turn(k)) for k in range(400) if k not in held] + [(held[0], turn(5)), (held[1], " ".join(reversed(turn(5).split())))]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[held[0]] > 0.5 * got[held[1]]


def test_repeats():
    assert lm.repeats(np.array([3, 1, 3, 3, 1, 2])).tolist() == [0, 0, 1, 2, 1, 0]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A a\u00a0b " * 3000), (4, "A"), (None, "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, block int, c int")
    got = lm.score_documents(docs).collect()
    assert len(got) == 6 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score_documents(docs.limit(0)).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    alone = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0.0) and alone["score"] < 0


# ---- quality: features by hand


def test_pooled_vectors_and_output_follow_from_the_definition():
    """Sums over plain loops: places of words and shapes, context vectors, pooling and the two layers."""
    texts = ["Good words here, good words", "BAD!! stuff 123", "", "one"]
    model = quality.fit(texts * 3, [1, 0, 1, 0] * 3)

    def places(text):
        out = []
        for x in text.split():
            word = "".join(c for c in x if c.isalpha()).lower()
            shape, last = "", ""
            for c in x:
                k = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c
                shape += k if not shape.endswith(k * 2) else ""
            out.append((quality._place(word), quality._place(shape, 1)))
        return out

    for text in texts:
        want = []
        for side in (0, 1):
            at = [p[side] for p in places(text)]
            mean = sum((model.vectors[side][k].astype(float) for k in at), np.zeros(quality.DIMS)) / max(len(at), 1)
            want += [*mean, np.linalg.norm(mean), len(set(at)) / max(len(at), 1), np.log1p(len(at))]
        assert np.allclose(model.pooled(text), want, atol=1e-6)
        w1, b1, w2, b2 = model.layers
        z = np.tanh((np.array(want) - model.mean) / model.scale @ w1 + b1) @ w2 + b2
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z / model.temperature)), abs=1e-5)



def test_long_parts_are_read_to_their_end():
    """Parts that differ after their 24th class only, and texts without white space."""
    same = "a1-" * 8
    features = quality.Features()
    one, two = (features.places(same + tail) for tail in ("b2b2:::b2/b2", "b-b-b,,,22"))
    assert [len(x) for x in one] == [len(one[0])] * 2 and (len(one[1]) != len(two[1]) or (one[1] != two[1]).any())
    run = "abcdefghijklmnopqrstuvwxyzabcde"
    assert list(quality._parts(f"x {run}12 y")) == ["x", *(run[k : k + 3] for k in range(len(run) - 2)), "12", "y"]
    text = "漢字" * 300_000
    assert len(features.places(text)[0]) == 600_000 - quality.GRAM + 1


def test_fit_on_a_table_is_the_fit_of_its_texts(spark):
    """Neighbour sums and pooled rows come from tasks; a text of 50 MB among the fitted rows stays there."""
    rows = [(k, f"word{k % 7} and more{k % 5} of it, {'GOOD' if k % 2 else 'bad!!'} {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, quality int")
    model = quality.fit_on(docs, labels)
    known = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id")).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    want = quality.fit([dict(rows)[k] for k in known], [k % 2 for k in known])
    assert all((a == b).all() for a, b in zip(model.vectors, want.vectors)) and model.temperature == want.temperature
    assert all(model.score(t) == want.score(t) for _, t in rows)
    long = docs.unionByName(spark.range(1).selectExpr("3 doc_id", "repeat('plain words ', 4200000) text"))
    assert 0 <= quality.fit_on(long, labels).score("plain words") <= 1
