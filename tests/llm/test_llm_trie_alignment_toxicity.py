"""Conversation trie, token alignment and toxicity against brute force and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import prefix_trie, token_alignment, toxicity
from tests.conftest import rows_of

TURNS = "conv_id bigint, turn bigint, role string, text string"
NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(turns):
    """The contract, read literally: every prefix as a tuple."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = {x for x in below if len(x) == len(node) + 1}
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in ids if whole[c] == node)
        out.append((len(node), ids[0], members[node[:-1]][0] if node else None, len(ids), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=130):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        same = rng.random() < 0.4  # a large group of conversations that are one and the same
        for t in range(3 if same else rng.integers(0, 7)):
            text = f"turn {t}" if same else [None, "", "a b", "ä b  c", "x"][rng.integers(5)]
            out.append((c, [t, t, None][rng.integers(3)] if not same else t, [None, "user", "assistant"][rng.integers(3)] if not same else "user", text))
    return out + [(None, 0, "user", "nobody's"), (7, 1, "user", "again"), (7, 1, "user", "again"), (41, 90, "user", "w " * 5000)]


@pytest.mark.parametrize("shard", [1, 7, 10_000])
def test_trie_is_that_of_the_definition_however_it_is_cut(frame, shard):
    turns = conversations(shard)
    got = prefix_trie.prefix_trie(frame(turns, TURNS).repartition(5), shard)
    assert rows_of(got, *NODE) == brute_trie(turns)


def test_trie_matches_its_sql(frame):
    turns = conversations(3)
    con = duckdb.connect()
    table = frame(turns, TURNS).toArrow()
    con.register("conversations", table)
    want = con.execute(f"SELECT {', '.join(NODE)} FROM ({prefix_trie.SQL})").fetchall()
    assert sorted(want, key=repr) == brute_trie(turns)


def test_trie_without_rows_and_with_other_columns(frame):
    assert prefix_trie.prefix_trie(frame([], TURNS)).count() == 0
    turns = [(20, 0, "user", "a"), (21, 0, "user", "b c"), (21, 1, "user", "d")]
    wide = frame([(*t, 1, 2, 3) for t in turns], TURNS + ", mark int, words int, shard int")
    assert rows_of(prefix_trie.prefix_trie(wide), *NODE) == brute_trie(turns)


def test_search_tree_is_balanced():
    trie = prefix_trie.Trie()
    trie.insert_all([[k] for k in range(1023)])

    def height(v):
        return 0 if v < 0 else 1 + max(height(trie.lo[v]), height(trie.hi[v]))

    assert height(trie.eq[0]) == 10


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, it's  here.\n\n\tA line\r\nand 12345 <|endoftext|> <s>", "Größe über naïve façade 漢字 🙂🙃", None, "", " ", "a",
    "The quick brown fox", "The quick brown fox", "bad ▁ piece", "  two leading", "trailing  ", "x" * 700, "\u0000\u0001 control ﻿",
    "combining é   nbsp 　 wide", "internationalization of tokenization " * 40,
]


def brute_alignment(texts):
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    byte = token_alignment._byte_of()
    names = {v: k for k, v in a_tok.get_vocab().items()}

    def piece(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    per, count = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        left, right = [bytes(byte[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not t or b"".join(left) != raw or b"".join(right) != raw:
            per.append(([], [], [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        cuts, links, text, i, j = sorted(set(a_end) & set(b_end)), [], [], 0, 0
        for cut in cuts:
            ii, jj = a_end.index(cut) + 1, b_end.index(cut) + 1
            text.append(",".join(map(str, a[i:ii])) + "|" + ",".join(map(str, b[j:jj])))
            links.append((a[ii - 1], b[jj - 1]))
            i, j = ii, jj
        count.update(links)
        per.append((a, b, links, hashlib.sha256(";".join(text).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(k, len(a), len(b), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha)
            for k, (a, b, links, sha) in enumerate(per)]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_matches_the_tokenizers_and_a_plain_walk(frame):
    docs = frame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, block string").repartition(3)
    got = token_alignment.align(docs, A, B)
    assert sorted(tuple(r) for r in got.select(*ALIGNED).collect()) == brute_alignment(TEXTS)


@pytest.mark.parametrize("part,remembered", [(9, 4), (400_000, 500_000)])
def test_alignment_of_remembered_segments_is_that_of_whole_texts(monkeypatch, part, remembered):
    monkeypatch.setattr(token_alignment, "PART", part)
    monkeypatch.setattr(token_alignment, "REMEMBERED", remembered)
    known = token_alignment.Segments(token_alignment.Tokenizers(A, B))
    rng = np.random.default_rng(1)
    parts = ["a", "The", "fox\n", "\t", "  ", "é漢", "▁", "x" * 60, " ", "\n\n", "end.", "'s", "1234", "\u3000", "🙂"]
    texts = TEXTS + ["".join(rng.choice(parts, 12)) for _ in range(60)] + [" ".join(rng.choice(parts, 12)) for _ in range(60)]
    want = brute_alignment(texts)
    got = [g for k in range(0, len(texts), 7) for g in known.aligned([t or "" for t in texts[k : k + 7]])]
    assert [(g[0], g[1], g[2], len(g[5]), g[4]) for g in got] == [(w[1], w[2], w[3], w[4], w[7]) for w in want]


def test_no_piece_joins_a_space_to_what_is_before_it():
    """Long texts are cut there."""
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    assert not [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.search("[^▁]▁", p)]


def test_alignment_with_null_and_repeated_ids_and_without_rows(frame):
    docs = frame([(None, "a b"), (1, "a b"), (1, "c")], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in token_alignment.align(docs, A, B).select("doc_id", "n_links", "count_sum").collect()), key=repr) == [
        (1, 1, 1), (1, 2, 4), (None, 2, 4)]
    assert token_alignment.align(docs.limit(0), A, B).count() == 0


def test_overlaps_expand_inside_groups():
    got = token_alignment.coalesce(np.array([4, 6, 9]), np.array([3, 6, 7, 9]), np.array([0, 4, 6]), np.array([0, 3, 6, 7]))
    assert got.group.tolist() == [0, 0, 1, 0, 0, 1, 1]
    assert list(zip(*(p.tolist() for p in got.pairs))) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]
    assert list(zip(*(p.tolist() for p in got.links))) == [(1, 1), (2, 3)]


def test_hits_of_the_lexicon_match_a_plain_search():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "idi*": 1.0, "trash": 2.0, "moron": 2.5})
    rng = np.random.default_rng(5)
    parts = ["idiot", "IDIOT!", "id10t", "idіot", "ｉｄｉｏｔ", "idi​ot", "idiots", "idioticallyyy", "trash", "trash can", "trash cans",
             "tr@sh", "1337", "455", "moron.", "oxymoron", "the", "m0r0n,", "$", "!", "éidiot"]
    for _ in range(200):
        text = " ".join(rng.choice(parts, rng.integers(0, 12)))
        flat = toxicity.folded(text)
        want = []
        for m in re.finditer(r"[^\W\d_]+", flat):
            w = m[0]
            weight = {"idiot": 3.0, "trash": 2.0, "moron": 2.5}.get(w, 0.0)
            if w.startswith("idi") and 0 < len(w) - 3 <= toxicity.TAIL:
                weight = max(weight, 1.0)
            if weight and not (w == "trash" and re.match(r"trash can(?![^\W\d_])", flat[m.start():])):
                want.append((m.start(), m.end(), weight))
        assert lexicon.hits(text) == want, text


def test_toxicity_learns_words_and_leaves_clean_texts_alone(frame):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for k in range(900):
        text = list(rng.choice(words, rng.integers(3, 60)))
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.integers(1, 4)):
                text.insert(rng.integers(len(text)), rng.choice(["zorgu", "Z0rgu", "quibblo", "zorgut"]))
        rows.append((k, " ".join(text), toxic))
    docs = frame([(k, t, "other", 1.0) for k, t, _ in rows] + [(None, None, "x", 0.0), (5000, "", None, 0.0)], "doc_id bigint, text string, label string, score double")
    labels = frame([(k, y) for k, _, y in rows] + [(1, None)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [(got[k]["predicted"], y) for k, _, y in rows if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    assert np.mean([p for p, y in held if y]) > 0.95 and np.mean([p for p, y in held if not y]) < 0.02
    assert 0 <= got[None]["score"] == got[5000]["score"] < 0.3
    one = toxicity.classify(docs.repartition(1), labels).collect()
    assert {r["doc_id"]: r["score"] for r in one} == {k: r["score"] for k, r in got.items()}


def test_toxicity_without_labels_uses_the_seed(frame):
    docs = frame([(1, "what an idiot"), (2, "good day"), (3, "put it in the trash can"), (4, "You M0R0N, stüpid " + "word " * 20000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, frame([], "doc_id bigint, toxic int")).collect()}
    assert got[1] == 1 and got[2] == 0 and got[3] == 0
    assert toxicity.classify(docs.limit(0), frame([], "doc_id bigint, toxic int")).count() == 0


def test_labels_of_held_out_rows_have_no_say(frame):
    docs = frame([(k, f"w{'abcdefgh'[k % 8]} word") for k in range(200)], "doc_id bigint, text string")
    flip = [(k, int(k % 8 == 0)) for k in range(200)]
    other = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in flip]
    scores = [{r["doc_id"]: r["score"] for r in toxicity.classify(docs, frame(x, "doc_id bigint, toxic int")).collect()} for x in (flip, other)]
    assert scores[0] == scores[1]
