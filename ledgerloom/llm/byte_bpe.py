"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition (operator 10).

Spark deals out the texts; every worker process has one in-memory database that holds the merge table. Texts are cut
where white space begins, and parts met before are looked up. The matches of the pre-token pattern in new parts that are
not tokens as a whole go into a table of token-position rows. A recursive query joins neighbouring rows with the merge
table, contracts the leftmost pair of minimum rank of each word, and goes on with the words that changed until none does.
Decoding is a second query: the rows of token ids join the vocabulary and are aggregated in order of their position.

Pre-tokens of more than `LONG` bytes are contracted by a heap in Python instead: the recursive query keeps every step's
rows, which would be the square of the length. Both give the ids of the tiktoken library (tests/llm compares them).

Defined cases: a null text is an empty one, with no ids and an empty decoding; equal texts give equal ids; lone surrogates
cannot occur in Spark strings; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.scratch import groups, keyed, only

LONG = 160
REMEMBERED = 900_000
GROUP = 3_000_000
MEMORY = "350MB"

_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_SPACE_RUN = re.compile(r"\s ")
_WORD_START = re.compile(r"(?<=\S)(?= )")

ENCODE = """
WITH RECURSIVE step(n, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM words
  UNION ALL
  (WITH best AS MATERIALIZED (
     SELECT w, min(m.tok::BIGINT << 20 | pos) AS k
     FROM (SELECT w, pos, tok::BIGINT << 20 | lead(tok) OVER (PARTITION BY w ORDER BY pos) AS pair FROM step) JOIN merges m USING (pair)
     GROUP BY w)
   SELECT n + 1, s.w, s.pos - (s.pos > (k & 1048575))::INT, CASE WHEN s.pos = (k & 1048575) THEN (k >> 20)::INT ELSE tok END
   FROM step s JOIN best USING (w) WHERE s.pos <> (k & 1048575) + 1)
), steps AS MATERIALIZED (SELECT * FROM step)
SELECT w, tok FROM steps JOIN (SELECT w, max(n) AS n FROM steps GROUP BY w) USING (w, n) ORDER BY w, pos
"""

DECODE = "SELECT d, string_agg(piece, '' ORDER BY pos) AS piece FROM ids JOIN vocabulary USING (tok) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_heap(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Contracts the leftmost pair of minimum rank until none is left."""
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(piece):
            pair = piece[i] + piece[after[i]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if piece[i] is None or j >= len(piece) or piece[i] + piece[j] != pair:
            continue
        piece[i], piece[j] = pair, None
        after[i] = after[j]
        if after[i] < len(piece):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in piece if p is not None]


class Codec:
    """Ids and bytes of texts. What it remembers of parts and pre-tokens serves all tasks of a worker process."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.one = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        pairs = [(self.ranks[t[:i]] << 20 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                 if t[:i] in self.ranks and t[i:] in self.ranks]
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()), tok=pa.array([r for _, r in pairs], pa.int32()))
        # A byte b stands as the character 256 + b, so that any bytes are a valid string.
        self._table("vocabulary", tok=pa.array(self.ranks.values(), pa.int32()),
                    piece=pa.array(["".join(chr(256 + b) for b in t) for t in self.ranks], pa.string()))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of two bytes or more, by the recursive query."""
        if not words:
            return []
        length = np.array([len(w) for w in words])
        ends = np.cumsum(length)
        w = np.repeat(np.arange(len(words), dtype=np.int32), length)
        pos = (np.arange(ends[-1]) - np.repeat(ends - length, length)).astype(np.int32)
        tok = self.one[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("words", pa.table({"w": w, "pos": pos, "tok": tok}))
        got = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("words")
        ids = np.asarray(got.column("tok")).astype("<u4").tobytes()
        last = np.searchsorted(np.asarray(got.column("w")), np.arange(len(words)), side="right").tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *last], last)]

    def _learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Adds the pre-tokens of the parts to `known`. Parts of several are not kept there, but returned."""
        known, cut, new = self.known, [], set()
        for x in parts:
            m = _PLAIN.fullmatch(x)
            if m is None:
                tokens = self.pattern.findall(x)
            elif m[2]:
                tokens = m.groups()
            else:
                new.add(x)
                continue
            cut.append((x, tokens))
            new.update(tokens)
        short = []
        for t in new.difference(known):
            raw = t.encode("utf-8")
            if raw in self.ranks:
                known[t] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > LONG:
                known[t] = np.array(merge_by_heap(self.ranks, raw), "<u4").tobytes()
            else:
                short.append((t, raw))
        known.update(zip([t for t, _ in short], self._merge([raw for _, raw in short])))
        return {x: b"".join([known[t] for t in tokens]) for x, tokens in cut if x not in known}

    @staticmethod
    def _parts(text: str) -> list[str]:
        """The text cut where a space follows something else than white space: no match of the pattern goes across."""
        if "\0" in text or _SPACE_RUN.search(text):
            return _WORD_START.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for group in groups(texts, GROUP):
            split = [self._parts(t) for t in group]
            all_parts = set().union(*split)
            new = all_parts.difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, all_parts
            several = self._learn(new)
            self.known.update(several)
            get = self.known.__getitem__
            out += [b"".join(map(get, s)) for s in split]
            for x in several:
                del self.known[x]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        out: list[bytes] = []
        for group in groups(ids, 4 * GROUP):
            length = np.array([len(x) // 4 for x in group])
            ends = np.cumsum(length)
            d = np.repeat(np.arange(len(group), dtype=np.int32), length)
            pos = (np.arange(ends[-1]) - np.repeat(ends - length, length)).astype(np.int32)
            tok = np.frombuffer(b"".join(group), "<u4").astype(np.int32)
            self.db.register("ids", pa.table({"d": d, "pos": pos, "tok": tok}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            found = dict(zip(got.column("d").to_pylist(), got.column("piece").to_pylist()))
            out += [found.get(k, "").encode("utf-16-le")[::2] for k in range(len(group))]
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids (little-endian unsigned 32-bit) and decoded (the bytes that the ids stand for)."""
    source = only(docs, [key, text])
    schema = keyed(source, key, "n_tokens bigint, ids binary, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            at = 0
            for group in groups([t or "" for t in batch.column(1).to_pylist()], GROUP):
                ids = c.encode(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(c.decode(ids), pa.binary())], names=schema.names)
                at += len(group)

    return source.mapInArrow(run, schema)
