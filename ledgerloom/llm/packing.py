"""Best-fit packing of token sequences (operator 1).

Documents are tokenized once, in parallel. Packing itself only needs how many pieces there are of each length, which is
at most `capacity` numbers however large the corpus is. Best-fit decreasing runs on these counts: pieces of one length
are placed in runs, each run taking the tightest open bins that a segment tree over the remaining capacities finds in
logarithmic time. The plan is a list of runs (length, first rank, first bin, offset) whose size follows from the
capacity. Each piece has a rank among the pieces of its length: its place in its partition plus the pieces of that
length in earlier partitions. Rank and plan give its bin. The result is the one that best-fit decreasing gives over
all pieces together; no piece ever passes through the driver.

Defined cases: a null text is an empty one and gives the end token alone; an empty table gives no rows; repeated rows
and equal ids are packed like others; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, groups, keyed, only

#: Encodings a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 700_000
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-^`{-~]*)")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


class WordTokenizer:
    """Ids of whole texts. The vocabulary drops white space and lower-cases, so a text's ids are those of its parts
    between white space, one after the other; a part met again is looked up. Letters followed by punctuation are two
    words to the tokenizer and are looked up apart. Every other part goes to the tokenizer as it stands."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        known = self.known
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            e = self.tk.encode(" ".join(part), add_special_tokens=False)
            ids, word = np.array(e.ids, dtype="<u4"), np.array(e.word_ids)
            ends = np.searchsorted(word, np.arange(len(part)), side="right").tolist() if len(word) else []
            if len(ends) != len(part) or word[-1] != len(part) - 1:  # a part that the tokenizer splits or drops
                known.update((w, self._ids(w)) for w in part)
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ends):
                known[w] = raw[4 * start : 4 * end]
                start = end

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """Adds what the parts consist of to `known`: lower-case words, tails of punctuation, and parts of another kind.
        Words with capitals or a tail are not kept there, but returned."""
        known, several, words, other = self.known, [], set(), set()
        for x in parts:
            m = _PLAIN.fullmatch(x) if len(x) <= 100 else None
            if m is None:
                other.add(x)
                continue
            word = m[1].lower()
            words.add(word)
            if word != x:
                several.append((x, word, m[2]))
                if m[2]:
                    other.add(m[2])
        for x in other.difference(known):
            known[x] = self._ids(x)
        known[""] = b""
        self._learn_words(list(words.difference(known)))
        return {x: known[a] + known[b] for x, a, b in several if x not in known}

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for group in groups(texts):
            split = [None if _ODD_SPACE.search(t) else t.split() for t in group]
            parts = set().union(*(s for s in split if s))
            new = parts.difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, parts
            several = self.learn(new)
            self.known.update(several)
            get = self.known.__getitem__
            out += [self._ids(t) if s is None else b"".join(map(get, s)) for t, s in zip(group, split)]
            for x in several:
                del self.known[x]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process; what it remembers serves all tasks that the process runs."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most `capacity` ids: key, piece, start, length, ids (little-endian unsigned 32-bit), and part and
    place, the partition and the rank among the partition's pieces of that length."""
    source = only(docs, [key, text])
    schema = keyed(source, key, "piece int, start bigint, length bigint, ids binary, part int, place bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, part, seen = tokenizer(vocabulary), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            for group in groups([t or "" for t in texts]):
                rows, piece, start, length, ids, place = [], [], [], [], [], []
                for k, raw in enumerate(tk.encode(group), at):
                    raw += end
                    for j in range(0, len(raw), width):
                        x = raw[j : j + width]
                        n = len(x) // 4
                        rows.append(k)
                        piece.append(j // width)
                        start.append(j // 4)
                        length.append(n)
                        ids.append(x)
                        place.append(seen[n])
                        seen[n] += 1
                at += len(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                        pa.array([part] * len(rows), pa.int32()), pa.array(place, pa.int64()),
                    ],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over the remaining capacities 0..n: which of them some open bin has."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, value: bool) -> None:
        i = at + self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def tightest(self, least: int) -> int:
        """The smallest capacity >= `least` that an open bin has, or -1."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over so many pieces of each length: rows (length, first rank, first bin, pieces a bin, offset).

    The pieces of a run fill consecutive bins, `pieces a bin` in each. A run is as long as the tightest open bins
    allow, so the plan has few rows for each length, whatever the counts are.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}
    tree = CapacityTree(capacity)
    rows, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            open_bins.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = tree.tightest(length)
            if left < 0:
                left, first, n = capacity, bins, -(-rest // (capacity // length))
                bins += n
            else:
                first, n = open_bins[left].pop()
                if not open_bins[left]:
                    tree.set(left, False)
            each = left // length
            full = min(n, rest // each)
            if full:
                rows.append((length, rank, first, each, capacity - left))
                rank, rest = rank + full * each, rest - full * each
                put(left - each * length, first, full)
            if full < n:
                if rest:
                    rows.append((length, rank, first + full, rest, capacity - left))
                    put(left - rest * length, first + full, 1)
                    put(left, first + full + 1, n - full - 1)
                    rest = 0
                else:
                    put(left, first + full, n - full)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces that have part, place and length (1..capacity). Reads `pieces` twice, so
    give it a written table. The counts that reach the driver are one for each length."""
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    plan = packing_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = (plan[:, 0] << 44) | plan[:, 1]

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = np.searchsorted(keys, (n << 44) | r, side="right") - 1
        k, each = r - plan[row, 1], plan[row, 3]
        return pd.DataFrame({"sequence_id": plan[row, 2] + k // each, "offset": plan[row, 4] + k % each * n})

    own = [c for c in pieces.columns if c not in ("part", "place")]
    placed = pieces.join(base, ["part", "length"]).withColumn("spot", spot("length", F.col("place") + F.col("earlier")))
    return placed.select(*own, "spot.sequence_id", "spot.offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Documents to placed pieces without their ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = token_pieces(docs, vocabulary, capacity, end_id)
    return pack(scratch.keep(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), capacity)
