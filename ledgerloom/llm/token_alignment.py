"""Cross-tokenizer alignment by interval coalescing (operator 12).

Every text is encoded by tokenizer A (byte-level BPE, of a space and the text) and tokenizer B (pieces with byte fallback,
which adds that space itself). Tokens are byte intervals. The intervals of both sides, of many texts laid end to end, are
sorted by start with one lexsort; a group breaks where a start reaches the running maximum of the ends before it. Inside a
group overlapping pairs are expanded; the pairs that end together are the links.

How many links of the corpus hold an id pair is counted in two steps. Texts go through in blocks of at most `BLOCK` tokens; a
block writes its distinct pairs once, and each of its texts as places in that list. Spark sums the pairs over blocks, takes the
highest count of each B id, and joins the sums back to the blocks' lists, so a pair met in every text is one row a block.
Each block then adds up its texts. Nothing is broadcast, and a task holds one block.

A text is cut into segments at single spaces between other characters. Neither tokenizer joins bytes across that place, so both
have a token end there, ids are those of the whole text, and no group crosses it. A segment met again is looked up: a worker
remembers what the intervals of at most `REMEMBERED` segments gave, then starts anew. Memory does not follow the longest text.

Defined cases: a null or empty text, and one whose joined A or B bytes differ from space and text (for example with U+2581),
has no tokens, zeros and an empty hash; special tokens inside texts are plain text; repeated rows count as often as they
occur; null and repeated ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.scratch import Scratch, groups, keyed, only

#: Tokens of side A that a block holds, about; a longer text is a block of its own.
BLOCK = 2_000_000
#: Characters that the tokenizers are given at once, about, and segments that a worker remembers.
PART, REMEMBERED = 400_000, 500_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r" (?:(?=\s|\Z)|(?<=\s )|(?<=\A ))")


class Tokenizers:
    """Ids of both sides, and the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are dealt out by Spark
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        byte = _byte_of()
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [self._piece(self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.lengths = tuple(np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))

    @staticmethod
    def _piece(piece: str) -> bytes:
        m = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B for each text; both empty unless their bytes are those of a space and the text."""
        spaced = [" " + t for t in texts]
        left = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        out = []
        for whole, a, b in zip(spaced, left, self.b.encode(texts, num_threads=1)):
            raw = whole.encode()
            fits = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((a, b) if fits and len(raw) > 1 else ([], []))
        return out


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


@dataclass
class Alignment:
    """Groups of tokens and overlapping pairs. `order` lists all tokens (A's, then B's numbers) in the order of their groups."""

    group: np.ndarray
    order: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> Alignment:
    """Groups of two sets of byte intervals. `group` numbers the groups from 0, for A's tokens and then for B's."""
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    side = np.repeat(np.array([0, 1]), [len(a_starts), len(b_starts)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    order = np.lexsort((starts, side, group))

    first = np.searchsorted(b_ends, a_starts, side="right")
    count = np.searchsorted(b_starts, a_ends, side="left") - first
    a = np.repeat(np.arange(len(a_starts)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    together = a_ends[a] == b_ends[b]
    return Alignment(group, order, (a, b), (a[together], b[together]))


def segments(text: str) -> list[str]:
    """The text cut at single spaces between other characters; these spaces are the ones that come before a segment."""
    return _CUT.split(text) if _OTHER_SPACE.search(text) else text.split(" ")


class Segments:
    """What the alignment of each segment met so far gave."""

    def __init__(self, tk: Tokenizers):
        self.tk = tk
        size = max(len(tk.a_bytes), len(tk.b_bytes))
        self.size, self.text_of = size, [f"{k}{mark}".encode() for mark in ",|;" for k in range(size)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.strings: list[bytes] = []
        self.counts = np.zeros((4, 0), np.int64)  # tokens of A and B, groups, overlapping pairs
        self.codes, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Aligns segments. Those without white space at their ends are given to the tokenizers in one text, others alone."""
        plain = [x for x in new if not (x[0].isspace() or x[-1].isspace())]
        units = list(groups(plain, PART)) + [[x] for x in new if x[0].isspace() or x[-1].isspace()]
        for unit in units:
            coded = self.tk.encode([" ".join(unit)])[0]
            if not coded[0] and len(unit) > 1:  # some segment's bytes do not come back
                for x in unit:
                    self._add([x], self.tk.encode([x])[0])
            else:
                self._add(unit, coded)

    def _add(self, unit: list[str], coded: tuple[list[int], list[int]]) -> None:
        for k, x in enumerate(unit, len(self.strings)):
            self.known[x] = k
        ids = [np.array(x, dtype=np.int64) for x in coded]
        ends = [np.cumsum(n[i]) for n, i in zip(self.tk.lengths, ids)]
        starts = [e - n[i] for n, i, e in zip(self.tk.lengths, ids, ends)]
        got = coalesce(ends[0], ends[1], starts[0], starts[1])
        upto = np.cumsum([len(x.encode()) + 1 for x in unit])
        if len(ids[0]) and not all(np.isin(upto, e).all() for e in ends):
            raise ValueError("a token crosses the end of a segment")

        side = (got.order >= len(ids[0])).astype(np.int64)
        group = got.group[got.order]
        last = np.ones(len(group), bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        mark = np.where(last, 1 + side, 0)
        written = list(map(self.text_of.__getitem__, (mark * self.size + np.concatenate(ids)[got.order]).tolist()))

        def per(at: np.ndarray) -> np.ndarray:
            return np.bincount(np.searchsorted(upto, at), minlength=len(unit))

        first = np.unique(got.group[: len(ids[0])], return_index=True)[1]
        counts = np.array([per(ends[0]), per(ends[1]), per(ends[0][first]), per(ends[0][got.pairs[0]])])
        token = 0
        for n in (counts[0] + counts[1]).tolist():
            self.strings.append(b"".join(written[token : token + n])[:-1])
            token += n
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.codes = np.concatenate([self.codes, (ids[0][got.links[0]] << 32) | ids[1][got.links[1]]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(per(ends[0][got.links[0]]))])

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray]]:
        """For each text n_a, n_b, n_groups, n_overlaps, groups_sha256 and its links, as A id * 2^32 + B id."""
        cut = [segments(t) if t else [] for t in texts]
        every = dict.fromkeys(chain.from_iterable(cut))
        new = [x for x in every if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.clear()
            new = list(every)
        if new:
            self.learn(new)
        for parts in cut:
            at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            counts = self.counts[:, at]
            if not len(at) or not counts[0].all():
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            sha = hashlib.sha256(b";".join(map(self.strings.__getitem__, at.tolist()))).hexdigest()
            begin, n = self.ends[at], self.ends[at + 1] - self.ends[at]
            place = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield *counts.sum(axis=1).tolist(), sha, self.codes[place]


_remembered: dict[tuple[str, str], Segments] = {}


def remembered(byte_level: str, pieces: str) -> Segments:
    """One for each worker process; what it remembers serves all tasks that the process runs."""
    if (byte_level, pieces) not in _remembered:
        _remembered[byte_level, pieces] = Segments(Tokenizers(byte_level, pieces))
    return _remembered[byte_level, pieces]


_BLOCK = "block bigint, places binary, pairs array<bigint>, counts array<bigint>"
_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, groups_sha256 string"


def _blocks(batches: Iterator[pa.RecordBatch], known: Segments, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of texts; the first row of each block also has the block's distinct pairs and how many links hold each."""
    number, rows, held, key_type = TaskContext.get().partitionId() << 32, [], 0, None
    long, longs = pa.int64(), pa.list_(pa.int64())

    def block() -> pa.RecordBatch:
        pairs, counts = np.unique(np.concatenate([r[-1] for r in rows]), return_counts=True)
        places = [np.diff(np.sort(np.searchsorted(pairs, r[-1])), prepend=0).astype("<u4").tobytes() for r in rows]
        others = [None] * (len(rows) - 1)
        columns = [[number] * len(rows), places, [pairs, *others], [counts, *others], *zip(*(r[:-1] for r in rows))]
        types = [long, pa.binary(), longs, longs, key_type, long, long, long, long, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        key_type = batch.schema.field(0).type
        keys, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        for group in groups([t or "" for t in texts], 4 * PART):
            for key, row in zip(keys[at : at + len(group)], known.aligned(group)):
                rows.append((key, *row))
                held += row[0] + 1
                if held >= BLOCK:
                    yield block()
                    number, rows, held = number + 1, [], 0
            at += len(group)
    if rows:
        yield block()


def align(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of every text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    source = only(docs, [key, text])
    schema = StructType([*StructType.fromDDL(_BLOCK).fields, *keyed(source, key, _COUNTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(batches, remembered(byte_level, pieces), schema.names)

    texts = scratch.keep(source.mapInArrow(run, schema), "texts")
    lists = texts.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    lists = lists.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    sums = scratch.keep(lists.groupBy("pair").agg(F.sum("n").alias("n")), "sums")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")
    best = sums.groupBy(b_id).agg(F.max("n").alias("best"))
    rated = sums.withColumn("b_id", b_id).join(best, "b_id").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    known = lists.select("block", "place", "pair").join(rated, "pair").select(F.col("block").alias("of_block"), "place", "n", "is_best")
    out = keyed(source, key, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_overlaps bigint")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        n, is_best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], is_best[place] = right.column("n").to_numpy(), right.column("is_best").to_numpy(zero_copy_only=False)
        held = [np.cumsum(np.frombuffer(x, "<u4").astype(np.int64)) for x in left.column("places").to_pylist()]
        got = {
            "n_links": [len(x) for x in held], "n_best": [int(is_best[x].sum()) for x in held],
            "count_sum": [int(n[x].sum()) for x in held]}
        return pa.table([left.column(f.name) if f.name not in got else pa.array(got[f.name], pa.int64()) for f in out], names=out.names)

    return texts.drop("pairs", "counts").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(add_up, out)
