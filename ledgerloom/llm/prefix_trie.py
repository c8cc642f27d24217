"""Conversation prefix trie (operator 11).

Conversations are rows of marks, one for each turn: the SHA-256 of its role and text. They are range-partitioned by their
marks and their id and cut into shards of at most `SHARD` turns, so that one conversation shared by a third of all ids is
cut between shards like any other run. In a shard, marks become dense numbers in their order, distinct sequences are
inserted into a ternary search tree, the median first, and the tree is gone through from its newest node to its oldest
(children are younger than their parent), which adds up members, children, leaves and savings without recursion.

Only prefixes of the first and the last sequence of a shard can go on in another shard. These boundary nodes have an id
that all shards agree on, the hash of their marks, and are merged by it. Sums over shards count what a shared node adds
more than once; each shared node corrects itself and its ancestors by that. Ids that end at a shared node are hashed as a
stream of the shards' pieces, in order, so they are never held together.

Defined cases: a null role or text is an empty one; a null turn comes first; turns with equal numbers are ordered by their
marks; repeated rows are turns of their own; rows with a null conv_id belong to no conversation and are left out; an
empty table gives no rows; other columns are ignored. The marks of one conversation (32 bytes a turn) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, fold, only

#: Turns (and conversations without any) that one search tree holds.
SHARD = 200_000
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations are rebuilt in runs of this many, from the turns of the first of the run.
RUN, HEAD = 20, 4

_NODES = pa.schema([
    ("shard", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("mark", pa.binary()), ("side", pa.int64()),
    ("words", pa.int64()), ("ends", pa.string()), ("open_parent", pa.bool_()), ("paths", pa.list_(pa.list_(pa.binary()))),
])
_NODES_DDL = (
    "shard bigint, node bigint, parent bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, mark binary, side bigint, words bigint, "
    "ends string, open_parent boolean, paths array<array<binary>>")


def sequences(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, marks and words (white-space separated, of each turn)."""
    source = only(turns, ["conv_id", "turn", "role", "text"]).where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    step = F.struct("turn", mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    steps = source.select(F.col("conv_id").cast("long").alias("conv_id"), step.alias("step"))
    return steps.groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps")).select(
        "conv_id", F.col("steps.mark").alias("marks"), F.col("steps.words").alias("words"))


def rebuilt(convs: DataFrame, run: int = RUN, head: int = HEAD) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of the first of its run; h is crc32(c) modulo `head`."""
    first = convs.where(F.col("conv_id") % run == 0).select(
        F.col("conv_id").alias("run"), *[F.slice(c, 1, head).alias(f"head_{c}") for c in ("marks", "words")])
    h = fold("conv_id", head).cast("int")
    joined = convs.withColumn("run", F.col("conv_id") - F.col("conv_id") % run).join(first, "run", "left")

    def whole(c: str):
        own = F.slice(F.col(c), h + 1, F.size(c))
        return F.when(F.col(f"head_{c}").isNull(), own).otherwise(F.concat(F.slice(F.col(f"head_{c}"), F.lit(1), h), own)).alias(c)

    return joined.select("conv_id", whole("marks"), whole("words"))


class Trie:
    """A ternary search tree over sequences of numbers. Node 0 is the empty prefix; `eq` is the root of a node's children."""

    def __init__(self) -> None:
        self.key, self.lo, self.hi, self.eq, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _new(self, key: int, parent: int) -> int:
        for column, value in zip((self.key, self.lo, self.hi, self.eq, self.parent), (key, -1, -1, -1, parent)):
            column.append(value)
        self.depth.append(self.depth[parent] + 1)
        return len(self.key) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node of the whole sequence."""
        key, lo, hi, eq, node = self.key, self.lo, self.hi, self.eq, 0
        for x in sequence:
            at, links, last = eq[node], eq, node
            while at >= 0 and key[at] != x:
                links, last = (lo, at) if x < key[at] else (hi, at)
                at = links[at]
            if at < 0:
                at = links[last] = self._new(x, node)
            node = at
        return node

    def insert_all(self, ordered: list[list[int]]) -> list[int]:
        """Inserts sequences that are in order, the median of each stretch before its halves."""
        nodes, stretches = [0] * len(ordered), [(0, len(ordered))]
        while stretches:
            a, b = stretches.pop()
            if a < b:
                m = (a + b) // 2
                nodes[m] = self.insert(ordered[m])
                stretches += [(a, m), (m + 1, b)]
        return nodes

    def path(self, node: int) -> list[int]:
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out[::-1]


def _ends(ids: Iterable[int]) -> str:
    return ",".join(map(str, ids))


def _shard(number: int, rows: list[tuple[int, list[bytes], list[int]]]) -> pa.RecordBatch:
    """The nodes of one shard. `rows` are (conv_id, marks, words) in the order of (marks, conv_id)."""
    marks, words, ids = [], {}, []
    for conv, seq, counts in rows:
        if not marks or marks[-1] != seq:
            marks.append(seq)
            ids.append([])
            words.update(zip(seq, counts))
        ids[-1].append(conv)
    known = sorted(words)
    code = {m: k for k, m in enumerate(known)}
    trie = Trie()
    ends = dict(zip(trie.insert_all([[code[m] for m in seq] for seq in marks]), ids))

    n, parent = len(trie.key), trie.parent
    members, least, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    own_words = [0] + [words[known[k]] for k in trie.key[1:]]
    for v in range(n - 1, -1, -1):
        here = ends.get(v)
        if here:
            members[v] += len(here)
            least[v] = here[0] if least[v] is None else min(least[v], here[0])
        if not children[v]:
            leaves[v] = 1
        saved[v] += (members[v] - 1) * own_words[v]
        if v:
            up = parent[v]
            members[up] += members[v]
            least[up] = least[v] if least[up] is None else min(least[up], least[v])
            children[up] += 1
            leaves[up] += leaves[v]
            saved[up] += saved[v]

    first, last = (trie.path(trie.insert([code[m] for m in marks[k]])) for k in (0, -1))
    side = dict.fromkeys(last, 1) | dict.fromkeys(first, 0)
    chain = {0: hashlib.sha256(b"").digest()}
    for v in first + last:
        if v not in chain:
            chain[v] = hashlib.sha256(chain[parent[v]] + known[trie.key[v]]).digest()
    at = range(n)
    columns = [
        [number] * n, list(at), parent, trie.depth, least, [least[p] if p >= 0 else None for p in parent], members, children,
        leaves, saved, [None if v in side else hashlib.sha256(_ends(ends.get(v, ())).encode()).hexdigest() for v in at],
        [chain.get(v) for v in at], [side.get(v) for v in at], own_words, [_ends(ends.get(v, ())) if v in side else None for v in at],
        [v not in side and parent[v] in side for v in at], [[[chain[v] for v in p] for p in (first, last)], *[None] * (n - 1)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES)], schema=_NODES)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    number, rows, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
            rows.append(row)
            held += max(len(row[1]), 1)
            if held >= size:
                yield _shard(number, rows)
                number, rows, held = number + 1, [], 0
    if rows:
        yield _shard(number, rows)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each mark over its pieces; rows come in the order of (mark, shard)."""
    mark, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([mark], pa.binary()), pa.array([state.hexdigest()])], ["mark", "sha"])

    for batch in batches:
        for m, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if m != mark:
                if state:
                    yield done()
                mark, state = m, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state:
        yield done()


def _merged(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Boundary nodes, one row for each mark: what all shards say of it together, corrected for what several of them count."""
    border = nodes.where("mark is not null")
    childless = (F.col("n_children") == 0).cast("long")
    sums = border.groupBy("mark").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.sum(childless).alias("childless"), F.count(F.lit(1)).alias("shards"), F.min(F.struct("shard", "side")).alias("seen"))
    sums = scratch.keep(sums, "sums")

    leaf = (F.col("childless") == F.col("shards")).cast("long")
    shared = sums.where("shards > 1").select(
        "seen.*", "depth", (F.col("shards") - 1).alias("twice"), ((F.col("shards") - 1) * F.col("words")).alias("more_saved"),
        (leaf - F.col("childless")).alias("more_leaves"))
    paths = nodes.where("paths is not null").select("shard", F.posexplode("paths").alias("side", "path"))
    up = shared.join(paths.withColumn("side", F.col("side").cast("long")), ["shard", "side"]).select(
        "*", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int") + 1)).alias("at", "mark"))
    fix = up.groupBy("mark").agg(
        F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"),
        F.sum(F.when(F.col("at") == F.col("depth") - 1, F.col("twice")).otherwise(0)).alias("twice"))

    pieces = border.where("ends <> ''").repartition("mark").sortWithinPartitions("mark", "shard").select("mark", "ends")
    hashed = pieces.mapInArrow(_hashed_ends, "mark binary, sha string")
    parents = paths.select(F.explode(F.arrays_zip(F.expr("slice(path, 2, size(path))").alias("mark"), F.col("path").alias("up"))).alias("x"))
    parents = parents.select("x.*").where("mark is not null").distinct()
    zero = F.lit(0).cast("long")
    return sums.join(fix, "mark", "left").join(hashed, "mark", "left").join(parents, "mark", "left").select(
        "mark", "up", "depth", "conv_id", "n_convs", (F.col("n_children") - F.coalesce("twice", zero)).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    scratch = Scratch(turns.sparkSession, "trie")
    whole = scratch.keep(rebuilt(sequences(turns)), "rebuilt")
    ordered = whole.repartitionByRange("marks", "conv_id").sortWithinPartitions("marks", "conv_id").select("conv_id", "marks", "words")
    nodes = scratch.keep(ordered.mapInArrow(lambda batches: _shards(batches, shard), _NODES_DDL), "nodes")
    merged = scratch.keep(_merged(nodes, scratch), "merged")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    least = merged.select("mark", F.col("conv_id").alias("least"))
    border = merged.join(least.withColumnRenamed("mark", "up"), "up", "left").withColumn("parent_conv_id", F.col("least"))
    held = nodes.where("mark is not null").select("shard", F.col("node").alias("parent"), "mark").join(least, "mark").drop("mark")
    inner = nodes.where("mark is null")
    under = inner.where("open_parent").join(held, ["shard", "parent"]).withColumn("parent_conv_id", F.col("least"))
    return inner.where("not open_parent").select(*columns).unionByName(under.select(*columns)).unionByName(border.select(*columns))


#: The same rows in DuckDB: node of every (conversation, depth), and sums over the nodes below by the chain of their least member.
SQL = """
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(text, '') AS text,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(mark ORDER BY turn NULLS FIRST, mark) AS marks,
         list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY turn NULLS FIRST, mark) AS words,
         list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM turns GROUP BY conv_id),
headed AS (
  SELECT o.*, xor(o.crc, 4294967295) % 4 AS h, f.marks AS head_marks, f.words AS head_words
  FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
convs AS (
  SELECT conv_id, list_concat(coalesce(head_marks[:h], []), marks[h + 1:]) AS marks,
         list_concat(coalesce(head_words[:h], []), words[h + 1:]) AS words FROM headed),
places AS (
  SELECT conv_id, d, marks[:d] AS path, len(marks) = d AS ends, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
  FROM (SELECT *, unnest(range(len(marks) + 1)) AS d FROM convs)),
nodes AS (
  SELECT d, path, min(conv_id) AS node, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM places GROUP BY d, path),
members AS (SELECT p.conv_id, p.d, n.node FROM places p JOIN nodes n ON p.d = n.d AND p.path = n.path),
linked AS (
  SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM linked WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (
  SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.node = l.node AND k.d = l.d),
below AS (
  SELECT m.node, m.d, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
  FROM full_nodes f JOIN members m ON m.conv_id = f.node AND m.d <= f.d GROUP BY 1, 2)
SELECT f.node AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.node = f.node AND b.d = f.d
"""
