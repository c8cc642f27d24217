"""Search that reads what can matter: block bounds for ranking, and trigram postings for words and patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import B, K1, tokens, top_k
from ledgerloom.sources.landing import materialize

Keep = Callable[[DataFrame], DataFrame]
#: Documents of a block of postings, about, and blocks of a question that are scored before the bound is known.
BLOCK_DOCS, FIRST_BLOCKS = 32, 4
#: Characters and texts whose trigrams are packed into one row each; a longer text is packed alone.
PACK_CHARS, PACK_DOCS = 1 << 20, 128


def ranked_in_blocks(
    held: DataFrame, questions: DataFrame, k: int, doc_id: str = "doc_id", question_id: str = "question_id",
    question: str = "question", digits: int = 6, block_docs: int = BLOCK_DOCS, keep: Keep = materialize,
) -> tuple[DataFrame, DataFrame]:
    """The rows of `retrieval.ranked_by_bm25`, and one row for each question with n_postings and n_scored.

    Documents are dealt into blocks; of each (term, block) the largest gain is kept beside the postings. The sum of these
    over a question's terms bounds every score in the block. The blocks with the highest bounds are scored first; the k-th
    score found there is one that the result reaches, so blocks whose bound is below it are never joined to the question.
    Postings meet a question by (term, block), so a term that every text has is dealt over all blocks.
    """
    corpus = held.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean")).first()  # two numbers
    n, mean = corpus["n"], corpus["mean"]
    blocks = max(1, -(-n // block_docs))
    tf = F.col("_tf")
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(mean)))
    used = held.filter("term <> ''").select(
        "term", "_doc", gain.alias("_gain"), F.pmod(F.xxhash64("_doc"), F.lit(blocks)).alias("_block"))
    used = keep(used.repartition("term", "_block").sortWithinPartitions("term", "_block"))
    most = keep(used.groupBy("term", "_block").agg(F.max("_gain").alias("_most"), F.count(F.lit(1)).alias("_n")))

    asked = questions.select(question_id, F.explode(F.array_distinct(tokens(question))).alias("term"))
    df = F.col("_df")
    weights = keep(asked.join(most.groupBy("term").agg(F.sum("_n").alias("_df")), "term").select(
        question_id, "term", F.log1p((n - df + 0.5) / (df + 0.5)).alias("_idf")))
    bounds = keep(most.join(weights, "term").groupBy(question_id, "_block").agg(
        F.sum(F.col("_idf") * F.col("_most")).alias("_bound"), F.sum("_n").alias("_n")))

    def scored(some: DataFrame) -> DataFrame:
        wanted = some.select(question_id, "_block").join(weights, question_id)
        out = used.join(wanted, ["term", "_block"]).groupBy(question_id, "_doc")
        return out.agg(F.round(F.sum(F.col("_idf") * F.col("_gain")), digits).alias("score")).withColumnRenamed("_doc", doc_id)

    first = top_k(bounds, [question_id], "_bound", "_block", FIRST_BLOCKS)
    found = top_k(scored(first), [question_id], "score", doc_id, k)
    reached = found.groupBy(question_id).agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_found"))
    reached = keep(reached.filter(F.col("_found") == k).drop("_found"))
    slack = 10.0**-digits  # scores are rounded, bounds are not
    left = bounds.join(reached, question_id, "left").filter(F.coalesce(F.col("_bound") >= F.col("_least") - slack, F.lit(True)))
    left = keep(left.select(question_id, "_block", "_n"))
    counted = bounds.groupBy(question_id).agg(F.sum("_n").alias("n_postings")).join(
        left.groupBy(question_id).agg(F.sum("_n").alias("n_scored")), question_id)
    return top_k(scored(left), [question_id], "score", doc_id, k), counted


# --- trigrams ---


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Every run of three characters as one number, and where it begins."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:], np.arange(max(len(c) - 2, 0), dtype=np.int32)


def _postings(batch: pa.RecordBatch, first: int, last: int) -> pa.RecordBatch | None:
    """A row for each gram of the texts from `first` to before `last`: those that have it, how often, and all places, text by text."""
    grams = [_grams(batch.column(1)[row].as_py()) for row in range(first, last)]
    row = np.repeat(np.arange(first, last), [len(g) for g, _ in grams])
    gram, at = (np.concatenate(part) for part in zip(*grams, strict=True))
    if not len(gram):
        return None
    order = np.argsort(gram, kind="stable")
    gram, row, at = gram[order], row[order], at[order]
    new = np.diff(gram, prepend=gram[0] - 1) != 0
    text = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0))  # where a text begins
    whole = np.flatnonzero(new)  # where a gram begins
    texts = np.append(np.searchsorted(text, whole), len(text)).astype(np.int32)
    docs = batch.column(0).take(pa.array(row[text]))
    places = np.append(whole, len(row)).astype(np.int32)
    # Places as two halves: the high one is zero for most texts and costs nothing on the way.
    return pa.RecordBatch.from_arrays(
        [pa.array(gram[whole]), batch.column(0).take(pa.array(row[whole])), pa.ListArray.from_arrays(pa.array(texts), docs),
         pa.ListArray.from_arrays(pa.array(texts), pa.array(np.diff(text, append=len(row)).astype(np.int32))),
         pa.ListArray.from_arrays(pa.array(places), pa.array((at >> 15).astype(np.int32))),
         pa.ListArray.from_arrays(pa.array(places), pa.array((at & 0x7FFF).astype(np.int16)))],
        ["gram", "doc", "docs", "counts", "high", "low"])


def trigram_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, doc, places), one row for each three characters that a text has, in lower case, with all their places.

    A text's rows are made where it is read, and travel packed: a row for each gram of some texts read together. The index is
    range-partitioned by gram and first text of a pack and sorted, so a lookup reads the row groups of its grams, and a gram
    that all texts have lies in many files. Written once, read back.
    """
    source = docs.select(F.col(doc_id).alias("doc"), F.lower(text).alias("t")).filter("t is not null")
    kind = source.schema["doc"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                begun = ends[first - 1] if first else 0
                last = min(max(first + 1, int(np.searchsorted(ends, begun + PACK_CHARS))), first + PACK_DOCS, batch.num_rows)
                packed = _postings(batch, first, last)
                if packed is not None:
                    yield packed
                first = last

    def unpack(batches):
        for batch in batches:
            _, docs, counts, high, low = batch.columns
            places = (high.flatten().to_numpy() << 15) | low.flatten().to_numpy()
            at = np.append(0, np.cumsum(counts.flatten().to_numpy())).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pc.list_parent_indices(docs)), docs.flatten(),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(places))], ["gram", "doc", "places"])

    packs = source.mapInArrow(pack, f"gram bigint, doc {kind}, docs array<{kind}>, counts array<int>, high array<int>, low array<smallint>")
    packs = packs.repartitionByRange("gram", "doc").sortWithinPartitions("gram", "doc").drop("doc")
    rows = packs.mapInArrow(unpack, f"gram bigint, doc {kind}, places array<int>")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def having(index: DataFrame, literal: str) -> DataFrame:
    """doc: the texts that hold the literal, in lower case, of at least three characters. Exact: its trigrams must stand at
    the right distances, and together they cover it."""
    gram, at = _grams(literal.lower())
    if not len(gram):
        raise ValueError("a literal of three characters at least")
    cover = sorted({*range(0, len(gram), 3), len(gram) - 1})
    if len(cover) == 1:
        return index.filter(F.col("gram") == int(gram[0])).select("doc")
    parts = F.array(*[F.struct(F.lit(int(gram[k])).alias("gram"), F.lit(int(k)).alias("shift")) for k in cover])
    wanted = F.filter(parts, lambda p: p["gram"] == F.col("gram"))  # a gram may be wanted at several places
    starts = index.filter(F.col("gram").isin([int(gram[k]) for k in cover])).select(
        "doc", "places", F.explode(wanted).alias("p")).select("doc", F.explode("places").alias("at"), "p.shift")
    starts = starts.select("doc", (F.col("at") - F.col("shift")).alias("start"))
    whole = starts.groupBy("doc", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(cover))
    return whole.select("doc").distinct()


_SPECIAL = re.compile(r"\\.|\[(?:\\.|[^\]])*\]|\{[^}]*\}|[.^$*+?()|\[\]{}\\]", re.DOTALL)


def literals_of(pattern: str) -> list[str]:
    """Literal parts of three characters or more that every match of the pattern holds. Patterns with groups, alternatives
    or flags have none that is told here."""
    if re.search(r"[()|]", pattern):
        return []
    out, at = [], 0
    for m in [*_SPECIAL.finditer(pattern), None]:
        part, mark = pattern[at : m.start() if m else len(pattern)], m[0] if m else ""
        if mark[:1] in ("*", "?", "{"):
            part = part[:-1]  # the last character may be missing
        out.append(part)
        at = m.end() if m else at
    return [x for x in out if len(x) >= 3]


def indexed_search(
    docs: DataFrame, index: DataFrame, words: Sequence[str], text: str = "text", pattern: str | None = None, doc_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """The rows of `retrieval.keyword_search`, and the ids of the texts that had to be read for it.

    Words and the literal parts of the pattern are looked up, and their texts intersected. Words of three characters or
    more are settled by that; texts are read for shorter ones and for the pattern, which is tested on the survivors alone.
    """
    found = None
    short = [w for w in words if len(w.lower()) < 3]
    literals = [w for w in words if len(w.lower()) >= 3] + [x for x in (literals_of(pattern) if pattern else [])]
    for word in literals:
        hits = having(index, word)
        found = hits if found is None else found.join(hits, "doc", "left_semi")
    ids = docs.select(F.col(doc_id).alias("doc")) if found is None else found
    out = docs if found is None else docs.join(found.withColumnRenamed("doc", doc_id), doc_id, "left_semi")
    for word in short:
        out = out.filter(F.contains(F.lower(F.col(text)), F.lit(word.lower())))
    if pattern:
        out = out.filter(F.col(text).rlike(pattern))
    return out, ids if short or pattern else ids.limit(0)
