"""URL rules by a sorted digest array (operator 2).

Rules are strings host + path, such as `example.org/en/`. Their 64-bit xxhash keys are sorted into an array that
executors fetch once and map into memory. A URL gives one candidate string for each suffix of its host and each length
that some rule's path has; all candidates of a batch are probed with one vectorised binary search. A hit counts only
if the stored rule equals the candidate, so colliding keys decide nothing. The longest fitting rule wins.

Defined cases: a null URL, or one without `://`, has empty host and path, fits no rule and gets the default verdict;
an empty host fits nothing; a path shorter than the rule's does not fit; equal rules must agree on the verdict; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.scratch import Scratch, keyed, only

#: Bytes of rules an executor maps; more are refused, not cut.
MAX_RULE_BYTES = 1 << 30

Rule = tuple[str, str, str]  # verdict, host, path


def digest_file(rules: Sequence[Rule]) -> bytes:
    """The sorted keys, the end of each rule's text, the verdict (1: block) and the texts, in one file."""
    text = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {verdict} {host}{path}")
        if text.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"two verdicts for {host}{path}")
    order = sorted(text, key=lambda t: (xxhash.xxh64_intdigest(t), t))
    raw = [t.encode() for t in order]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in order], dtype="<u8")
    ends = np.cumsum([len(t) for t in raw], dtype="<i8") if raw else np.zeros(0, "<i8")
    if sum(map(len, raw)) > MAX_RULE_BYTES:
        raise ValueError(f"rules of more than {MAX_RULE_BYTES} bytes")
    lengths = np.array(sorted({len(path) for _, _, path in rules}), dtype="<i8")
    out = io.BytesIO()
    out.write(np.array([len(keys), len(lengths)], dtype="<i8").tobytes())
    for part in (keys, ends, lengths, np.array([text[t] == "block" for t in order], dtype="u1")):
        out.write(part.tobytes())
    out.write(b"".join(raw))
    return out.getvalue()


class Digest:
    """The file of `digest_file`, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        n, m = (int(x) for x in raw[:16].view("<i8"))
        at = 16
        self.keys = raw[at : at + 8 * n].view("<u8")
        self.ends = raw[at + 8 * n : at + 16 * n].view("<i8")
        self.lengths = raw[at + 16 * n : at + 16 * n + 8 * m].view("<i8").tolist()
        at += 16 * n + 8 * m
        self.block = raw[at : at + n]
        self.text = raw[at + n :]

    def rule(self, i: int) -> bytes:
        return self.text[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, candidates: list[str]) -> list[int]:
        """Row of each candidate in the array, -1 where it is no rule."""
        if not candidates or not len(self.keys):
            return [-1] * len(candidates)
        want = np.fromiter(map(xxhash.xxh64_intdigest, candidates), dtype="<u8", count=len(candidates))
        at = np.searchsorted(self.keys, want)
        out = np.full(len(want), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == want[i]:  # colliding keys stand side by side
                if self.rule(j) == candidates[i].encode():
                    out[i] = j
                    break
                j += 1
        return out.tolist()


_URL = re.compile(r"([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    m = _URL.match(url, url.index("://") + 3)
    return m[1].translate(_LOWER), m[2]


def candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Rules that fit the URL if they exist, the longest first for each host."""
    if not host:
        return []
    parts = host.split(".")
    paths = [path[:n] for n in lengths if n <= len(path)]
    return [".".join(parts[i:]) + p for i in range(len(parts)) for p in paths if ".".join(parts[i:])]


_digests: dict[str, Digest] = {}


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """Key, host, path, rule and verdict of every URL."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "urls")
    name = f"{scratch.dir.rsplit('/', 1)[1]}.digest"
    spark.sparkContext.addFile(scratch.put(name, digest_file(rules)))
    source = only(pages, [key, url])
    schema = keyed(source, key, "host string, path string, rule string, verdict string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _digests:
            _digests[name] = Digest(SparkFiles.get(name))
        d = _digests[name]
        for batch in batches:
            split = [host_and_path(u) for u in batch.column(1).to_pylist()]
            cands = [candidates(h, p, d.lengths) for h, p in split]
            found = iter(d.find([c for cs in cands for c in cs]))
            best = []
            for cs in cands:
                hits = [(len(c), j) for c, j in zip(cs, found) if j >= 0]
                best.append(max(hits)[1] if hits else -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([d.rule(j).decode() if j >= 0 else None for j in best], pa.string()),
                    pa.array([default if j < 0 else "block" if d.block[j] else "allow" for j in best], pa.string()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


#: Fixed values of the contract.
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)

SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""


__all__ = ["RULES", "SQL", "judge_urls"]
