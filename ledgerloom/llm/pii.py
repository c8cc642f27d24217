"""Personal data by a semi-Markov conditional random field (operator 6).

Base spans follow four fixed patterns. Further spans come from a semi-Markov model over the atoms of a text (runs of
letters and digits, white space, single other characters). A candidate segment of at most `LONGEST` atoms has a digit or
an @ in it and is scored as a whole: pattern checks, lengths, mixture of character classes, checksum, the word and punctuation
before it. A dynamic program over the positions of a window chooses the boundaries and types that together score
highest; its entities have a bounded length, so time and memory are linear in the window. Windows are the stretches around
characters that an entity must have; elsewhere no segment could be an entity.

The weights are fitted by maximum likelihood (forward sums over all segmentations) on the driver, on at most `FIT_WINDOWS`
windows of the `FIT_DOCS` documents with the least hash of their text, labelled with the base patterns, with secrets next to
a naming word and with mailboxes of hosts without a dot. Tasks cut the windows: those of over `FIT_ATOMS` atoms are cut
between entities, a document gives at most `FIT_EACH` of each kind, and each kind (the first entity's, or none) has an equal
share of the windows, those with the least hash; what kinds leave over goes to the others. So neither one long text nor one
frequent kind takes the place of the rest, and what reaches the driver is bounded in bytes: an atom of over `FIT_CHARS`
characters is not learned from. The bounds are parameters. The types are the four base kinds and `secret`.

Defined cases: a null text is an empty one and has no spans; base spans always stay, also where two kinds overlap;
added spans overlap no base span and no other added one; texts of any length are read whole, in time linear in it; equal rows give equal results; an empty table gives no rows and fits nothing;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import exp, log

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.llm.scratch import keyed, only

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LONGEST = 16
FIT_DOCS = 6000
FIT_WINDOWS = 600
FIT_EACH = 4
FIT_ATOMS = 200
FIT_CHARS = 4000
#: Characters before and after a window that features look at, and some to spare.
AROUND = 40

Span = tuple[str, int, int]

# The base patterns. The look-behinds only spare starts inside a run whose first character failed too.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ instead of from each start, so that long runs cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while m and start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if m and start < at:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, by start and then kind."""
    if not _MARK.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_ATOM = re.compile(r"[^\W_]+|\s+|.", re.S)
#: What may stand in an entity besides letters and digits.
_JOINS = set("@.+-_%()=/: ")
_NAMING = re.compile(r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|key|auth)\W{0,3}$")
_KEY_ID = re.compile(r"[A-Z]{4}[A-Z0-9]{12,}")
_BOX = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
#: A mailbox of a host without a dot.
_LOCALHOST = re.compile(r"(?<![\w.%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]*[A-Za-z0-9](?![\w@-]|\.\w)")


_STRETCH = re.compile(r"[^\s\"'<>,;|]+")


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Atoms (start, end) of the stretches that may hold an entity: parts with a digit or @, joined where one space is
    between them. They end before characters that no entity may contain."""
    start = end = -1
    for m in _STRETCH.finditer(text):
        if not _MARK.search(text, *m.span()):
            continue
        if start >= 0 and m.start() == end + 1 and text[end] == " ":
            end = m.end()
            continue
        if start >= 0:
            yield [a.span() for a in _ATOM.finditer(text, start, end)]
        start, end = m.span()
    if start >= 0:
        yield [a.span() for a in _ATOM.finditer(text, start, end)]


def features(text: str, start: int, end: int) -> dict[str, float]:
    """Of a whole candidate segment; the type is joined to the names by the model."""
    x = text[start:end]
    d = _digits(x)
    letters = sum(c.isalpha() for c in x)
    before = text[max(0, start - 24) : start]
    out = {"bias": 1.0, f"digits{min(len(d) // 2, 10)}": 1.0, "letters": float(letters > 0), "atoms": len(x) / 16}
    out[f"first{'9' if x[0].isdigit() else 'a' if x[0].isalpha() else x[0]}"] = 1.0
    out[f"last{'9' if x[-1].isdigit() else 'a' if x[-1].isalpha() else 'o'}"] = 1.0
    out["cutleft"] = float(start > 0 and text[start - 1].isalnum())
    out["cutright"] = float(end < len(text) and text[end].isalnum())
    out["openleft"] = float(start > 0 and text[start - 1] in "+(@._%-=")
    out["openright"] = float(end < len(text) - 1 and text[end] in "@.-_(" and text[end + 1].isalnum())
    if "@" in x:
        out["at"] = 1.0
        out["box"] = float(bool(_BOX.fullmatch(x)))
        out["mail"] = float(bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)))
    if not letters and "@" not in x:
        if x.count(".") == 3:
            out["quad"] = float(bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", x)))
        if 14 <= len(d) <= 19 and re.fullmatch(r"[0-9][0-9 -]*[0-9]", x):
            out["sum" if luhn(d) else "nosum"] = 1.0
        if x[0] == "+" and 10 <= len(d) <= 15 and re.fullmatch(r"\+[0-9][ ().0-9-]+[0-9]", x):
            out["dial"] = 1.0
    if x.isalnum() and len(x) >= 12 and d and letters:
        out["mixed"] = 1.0
        out["mixedlong"] = float(len(x) >= 16)
        out["hex"] = float(bool(re.fullmatch("[0-9a-f]+", x)))
        out["keyid"] = float(bool(_KEY_ID.fullmatch(x)))
    if _NAMING.search(before):
        out["named"] = 1.0
    elif before[-1:] in "\"'" and _NAMING.search(before[:-1]):
        out["named"] = 1.0
        out["quoted"] = 1.0
    return out


def taught_spans(text: str) -> list[Span]:
    """What the model learns from: base spans, mailboxes of hosts without a dot, and a mixed run of letters and digits after
    a naming word or like a key id. By start."""
    out = base_spans(text)
    for m in _LOCALHOST.finditer(text) if "@" in text else ():
        if not any(a < m.end() and m.start() < b for _, a, b in out):
            out.append(("email", *m.span()))
    for m in re.finditer(r"[A-Za-z0-9]{12,}", text):
        x = m[0]
        if not (any(c.isdigit() for c in x) and any(c.isalpha() for c in x)):
            continue
        before = text[max(0, m.start() - 24) : m.start()].rstrip("\"'")
        if (_NAMING.search(before) or _KEY_ID.fullmatch(x)) and not any(a < m.end() and m.start() < b for _, a, b in out):
            out.append(("secret", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


Candidates = list[list[tuple[int, dict[str, float]]]]


def candidates(text: str, atoms: list[tuple[int, int]], taken: list[Span] = ()) -> Candidates:
    """For each atom the segments that may start there: (atom after the segment, features)."""
    digit = [len(_digits(text[a:b])) for a, b in atoms]
    bad = [not text[a].isalnum() and text[a] not in _JOINS or b - a > 1 and text[a].isspace() for a, b in atoms]
    out: Candidates = []
    for i, (a, _) in enumerate(atoms):
        here: list[tuple[int, dict[str, float]]] = []
        out.append(here)
        if bad[i] or not (text[a].isalnum() or text[a] == "+"):
            continue
        digits = dots = 0
        at = False
        for j in range(i, min(i + LONGEST, len(atoms))):
            if bad[j]:
                break
            start, end = atoms[j]
            digits += digit[j]
            dots += text[start] == "."
            at = at or text[start] == "@"
            if any(s < end and a < e for _, s, e in taken):
                break
            # No entity has fewer digits than a phone number, unless it has an @, three dots or is one long mixed atom.
            if text[end - 1].isalnum() and (at or digits and (digits >= 7 or dots == 3 or i == j and end - start >= 12)):
                here.append((j + 1, features(text, a, end)))
    return out


class Field:
    """Weights by (type, feature). An atom outside entities scores 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = weights or {}

    def score(self, kind: str, f: dict[str, float]) -> float:
        return sum(self.w.get((kind, k), 0.0) * v for k, v in f.items())

    def best(self, cands: Candidates) -> list[tuple[str, int, int]]:
        """The highest-scoring segmentation: (type, first atom, atom after)."""
        n = len(cands)
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for i in range(n - 1, -1, -1):  # from the right: top[i] is the best score of atoms i..n
            top[i] = top[i + 1]
            for j, f in cands[i]:
                for kind in KINDS:
                    s = self.score(kind, f) + top[j]
                    if s > top[i]:
                        top[i], back[i] = s, (kind, j)
        out, i = [], 0
        while i < n:
            if back[i]:
                out.append((back[i][0], i, back[i][1]))
                i = back[i][1]
            else:
                i += 1
        return out

    def expected(self, cands: Candidates) -> dict[tuple[int, int, str], float]:
        """Probability of each segment and type under the model, by forward and backward sums."""
        n = len(cands)
        score = [[(j, kind, self.score(kind, f)) for j, f in c for kind in KINDS] for c in cands]

        def add(xs: list[float]) -> float:
            m = max(xs)
            return m + log(sum(exp(x - m) for x in xs))

        after = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            after[i] = add([after[i + 1], *(s + after[j] for j, _, s in score[i])])
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        out = {}
        for i in range(n):
            if not into[i]:
                continue
            b = add(into[i])
            into[i + 1].append(b)
            for j, kind, s in score[i]:
                into[j].append(b + s)
                out[i, j, kind] = exp(b + s + after[j] - after[0])
        return out


#: A stretch of a text to learn from: the kind of its first entity ("" if none), a hash, the stretch with what is around
#: it, where the window starts and ends in it, and the entities in it.
Taught = tuple[str, int, str, int, int, list[Span]]


def taught_windows(text: str, each: int = FIT_EACH) -> list[Taught]:
    """At most `each` windows of every kind, those with the least hash."""
    spans = taught_spans(text)
    out: dict[str, dict[tuple[int, str], Taught]] = defaultdict(dict)
    at = 0
    for whole in windows(text):
        while at < len(spans) and spans[at][2] <= whole[0][0]:
            at += 1
        for atoms, inside in _cut(whole, spans, at):
            lo, hi = atoms[0][0], atoms[-1][1]
            if any(b - a > FIT_CHARS for a, b in atoms):
                continue
            left = max(0, lo - AROUND)
            around = text[left : hi + AROUND]
            kind = inside[0][0] if inside else ""
            h = xxhash.xxh3_64_intdigest(around.encode("utf-8", "surrogatepass")) >> 1
            held = out[kind]
            held[h, around] = (kind, h, around, lo - left, hi - left, [(k, a - left, b - left) for k, a, b in inside])
            if len(held) > each:
                held.pop(max(held))
    return [w for held in out.values() for w in held.values()]


def _cut(atoms: list[tuple[int, int]], spans: list[Span], at: int) -> Iterator[tuple[list[tuple[int, int]], list[Span]]]:
    """The window in stretches of at most `FIT_ATOMS` atoms and `FIT_CHARS` characters (but for a last entity or atom), and
    the entities in each; `spans` from `at` on may lie in it. No stretch ends inside an entity of at most `FIT_CHARS`."""
    part: list[tuple[int, int]] = []
    inside: list[Span] = []
    for a, b in atoms:
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        crossing = at < len(spans) and spans[at][1] < a and spans[at][2] - spans[at][1] <= FIT_CHARS
        if part and not crossing and (len(part) >= FIT_ATOMS or b - part[0][0] > FIT_CHARS):
            yield part, inside
            part, inside = [], []
        if at < len(spans) and spans[at][1] == a:
            inside.append(spans[at])
        part.append((a, b))
    if part:
        yield part, inside


def fit(texts: list[str]) -> Field:
    """The field of texts at hand."""
    return fit_windows([w for text in texts for w in taught_windows(text)])


def chosen_windows(found: list[Taught], most: int = FIT_WINDOWS) -> list[Taught]:
    """Each kind's equal share of the windows with the least hash; what is left over goes to the kinds that have more."""
    by: dict[str, list[Taught]] = defaultdict(list)
    last = None
    for w in sorted(found, key=lambda w: w[1:]):
        if w != last:
            by[w[0]].append(w)
        last = w
    out, left = [], most
    for k, kind in enumerate(sorted(by, key=lambda x: (len(by[x]), x))):
        share = by[kind][: left // (len(by) - k)]
        out += share
        left -= len(share)
    return sorted(out, key=lambda w: w[1:])


def fit_windows(found: list[Taught], steps: int = 25, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood with AdaGrad steps, one window after the other."""
    taught = []
    for _, _, text, lo, hi, spans in chosen_windows(found):
        atoms = [m.span() for m in _ATOM.finditer(text, lo, hi)]
        cands = candidates(text, atoms)
        first, after = {a: i for i, (a, _) in enumerate(atoms)}, {b: i + 1 for i, (_, b) in enumerate(atoms)}
        gold, used = {}, 0
        for kind, a, b in spans:
            i, j = first.get(a), after.get(b)
            if i is not None and j is not None and i >= used and j - i <= LONGEST:
                f = dict(cands[i]).get(j)
                if f is not None:
                    gold[i, j, kind] = f
                    used = j
        taught.append((cands, gold))
    field, seen = Field(), defaultdict(float)
    for _ in range(steps if taught else 0):
        moved = 0.0
        for cands, gold in taught:
            slope: dict[tuple[str, str], float] = defaultdict(float)
            for (_, _, kind), f in gold.items():
                for k, v in f.items():
                    slope[kind, k] += v
            by = [dict(c) for c in cands]
            for (i, j, kind), p in field.expected(cands).items():
                if p > 1e-4:
                    for k, v in by[i][j].items():
                        slope[kind, k] -= p * v
            for k, g in slope.items():
                g -= decay * field.w.get(k, 0.0)
                moved += abs(g)
                seen[k] += g * g
                field.w[k] = field.w.get(k, 0.0) + rate * g / (seen[k] ** 0.5 + 1e-6)
        if moved < 0.01 * len(taught):
            break
    return field


def fit_on(docs: DataFrame, text: str = "text", rows: int = FIT_DOCS) -> Field:
    """Learns from the `rows` documents with the least hash of their text, as far as they have a digit or @. Equal
    windows count once. Hashes alone are ordered; texts are only read below the last hash, in tasks, and at most `FIT_WINDOWS`
    windows of a kind come to the driver."""
    hashed = docs.select(F.col(text).alias("t")).where("t is not null").select(F.xxhash64("t").alias("h"), "t")
    last = hashed.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return Field()
    chosen = hashed.where((F.col("h") <= last) & F.col("t").rlike("[0-9@]")).select("t")
    parts = "kind string, h bigint, around string, lo int, hi int, spans array<struct<kind:string,a:int,b:int>>"
    schema = StructType.fromDDL(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [w for t in batch.column(0) for w in taught_windows(t.as_py())]
            spans = [[dict(zip("kind a b".split(), x)) for x in w[5]] for w in rows]
            columns = [*([w[k] for w in rows] for k in range(5)), spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    order = ["h", "around", "lo", "hi", "spans"]
    best = chosen.mapInArrow(run, schema).distinct().withColumn(
        "n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("n") <= FIT_WINDOWS)
    return fit_windows([(*r[:5], [tuple(x) for x in r["spans"]]) for r in best.drop("n").collect()])


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and kind."""
    base = base_spans(text)
    more = []
    if _MARK.search(text):
        for atoms in windows(text):
            lo, hi = atoms[0][0], atoms[-1][1]
            taken = [s for s in base if s[1] < hi and lo < s[2]]
            cands = candidates(text, atoms, taken)
            if any(cands):
                more += [(kind, atoms[i][0], atoms[j - 1][1]) for kind, i, j in field.best(cands)]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Key, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, comma-joined)."""
    field = field or fit_on(docs, text)
    source = only(docs, [key, text])
    schema = keyed(source, key, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py() or "", field) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
            texts = [pa.array([written(s[i]) for s in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *texts], names=schema.names)

    return source.mapInArrow(run, schema)


def masked(field: Field, text: Column | str = "text") -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None or not (spans := find(t, field)[1]):
                out.append(t)
                continue
            parts, at, k = [], 0, 0
            while k < len(spans):
                kind, a, b = spans[k]
                while k + 1 < len(spans) and spans[k + 1][1] < b:
                    k += 1
                    b = max(b, spans[k][2])
                parts += [t[at:a], f"<{kind}>"]
                at, k = b, k + 1
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return mask(text)
