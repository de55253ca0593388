"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control by length.

Base kinds: assignments of a password, token or key, access ids, long hex runs. The method adds whole runs of 20 characters or more of one
encoding (hex, base32, base64) that lie outside base spans and behave like uniform draws from its alphabet. Three tests give p-values:
chi-squared over equal parts of the alphabet, the number of runs about the middle of the alphabet, and what the correlation of neighbours
adds to it, so that the three are independent; Fisher's sum combines them. A run that no encoding holds, or whose p is below ``LEAST``, is divided at its separators, first at + and /, then at
_ and -, then at all four; each part of 20 or more is tested in its place, so that a token glued into an address is found.

Random strings have even p-values, those of words are taken as even on a log scale. In each stratum (encoding and length band) the share of
random runs is the likeliest one, given its counts between the ``EDGES`` and ``PRIOR`` runs with the share of the other bands of its encoding; these
have ``PRIOR`` runs with the share of the other encodings, these with ``EXPECTED``: small strata lean on their neighbours, large ones on themselves.
A run counts as a secret from the smallest edge on where at most ``RATE`` of the accepted are
expected not to be random, and at the edge itself at most half. The histograms cover all documents and have a fixed size.

Null counts as empty: no spans. Repeated rows and null ids are answered each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch_of, slices, texts

#: The base patterns in their order.
ASSIGN = re.compile(r"""(?P<word>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched from its start, so the count may stand in the pattern
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")  # greedy, so a run is matched whole from its start
ENCODINGS = (("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
EDGES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
LEAST, RATE, PRIOR, EXPECTED, SHORTEST = EDGES[0], 0.1, 2, 0.9, 20
PARTS = (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), re.compile(r"[^+/_-]+"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches without overlap of each kind; matches that are too short are dropped after matching."""
    low = text.lower()
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if any(h in low for h in HINTS) else []
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def encoding(run: str) -> tuple[str, str] | None:
    """The smallest alphabet that holds all characters of the run."""
    used = set(run)
    return next((e for e in ENCODINGS if used <= set(e[1])), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(run: str, alphabet: str) -> float:
    """Combined p-value of the three tests under uniform independent draws from the alphabet."""
    n, k = len(run), len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    at = [place[c] for c in run]
    parts = 4 if n < 40 else 8 if n < 160 else 16
    counts = [0] * parts
    for i in at:
        counts[i * parts // k] += 1
    p = [_chi_tail(sum((c - n / parts) ** 2 for c in counts) * parts / n, parts - 1)]
    high = [i >= k // 2 for i in at]
    turns = sum(a != b for a, b in zip(high, high[1:]))
    z = (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    p.append(_normal_tail(z))
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    serial = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / (spread * math.sqrt(n - 1))
    shared = (k / 4) ** 2 / spread  # turns tell so much of the correlation already; the rest is independent of them
    p.append(_normal_tail((serial + shared * z) / math.sqrt(1 - shared * shared)))
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    return math.exp(-half) * (1 + half + half * half / 2)


def outside(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans leave of the runs; spans are in the order of their starts and looked at once."""
    first, far = 0, 0
    for m in RUN.finditer(text):
        start, end = max(m.start(), far), m.end()
        while first < len(taken) and taken[first][1] < end:
            if start < taken[first][1]:
                yield start, taken[first][1]
            far = max(far, taken[first][2])
            start = max(start, far)
            first += 1
        if start < end:
            yield start, end


def tested(text: str, start: int, end: int) -> tuple[str, float] | None:
    """Stratum and p of a run, if one encoding holds it and it is not plainly unlike random draws."""
    told = encoding(text[start:end]) if end - start >= SHORTEST else None
    p = randomness(text[start:end], told[1]) if told else 0.0
    return (f"{told[0]}:{min(int(math.log2((end - start) / SHORTEST) * 2), 8)}", p) if p >= LEAST else None


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, float]]:
    """Runs of one encoding outside base spans, or parts of runs: kind, start, end, stratum, p. What a base span leaves of a run is a run of its own."""
    found = []
    for start, end in outside(text, taken):
        whole = tested(text, start, end)
        if whole:
            found.append(("random", start, end, *whole))
            continue
        left = [(start, end)] if end - start > SHORTEST else []
        for parts in PARTS:
            rest = []
            for a, b in left:
                done = a
                for m in parts.finditer(text, a, b):
                    told = tested(text, m.start(), m.end()) if m.end() - m.start() < b - a else None
                    if told:
                        found.append(("random", m.start(), m.end(), *told))
                        rest.append((done, m.start()))
                        done = m.end()
                rest.append((done, b))
            left = [(a, b) for a, b in rest if b - a > SHORTEST]
    return found


EVEN = [(b - a) / (1 - LEAST) for a, b in zip(EDGES, (*EDGES[1:], 1.0), strict=True)]
STEEP = [math.log(b / a) / -math.log(LEAST) for a, b in zip(EDGES, (*EDGES[1:], 1.0), strict=True)]


def random_share(n: list[int], near: float) -> float:
    """The likeliest share of random runs; n counts the runs from each edge to the next, ``PRIOR`` more have the share ``near``."""
    share = near
    for _ in range(200):
        random = sum(c * share * e / (share * e + (1 - share) * s) for c, e, s in zip(n, EVEN, STEEP, strict=True) if c)
        share = (random + PRIOR * near) / (sum(n) + PRIOR)
    return share


def limit_of(share: float) -> float | None:
    """The p from which runs count as random; none where the rate holds nowhere."""
    for i, edge in enumerate(EDGES):
        others, random = (1 - share) * sum(STEEP[i:]), share * sum(EVEN[i:])
        if others <= RATE * (others + random) and (1 - share) / (-math.log(LEAST) * edge) <= share / (1 - LEAST):
            return edge
    return None


def limits_of(counts: dict[str, list[int]]) -> dict[str, float]:
    """The limit of each stratum (encoding:band)."""
    total = lambda rows: [sum(column) for column in zip([0] * len(EDGES), *rows, strict=True)]
    found = {}
    for stratum, n in counts.items():
        kind = stratum.split(":")[0]
        others = total([x for k, x in counts.items() if k.split(":")[0] != kind])
        near = total([x for k, x in counts.items() if k != stratum and k.split(":")[0] == kind])
        share = random_share(n, random_share(near, random_share(others, EXPECTED)))
        limit = limit_of(share)
        if limit is not None:
            found[stratum] = limit
    return found


def limits(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """For each stratum the p from which a run counts as random, over all documents; at most strata * edges rows are grouped at once."""
    schema = pa.schema([("stratum", pa.string()), ("bin", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [r for x in batch.column(0).to_pylist() for r in candidates(x or "", base_spans(x or ""))]
            yield batch_of(schema, [r[3] for r in found], [bisect_right(EDGES, r[4]) - 1 for r in found])

    runs = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "stratum string, bin int")
    counts: dict[str, list[int]] = {}
    for r in runs.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["stratum"], [0] * len(EDGES))[r["bin"]] = r["n"]
    return limits_of(counts)


def all_spans(text: str, limit: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans together, both by start and kind."""
    base = base_spans(text)
    added = [r[:3] for r in candidates(text, base) if r[4] >= limit.get(r[3], 2.0)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans (arrays of kind, start, end in code points; by start, then kind): one row for each row of ``docs``."""
    plain = texts(docs, id_col, text_col)
    limit = limits(plain)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    tell = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in rows], span)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [all_spans(x or "", limit) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), tell([b for b, _ in both]), tell([a for _, a in both])], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind string, start int, end int>>"
    return plain.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def covered(text: str | None, limit: dict[str, float]) -> str | None:
    done, parts = 0, []
    for kind, start, end in all_spans(text or "", limit)[1]:
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if parts else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with every span of ``text_col`` replaced by [kind]; all other text stays; null stays null."""
    limit = limits(docs, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            i = batch.schema.get_field_index(text_col)
            columns = list(batch.columns)
            columns[i] = pa.array([covered(x, limit) for x in columns[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
