"""Context-triggered piecewise hashing.

A rolling hash over seven bytes marks boundaries; level L keeps those whose hash ends in L zero bits, so the boundaries of a level are among
those of the level below. The level of a text is the lowest with at most ``CHUNKS`` chunks; a fingerprint is "level:chunks:chunks of the next
level", each chunk two characters of a hash of its bytes alone. Likeness: 2 * common / (both lengths) of the chunk sequences (the
edit distance with insertions and deletions), at an equal level or where one's next level is the other's; 0 at others.

Null counts as empty; the fingerprint of an empty text is "0::", and two empty texts have likeness 1. Equal texts have equal fingerprints.

For the next document, rows are dealt into ranges of ids and sorted inside them; one pass pairs the rows of a range, and the two ends of
each range, one row for each partition, are paired in a small join. Null ids come first; rows of one id follow each other by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch_of, slices, texts, written

WINDOW, CHUNKS, LEVELS = 7, 64, 40
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """_STEP ** i and its inverse modulo 2 ** 64, for i below n; the tables grow with the longest text so far."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _chunks(sums: np.ndarray, inverse: np.ndarray, n: int, ends: np.ndarray) -> str:
    """Two characters for each chunk, from its bytes alone; the last chunk runs to the end of the text."""
    starts = np.r_[0, ends]
    starts = starts[starts < n]
    h = _mix((sums[np.r_[starts[1:], n]] - sums[starts]) * inverse[starts] + np.uint64(1)) >> np.uint64(52)
    return "".join(ALPHABET[x >> 6] + ALPHABET[x & 63] for x in h.tolist())


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = len(data)
    if not n:
        return "0::"
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[:n], out=sums[1:])
    # the hash of the bytes of a window is the same wherever it stands
    h = sums[1:].copy()
    h[WINDOW:] -= sums[1:-WINDOW] if n > WINDOW else 0
    h *= inverse[:n]
    h = _mix(h)
    ends = np.flatnonzero((h & np.uint64(15)) == 0) + 1  # level 4 and above: chunks of 16 bytes on average or more
    marks = h[ends - 1]
    level = 4
    while len(ends) >= CHUNKS and level < LEVELS:
        level += 1
        keep = (marks & np.uint64((1 << level) - 1)) == 0
        ends, marks = ends[keep], marks[keep]
    upper = ends[(marks & np.uint64((2 << level) - 1)) == 0]
    return f"{level}:{_chunks(sums, inverse, n, ends)}:{_chunks(sums, inverse, n, upper)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence of chunks, a bit for each chunk of a."""
    n = len(a) // 2
    place: dict[str, int] = {}
    for i in range(n):
        place[a[2 * i : 2 * i + 2]] = place.get(a[2 * i : 2 * i + 2], 0) | 1 << i
    full = v = (1 << n) - 1
    for j in range(0, len(b), 2):
        u = v & place.get(b[j : j + 2], 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def likeness(one: str, two: str) -> float:
    if one == two:
        return 1.0
    (a, a1, a2), (b, b1, b2) = one.split(":"), two.split(":")
    best = 0.0
    for x, i in ((a1, int(a)), (a2, int(a) + 1)):
        for y, j in ((b1, int(b)), (b2, int(b) + 1)):
            if i == j and x and y:
                best = max(best, 4 * _common(x, y) / (len(x) + len(y)))
    return best


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint: one row for each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [x or "" for x in batch.column(1).to_pylist()]
            yield batch_of(schema, batch.column(0), [len(x) for x in rows], [fingerprint(x) for x in rows])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_PAIR = "kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_PAIR_ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])


def _paired(part: int | None, doc_id: int | None, text: str, mark: str, following: str, following_mark: str) -> tuple:
    k = len(text) // 2
    edited = text[: len(text) - k] + following[:k]
    edited_mark = fingerprint(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return ("row", part, doc_id, len(text), digest, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, following_mark), None)


def _pair_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order: each with its next; the first and the last are also given with their texts, for the partitions beside."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last = None
    for batch in slices(batches):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            mark = fingerprint(text)
            if last is None:
                out.append(("head", part, doc_id, len(text), None, mark, None, None, None, text))
            else:
                out.append(_paired(part, *last, text, mark))
            last = (doc_id, text, mark)
        yield batch_of(_PAIR_ARROW, *zip(*out, strict=True))
    if last is not None:
        yield batch_of(_PAIR_ARROW, ["tail"], [part], [last[0]], [len(last[1])], [None], [last[2]], [None], [None], [None], [last[1]])


def _pair_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 32):
        yield batch_of(_PAIR_ARROW, *zip(*(_paired(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), strict=True))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of ``docs``.

    The edited text is the text with its last half replaced by the beginning of the next one by id (after the last: the first).
    """
    docs = texts(docs, id_col, text_col)
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranged by the beginning of the text too, so that rows of one id, or without one, are spread; the order within is by the whole text
    dealt = docs.repartitionByRange(ranges, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    found = written(dealt.mapInArrow(_pair_rows, _PAIR), "fingerprints")
    # one row for each partition, without texts: which partition with rows comes next
    parts = found.filter("kind = 'head'").select("part")
    order = W.orderBy("part")
    following = parts.select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("part"))
    heads = found.filter("kind = 'head'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    tails = found.filter("kind = 'tail'").select(F.col("part").alias("before"), "doc_id", "text", "fingerprint")
    ends = tails.join(following, "before").join(heads, "part").select("part", "doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(_pair_ends, _PAIR)
    return found.filter("kind = 'row'").union(ends).drop("kind", "part", "text")
