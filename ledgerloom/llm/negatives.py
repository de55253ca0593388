"""Hard negatives from embeddings: exact integer scores of every anchor against every row through Kronecker-packed products.

Method. Components become whole numbers, ``floor(256 * x)``. The candidates of a block are packed: component j of all of them, biased so that
none is negative, stands in separated fields of one wide integer. An anchor component multiplies that integer once; the sum over the components
holds every candidate's score in its own field, exact because a field is wide enough for the largest sum that the block and the anchors allow.
The biases are taken out with the sums of the components.

Spark's part. Rows are packed into blocks where they are read (no shuffle of rows); anchors are taken from the blocks and packed again; blocks of
anchors meet blocks of candidates through a join on the anchor block (a stated query set against all rows, in blocks). A task keeps the best few
per anchor of an anchor block while candidate blocks stream past, so what is merged afterwards is bounded by tasks, not by rows. A first pass
finds the positives, a second one the negatives between 80 % and 100 % of each positive's score.

Cases. Rows with a null id, label or vector, or a component that is null or not finite, take no part. An anchor is scored against rows of its
own length only; rows without components score 0. Each row is one by itself: repeated rows are anchors, positives and negatives each, and an
anchor that stands there twice gets the same rows twice. Scores beyond 63 bits count as the largest or smallest of 63 bits. An empty table, a single
label or an anchor without others of its label give no rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.session import broadcast_if_small

#: Candidates packed into one wide integer, and rows in one block.
FIELDS, BLOCK = 1024, 4096
#: Anchors in one block of anchors.
ANCHORS = 2048
#: Anchor blocks whose best rows a task holds at a time.
HELD = 16
#: Where the anchors are too many for a broadcast: candidate blocks in a lane, and lanes at least. Every lane gets all anchor blocks.
LANE_BLOCKS, LANES = 32, 32
#: Bounds of a score.
LONG = (1 - (1 << 63), (1 << 63) - 1)

BLOCKS = "dim int, n int, ids binary, keys binary, labels binary, kind string, data binary"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), exact: int64 where the components fit, Python integers else."""
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(256.0 * x).astype(np.int64)
    return np.array([[int(v) * 256 if abs(v) >= 2.0**53 else math.floor(v * 256) for v in row] for row in x.tolist()], dtype=object)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Components of a block for the trip: as 16-bit whole numbers where they fit, else as they came."""
    ints = whole(x)
    if not ints.size or (ints.dtype != object and np.abs(ints).max() < 1 << 15):
        return "i2", ints.astype("<i2").tobytes()
    return "f8", x.astype("<f8").tobytes()


def _unpacked(kind: str, data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i2").astype(np.int64).reshape(n, dim) if kind == "i2" else whole(np.frombuffer(data, "<f8").reshape(n, dim))


def _blocks(schema: pa.Schema):
    """Arrow step: rows (key, id, label, vector) -> one row for each length and BLOCK rows of a batch."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.asarray(lists.value_lengths())
            flat, starts = np.asarray(lists.flatten(), dtype=np.float64), np.r_[0, np.cumsum(sizes)]
            key, ids, label = (np.asarray(batch.column(c)) for c in ("key", "id", "label"))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for i in range(0, len(rows), BLOCK):
                    own = rows[i : i + BLOCK]
                    kind, data = _packed(flat[starts[own][:, None] + np.arange(dim)] if dim else np.zeros((len(own), 0)))
                    one = ([int(dim)], [len(own)], [ids[own].astype("<i8").tobytes()], [key[own].astype("<i8").tobytes()], [label[own].astype("<i8").tobytes()], [kind], [data])
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(one, schema, strict=True)], schema=schema)

    return pack


class Candidates:
    """A block of candidates in wide integers; ``scores`` gives one anchor's products with all of them."""

    def __init__(self, vectors: np.ndarray, alpha: int, largest: int) -> None:
        """alpha: what is added to an anchor's components so that none is negative; largest: the largest component of an anchor after that."""
        n, dim = vectors.shape
        self.n, self.dim, self.alpha = n, dim, alpha
        low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
        self.beta = max(0, -low)
        bits = (dim * largest * (high + self.beta) + 1).bit_length()
        self.width = 4 if bits <= 32 else 8 * -(-bits // 64)
        self.sums = [int(s) for s in vectors.sum(axis=1)] if vectors.dtype == object else vectors.sum(axis=1)
        biased = vectors + self.beta
        self.wide = [[self._wide(biased[i : i + FIELDS, j]) for j in range(dim)] for i in range(0, n, FIELDS)]

    def _wide(self, column: np.ndarray) -> int:
        if self.width <= 8 and column.dtype != object:
            return int.from_bytes(column.astype(f"<u{self.width}").tobytes(), "little")
        return int.from_bytes(b"".join(int(v).to_bytes(self.width, "little") for v in column), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        lifted = [a + self.alpha for a in anchor]
        found = []
        for i, wide in enumerate(self.wide):
            n = min(FIELDS, self.n - i * FIELDS)
            fields = sum(map(mul, lifted, wide)).to_bytes(n * self.width, "little")
            found.append(np.frombuffer(fields, f"<u{self.width}") if self.width <= 8 else np.array([int.from_bytes(fields[k : k + self.width], "little") for k in range(0, len(fields), self.width)], dtype=object))
        biased, fixed = np.concatenate(found), self.beta * sum(anchor) + self.dim * self.alpha * self.beta
        if biased.dtype.itemsize == 4 and self.width == 4 and not isinstance(self.sums, list) and self.alpha < 1 << 31:
            return biased.astype(np.int64) - fixed - self.alpha * self.sums
        exact = [int(b) - fixed - self.alpha * int(s) for b, s in zip(biased.tolist(), self.sums, strict=True)]
        return np.array([min(max(s, LONG[0]), LONG[1]) for s in exact], dtype=np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, held: list, k: int) -> list:
    """The first k of what is held and of new rows: highest score, then smallest id; (score, id, key) each."""
    if len(held) == k:  # rows below the last one held can't enter
        enters = scores >= held[-1][0]
        scores, ids, keys = scores[enters], ids[enters], keys[enters]
    if not len(scores):
        return held
    if len(scores) > k:
        order = np.lexsort((keys, ids, -scores))[:k]
        scores, ids, keys = scores[order], ids[order], keys[order]
    new = [*held, *zip(scores.tolist(), ids.tolist(), keys.tolist(), strict=True)]
    return sorted(new, key=lambda x: (-x[0], x[1], x[2]))[:k]


def _matches(schema: pa.Schema, k: int, negatives: bool, low: int):
    """Arrow step over pairs of blocks -> the best rows of this task: (anchor, slot, score, id, key).

    Positives (slot 0): other rows of the anchor's label. Negatives (slot p): rows of another label scored from ``low`` % to 100 % of the
    anchor's positive p.
    """

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: OrderedDict = OrderedDict()

        def out(state: dict) -> Iterator[pa.RecordBatch]:
            rows = [(int(state["keys"][i]), slot, *row) for (i, slot), best in state["best"].items() for row in best]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if row["dim"] != row["a_dim"]:
                    continue
                state = states.pop(row["a_block"], None)
                if state is None:
                    vectors = _unpacked(row["a_kind"], row["a_data"], row["a_dim"], row["a_n"])
                    alpha = max(0, -int(vectors.min())) if vectors.size else 0
                    state = {"vectors": vectors.tolist(), "alpha": alpha, "largest": (int(vectors.max()) if vectors.size else 0) + alpha, "best": {}}
                    state |= {c: np.frombuffer(row[f"a_{c}"], "<i8") for c in ("keys", "labels")} | {"slots": row.get("slots")}
                    while len(states) >= HELD:
                        yield from out(states.popitem(last=False)[1])
                states[row["a_block"]] = state
                ids, keys, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "keys", "labels"))
                block = Candidates(_unpacked(row["kind"], row["data"], row["dim"], row["n"]), state["alpha"], state["largest"])
                for i, anchor in enumerate(state["vectors"]):
                    same = labels == state["labels"][i]
                    if negatives:
                        scores, slots = block.scores(anchor), state["slots"][i]
                        fit = [((i, p), ~same & (scores <= s) & (scores >= -(-low * s // 100)) if s >= 0 else None) for p, s in enumerate(slots)]
                    elif not same.any():
                        continue
                    else:
                        scores, fit = block.scores(anchor), [((i, 0), same & (keys != state["keys"][i]))]
                    for at, rows in fit:
                        if rows is not None and rows.any():
                            state["best"][at] = _best(scores[rows], ids[rows], keys[rows], state["best"].get(at, []), k)
        for state in states.values():
            yield from out(state)

    return match


def _anchors(every: int):
    """Arrow step: blocks of rows -> their anchors, a row each."""

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "keys", "labels"))
                size = len(row["data"]) // max(1, row["n"])
                own = np.flatnonzero(ids % every == 0)
                columns = [[row["dim"]] * len(own), keys[own], ids[own], labels[own], [row["kind"]] * len(own), [row["data"][i * size : (i + 1) * size] for i in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["dim", "key", "id", "label", "kind", "data"])

    return take


def _regroup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow step: anchor rows -> blocks of up to ANCHORS of one length and kind; the block's name is the key of its first anchor."""
    held: dict = {}

    def out(at: tuple) -> pa.RecordBatch:
        rows = held.pop(at)
        long = lambda c: np.array([r[c] for r in rows], dtype="<i8").tobytes()
        return pa.RecordBatch.from_pydict({"a_block": [rows[0]["key"]], "a_dim": pa.array([at[0]], pa.int32()), "a_n": pa.array([len(rows)], pa.int32()), "a_keys": [long("key")], "a_labels": [long("label")], "a_kind": [at[1]],
                                           "a_data": [b"".join(r["data"] for r in rows)], "slots": pa.array([[r["slots"] or [] for r in rows]], pa.list_(pa.list_(pa.int64())))})

    for batch in batches:
        for row in batch.to_pylist():
            at = (row["dim"], row["kind"])
            held.setdefault(at, []).append(row)
            if len(held[at]) == ANCHORS:
                yield out(at)
    for at in list(held):
        yield out(at)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and slot over all tasks; Spark keeps k a task before the shuffle."""
    order = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for the rows whose id is divisible by ``every``, and each of
    their first ``positives`` other rows of the same label, the first ``negatives`` rows of other labels with ``low`` % to 100 % of its score."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    rows = rows.filter("id is not null and label is not null and vector is not null").filter(good)
    types = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "long": pa.int64()}
    arrow = lambda ddl: pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])
    blocks = written(rows.mapInArrow(_blocks(arrow(BLOCKS)), BLOCKS), "negatives-blocks")
    anchors = written(blocks.mapInArrow(_anchors(every), "dim int, key long, id long, label long, kind string, data binary"), "negatives-anchors")

    n, lanes = anchors.count(), max(LANES, blocks.count() // LANE_BLOCKS)
    pairs = "a_block long, a_dim int, a_n int, a_keys binary, a_labels binary, a_kind string, a_data binary, slots array<array<long>>"
    result = "anchor long, slot int, score long, id long, key long"

    def against_all(of: DataFrame, name: str, k: int, negative: bool) -> DataFrame:
        """Every anchor block meets every candidate block: by broadcast while the anchor blocks are small, else lane by lane of candidate blocks."""
        packed = written(of.repartition(max(1, -(-n // ANCHORS))).mapInArrow(_regroup, pairs), f"negatives-{name}")
        small = broadcast_if_small(packed, packed)
        if small is not packed:
            met = blocks.withColumn("lane", F.lit(0)).join(small.withColumn("lane", F.lit(0)), "lane")
        else:
            met = packed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).join(blocks.withColumn("lane", F.pmod(F.xxhash64("keys"), F.lit(lanes)).cast("int")), "lane")
        return written(_first(met.drop("lane").mapInArrow(_matches(arrow(result), k, negative, low), result), k), f"negatives-{name}-best")

    best = against_all(anchors.withColumn("slots", F.lit(None).cast("array<long>")), "positives", positives, False)
    scores = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x.score).alias("slots"))
    found = against_all(anchors.join(scores, anchors["key"] == scores["anchor"]).drop("anchor"), "negatives", negatives, True)
    positive = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"))
    return (found.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positive, ["anchor", "slot"]).join(named, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
