"""Near-duplicates by chosen paths: a set similarity join over shingle sets.

1. Each document becomes its set of distinct word shingles, 64 minwise values of it, and a 128-bit key; equal sets are one from here on.
2. Independent trees: the root of tree i branches by minwise value i. Nodes of at most ``SMALL`` members are compared exhaustively by their
   minwise values. In a larger node all members meet about eight random leaders, and those that resemble one are connected; at most
   ``SMALL`` outliers are compared with all others, in blocks; if there are more, each member goes on to two children, named by the minwise values at two coordinates that the node chooses. What is still large at the deepest level is
   compared exhaustively in blocks. Only spanning edges of resemblance leave a node, never all pairs. A pair at the threshold
   survives an endless path with 0.94 once it shares a root's branch (q = (0.2 + 0.8 q)^2), so 12 trees miss it with
   (1 - 0.8 * 0.94)^12 < 1e-7; the filter by minwise values (33 of 64 equal) misses it with less than 1e-7.
3. The components of these edges are clusters of candidates. Inside a cluster links are decided on the full sets: a matrix product
   counts all intersections of a block exactly. Clusters over one block first meet some leaders, whose links join most of them;
   then only blocks of different components are compared.
4. The components of the exact links are the answer.

Documents without words are linked with nothing. Null ids: the row keeps its set size, has no component and is kept. Rows of one id are
one document. Repeated rows are answered each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch_of, slices, texts, written
from ledgerloom.llm.components import components

COORDINATES = 64
TREES, DEPTH, CHILDREN, SMALL = 12, 12, 2, 2048
ALIKE = 33
BLOCK, LEADERS = 256, 8
_RANDOM = np.random.default_rng(20_240)
_XOR = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(width, len(h))
    rolled = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        rolled += h[i : len(h) - k + 1 + i] * _SHINGLE[i % 64]
    rolled = np.sort(_mix(rolled))
    return rolled[np.r_[True, rolled[1:] != rolled[:-1]]]


def minwise(h: np.ndarray) -> np.ndarray:
    """The smallest of the re-hashed set at each coordinate, in steps that bound the memory."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 512):
        np.minimum(least, ((h[None, i : i + 512] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null without words), sig: one row for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, width) for x in batch.column(1).to_pylist()]
            yield batch_of(schema, batch.column(0), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [minwise(s).tobytes() if len(s) else None for s in sets])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


class Forest:
    """Union-find over positions; ``join`` says whether it joined anything."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows with equal first ``keys`` columns; the caller's groups are bounded."""
    rows = (row for batch in slices(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, run in groupby(rows, key=lambda r: r[:keys]):
        yield list(run)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch_of(_EDGE, [a for a, _ in pairs], [b for _, b in pairs])


def _compare_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, doc_id, sig) sorted by node and part: spanning edges of the members that resemble each other."""
    for run in _runs(batches, 2):
        ids = [r[2] for r in run]
        sigs = np.frombuffer(b"".join(r[3] for r in run), np.uint32).reshape(len(run), COORDINATES)
        found = _spanning(ids, sigs, range(len(ids) - 1), np.arange(len(ids)))
        if found:
            yield _edges(found)


def _spanning(ids: list[int], sigs: np.ndarray, rows: Iterable[int], label: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the given rows to members of other labels that resemble them; joined labels become one."""
    found = []
    for i in rows:
        others = np.flatnonzero(label != label[i])
        for j in others[(sigs[others] == sigs[i]).sum(axis=1) >= ALIKE].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                if ids[i] != ids[j]:
                    found.append((ids[i], ids[j]))
    return found


_LEADERS = "node long, ids array<long>, sigs binary, edges array<struct<a long, b long>>"
_LEADERS_ARROW = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("sigs", pa.binary()), ("edges", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])


def _judge_leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, leaders array<struct<doc_id, sig>>) -> the largest set of leaders that resemble each other, directly or by others, with edges that connect it."""
    for batch in slices(batches):
        out = []
        for node, leaders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sigs = np.frombuffer(b"".join(x["sig"] for x in leaders), np.uint32).reshape(len(leaders), COORDINATES)
            forest = Forest(len(leaders))
            alike = (sigs[:, None] == sigs[None, :]).sum(axis=2) >= ALIKE
            edges = [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1))), strict=True) if forest.join(i, j)]
            roots = [forest.root(i) for i in range(len(leaders))]
            main = max(roots, key=lambda r: (roots.count(r), -r))
            own = [i for i, r in enumerate(roots) if r == main]
            out.append((node, [leaders[i]["doc_id"] for i in own], sigs[own].tobytes(), [{"a": leaders[i]["doc_id"], "b": leaders[j]["doc_id"]} for i, j in edges if roots[i] == main]))
        yield batch_of(_LEADERS_ARROW, *zip(*out, strict=True))


def _compare_leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, doc_id, sig, n, ids, sigs) -> node, doc_id, sig, n, leader: the first that the member resembles, null if none."""
    for batch in slices(batches, 1024):
        sigs, found = _matrix(batch.column(2)), []
        for own, ids, theirs in zip(sigs, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            alike = np.flatnonzero((np.frombuffer(theirs, np.uint32).reshape(-1, COORDINATES) == own).sum(axis=1) >= ALIKE)
            found.append(ids[alike[0]] if len(alike) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.int64())], names=["node", "doc_id", "sig", "n", "leader"])


def _compare_outliers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, doc_id, sig, outlier) sorted by node and part: edges of the outliers to each other and to the rest, which is connected already."""
    for run in _runs(batches, 2):
        ids = [r[2] for r in run]
        sigs = np.frombuffer(b"".join(r[3] for r in run), np.uint32).reshape(len(run), COORDINATES)
        out = [i for i, r in enumerate(run) if r[4]]
        label = np.array([i if r[4] else -1 for i, r in enumerate(run)])
        found = _spanning(ids, sigs, out, label)
        if found:
            yield _edges(found)


def _branch_by(level: int):
    def branch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, doc_id, sig) -> one row for each child that the member goes to."""
        schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("sig", pa.binary())])
        for batch in slices(batches, 2048):
            sigs = _matrix(batch.column(2))
            nodes = np.array(batch.column(0).to_pylist(), np.int64).view(np.uint64)
            for child in range(CHILDREN):
                at = (_mix(nodes ^ np.uint64(level * CHILDREN + child + 1)) % np.uint64(COORDINATES)).astype(np.int64)
                chosen = sigs[np.arange(len(sigs)), at].astype(np.uint64)
                name = _mix(_mix(nodes + np.uint64((level * CHILDREN + child + 1) * 0x9E3779B97F4A7C15 % 2**64)) ^ (chosen + (at.astype(np.uint64) << np.uint64(32)))).view(np.int64)
                yield batch_of(schema, name, batch.column(1), batch.column(2))

    return branch


def _blocks(column: str, n: str, size: int):
    """A block of about ``size`` members by hash: no ranking over a group."""
    return F.pmod(F.xxhash64(column, F.lit(7)), F.ceil(F.col(n) / size).cast("long"))


def candidate_edges(reps: DataFrame) -> list[DataFrame]:
    """Spanning edges of resemblance from all trees; ``reps`` has doc_id and sig of the distinct sets."""
    edges = []
    root = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(TREES)), lambda i: F.xxhash64(i, F.substring("sig", (i - 1) * 4 + 1, 4))))
    rows, carried = reps.select("doc_id", root.alias("tree", "node")).select("node", "doc_id"), False
    for level in range(1, DEPTH + 1):
        draw = F.xxhash64("node", "doc_id")
        stats = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(draw).alias("least")).filter("n > 1")
        members = rows.join(written(stats, "stats"), "node")
        members = written(members if carried else members.join(reps, "doc_id").select("node", "doc_id", "sig", "n", "least"), "nodes")
        small = members.filter(F.col("n") <= SMALL).select("node", F.lit(0).alias("part"), "doc_id", "sig")
        edges.append(small.repartition("node").sortWithinPartitions("node", "part").mapInArrow(_compare_nodes, "a long, b long"))
        large = members.filter(F.col("n") > SMALL)
        # about LEADERS of a node by their hashes, one at least
        leads = (draw.cast("double") <= F.lit(2.0**63) * (F.lit(2.0 * LEADERS) / F.col("n") - 1)) | (draw == F.col("least"))
        leaders = large.filter(leads).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("doc_id", "sig"))).alias("leaders"))
        leaders = written(leaders.mapInArrow(_judge_leaders, _LEADERS), "leaders")
        edges.append(leaders.select(F.explode("edges").alias("e")).select("e.a", "e.b"))
        met = large.join(leaders.drop("edges"), "node").select("node", "doc_id", "sig", "n", "ids", "sigs").mapInArrow(_compare_leaders, "node long, doc_id long, sig binary, n long, leader long")
        met = written(met, "met")
        edges.append(met.filter("leader is not null").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
        outliers = written(met.filter("leader is null").groupBy("node").agg(F.count("*").alias("out")), "outliers")
        edges.append(_outlier_blocks(met.join(outliers.filter(F.col("out") <= SMALL), "node")).mapInArrow(_compare_outliers, "a long, b long"))
        mixed = outliers.filter(F.col("out") > SMALL)
        if mixed.isEmpty():
            break
        onward = met.join(mixed, "node")
        if level < DEPTH:
            rows, carried = written(onward.select("node", "doc_id", "sig").mapInArrow(_branch_by(level), "node long, doc_id long, sig binary"), "branches"), True
            continue
        edges.append(_all_blocks(onward).mapInArrow(_compare_nodes, "a long, b long"))
    return edges


def _outlier_blocks(members: DataFrame) -> DataFrame:
    """Members by blocks of their node; an outlier visits all blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    part = F.when(F.col("leader").isNull(), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(_blocks("doc_id", "n", BLOCK)))
    placed = members.select("node", F.explode(part).alias("part"), "doc_id", "sig", F.col("leader").isNull().alias("outlier"))
    return placed.repartition("node", "part").sortWithinPartitions("node", "part")


def _all_blocks(members: DataFrame) -> DataFrame:
    """The exact way for what is still large: every pair of a node's blocks is one part, so that all pairs of members meet."""
    placed = members.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("block", _blocks("doc_id", "n", BLOCK))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(F.col("block"), o) * F.col("parts") + F.greatest(F.col("block"), o))
    return placed.select("node", F.explode(pairs).alias("part"), "doc_id", "sig").repartition("node", "part").sortWithinPartitions("node", "part")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs by matrix products over the shingles that at least two sets hold."""
    n = len(sets)
    total = np.zeros((n, n), np.float64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.r_[True, values[1:] != values[:-1]]
    row = np.cumsum(starts) - 1
    shared = np.bincount(row)[row] > 1
    row, owner = row[shared], owner[shared]
    if not len(row):
        return total
    row = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1
    step = 4096
    for lo in range(0, int(row[-1]) + 1, step):
        part = slice(*np.searchsorted(row, [lo, lo + step]))
        held = np.zeros((step, n), np.float32)
        held[row[part] - lo, owner[part]] = 1
        total += held.T @ held
    return total


def _links_by(width: int, percent: int):
    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cluster, part, kind, label, doc_id, text), sorted: spanning links of a part. Kind 0 members meet all; kind 1 meet only kind 2."""
        for run in _runs(batches, 2):
            ids, kinds, labels = [r[4] for r in run], np.array([r[2] for r in run]), np.array([r[3] for r in run])
            sets = [shingle_set(r[5], width) for r in run]
            sizes = np.array([len(s) for s in sets])
            both = intersections(sets)
            linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            forest, found = Forest(len(ids)), []
            first: dict[int, int] = {}
            for i, label in enumerate(labels.tolist()):  # what earlier links joined needs no link again
                forest.join(first.setdefault(label, i), i)
            for i in range(len(ids) - 1):
                for j in (np.flatnonzero(linked[i, i + 1 :]) + i + 1).tolist():
                    if (kinds[i] == 0 or kinds[i] != kinds[j]) and forest.join(i, j):
                        found.append((ids[i], ids[j]))
            if found:
                yield _edges(found)

    return links


def exact_links(docs: DataFrame, candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """candidates(node, component) -> edges that connect each cluster's documents as all their exact links do."""
    compare = _links_by(width, percent)
    sizes = written(candidates.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n")), "sizes")
    members = candidates.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    members = members.join(sizes, "cluster").join(docs.filter("doc_id is not null"), "doc_id")
    members = written(members.select("cluster", "n", "doc_id", "text", F.col("doc_id").alias("label")), "members")
    deal = lambda df: df.select("cluster", "part", "kind", "label", "doc_id", "text").repartition("cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(compare, "a long, b long")

    placed = members.withColumn("part", _blocks("doc_id", "n", BLOCK)).withColumn("kind", F.lit(0))
    big = members.filter(F.col("n") > BLOCK)
    # the members with the smallest hashes of each large cluster visit all its blocks
    cut = F.lit(2.0**63) * (F.lit(2.0 * LEADERS) / F.col("n") - 1)
    leaders = big.filter(F.xxhash64("doc_id", F.lit(11)).cast("double") <= cut)
    visits = leaders.withColumn("home", _blocks("doc_id", "n", BLOCK)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK).cast("long") - 1))).filter("part <> home").withColumn("kind", F.lit(0))
    first = written(deal(placed.select(*members.columns, "part", "kind").union(visits.select(*members.columns, "part", "kind"))), "links")
    if big.isEmpty():
        return first

    joined = components(first, "links-joined")
    big = big.drop("label").join(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    # blocks: a component over one block has its own, all smaller ones of a cluster share theirs
    of_label = big.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    groups = of_label.withColumn("team", F.when(F.col("m") > BLOCK, F.col("label")))
    teams = groups.groupBy("cluster", "team").agg(F.sum("m").alias("m"))
    big = big.join(groups.select("cluster", "label", "team"), ["cluster", "label"])
    big = big.join(teams.select(F.col("cluster").alias("c"), F.col("team").alias("t"), F.col("m").alias("size")), (F.col("cluster") == F.col("c")) & F.col("team").eqNullSafe(F.col("t"))).drop("c", "t")
    big = big.withColumn("block", _blocks("doc_id", "size", BLOCK))
    blocks = teams.select("cluster", "team", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / BLOCK).cast("long") - 1)).alias("block"))
    blocks = blocks.withColumn("key", F.xxhash64("cluster", F.coalesce("team", F.lit(-1)), F.col("team").isNull(), "block"))
    one, two = blocks.select("cluster", *(F.col(c).alias(c + "_1") for c in ("team", "key"))), blocks.select("cluster", *(F.col(c).alias(c + "_2") for c in ("team", "key")))
    pairs = one.join(two, "cluster").filter("key_1 <= key_2 and not (team_1 <=> team_2 and team_1 is not null)")
    part = F.xxhash64("key_1", "key_2").alias("part")
    alone = (F.col("key_1") == F.col("key_2"))
    sides = pairs.select("cluster", F.col("key_1").alias("key"), part, F.when(alone, 0).otherwise(1).alias("kind")).union(pairs.filter(~alone).select("cluster", F.col("key_2").alias("key"), part, F.lit(2).alias("kind")))
    big = big.withColumn("key", F.xxhash64("cluster", F.coalesce("team", F.lit(-1)), F.col("team").isNull(), "block"))
    second = deal(big.join(sides, ["cluster", "key"]).select("cluster", "part", "kind", "label", "doc_id", "text"))
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(written(second, "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of ``percent`` of the union or more), kept (is that document)."""
    docs = texts(docs, id_col, text_col)
    signed = written(signatures(docs, width), "signatures")
    named = signed.filter("doc_id is not null and set_key is not null")
    firsts = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
    reps = written(firsts.select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.sig").alias("sig")), "reps")
    classes = reps.select("set_key", "rep")
    edges = candidate_edges(reps.select(F.col("rep").alias("doc_id"), "sig"))
    resembling = edges[0]
    for more in edges[1:]:
        resembling = resembling.union(more)
    links = exact_links(docs, written(components(resembling, "resembling"), "clusters"), width, percent)
    # rows of one id with different texts join their sets: the id is one document
    several = named.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("lo"), F.max(F.xxhash64("set_key")).alias("hi")).filter("lo <> hi")
    same_id = named.join(several, "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(same_id), "linked")
    by_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    answered = signed.join(by_class, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return answered.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
