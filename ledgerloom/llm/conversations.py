"""The prefix trie of rebuilt conversations through composable fingerprints.

Every conversation is rebuilt as the head of a base conversation and its own turns behind that head. The rebuilt turns are never written out:
a sequence of turns has the fingerprint ``sum of term(turn) * B^position`` in three lanes modulo a prime, sequences combine by
``(n1, f1) * (n2, f2) = (n1 + n2, f1 + B^n1 * f2)``, and so the fingerprint of every rebuilt prefix comes from the running sum of the base at
the end of its head and from differences of the conversation's own running sum, moved by ``B^-(missing turns)``. Equal prefixes are a group of
(depth, fingerprint).

Equality is verified, not assumed. Each rebuilt row refers to the turn it ends with (conversation, position) and carries that turn's content
hash; the hash is held against the texts themselves (no hash of two contents), and a group must have one content hash and one parent group,
which gives equal sequences by induction over the depth. If a check fails the whole is done again with other constants.

Subtree sums need no walk over levels: a node is represented by its smallest member, whose rows from some depth on are the nodes it
represents, so that a suffix sum over each conversation's own rows, added up by node, is the sum over the subtree. All work is linear in the
number of rebuilt turns.

Hot groups. Turns are ranged by (conversation, turn), so that a conversation with a third of all turns is spread over its parts; at most one
conversation a part continues from the part before, which bounds the carried rows by the number of parts. Depths are cut into bands for the
suffix sums. Children meet their parent through (parent, salt) pairs. A digest of ids in order is sequential by its nature: ids are joined into
chunks before one task per node streams them through SHA-256, holding one batch at a time.

Cases. Rows without a conversation id take no part; a null role or text is empty; null turns come first; rows of one turn are ordered by a hash
of role and text, equal rows all count; a conversation whose base is absent keeps only its turns after its head, and may have none (a member
of the root alone); an empty table has no root. Columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

#: The prime of the lanes; products of two values below it fit a long.
PRIME = (1 << 31) - 1
LANES = 3
#: Depths in one band of the suffix sums, parts over which the children of a node are dealt.
BAND, SALTS = 1 << 16, 64
NODE = ["depth", "fa", "fb"]


def _power(base: int, exponent: Column, digits: int = 4) -> Column:
    """base ** exponent modulo PRIME, by bytes of the exponent (below 256 ** digits)."""
    made = None
    for k in range(digits):
        table = F.expr("array(" + ", ".join(f"{pow(base, j << 8 * k, PRIME)}L" for j in range(256)) + ")")
        step = F.get(table, F.shiftright(exponent, 8 * k).bitwiseAND(255).cast("int"))
        made = step if made is None else made * step % PRIME
    return made


def _turns(conversations: DataFrame, attempt: int, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, h1, h2: turns with the two halves of their content hash."""
    own = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.filter("conv_id is not null").select("*", *(F.xxhash64(F.lit(2 * attempt + i), "role", "text").alias(f"h{i}") for i in (1, 2)))


def _placed(turns: DataFrame, bases: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, part, pos, h1, h2, bytes, t1.., f1..: terms and running sums) and the sizes by (conv_id, part)."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2"]
    rows = written(turns.select("conv_id", "turn", "h1", "h2", F.octet_length("text").cast("long").alias("bytes")).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "trie-turns")
    sizes = written(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "trie-sizes")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # at most one conversation a part began in an earlier one
    carried = F.broadcast(sizes.withColumn("offset", F.sum("n").over(before)).filter("offset is not null").select("conv_id", "part", "offset"))
    local = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:])).cast("long") - 1
    numbered = rows.withColumn("pos", local).join(carried, ["conv_id", "part"], "left").withColumn("pos", F.col("pos") + F.coalesce("offset", F.lit(0)))
    contents = [F.col("h1"), F.col("h2"), F.xxhash64("h1", "h2", F.lit(3))]
    terms = {f"t{k}": (F.pmod(h, F.lit(PRIME - 1)) + 1) % PRIME * _power(b, F.col("pos")) % PRIME for k, (h, b) in enumerate(zip(contents, bases, strict=True))}
    lanes = range(LANES)
    running = W.partitionBy("conv_id", "part").orderBy("pos")
    summed = written(numbered.withColumns(terms).select("conv_id", "part", "pos", "h1", "h2", "bytes", *(f"t{k}" for k in lanes), *(F.sum(f"t{k}").over(running).alias(f"f{k}") for k in lanes)), "trie-sums")
    parts = summed.groupBy("conv_id", "part").agg(*(F.sum(f"t{k}").alias(f"s{k}") for k in lanes))
    prior = parts.select("conv_id", "part", *(F.sum(f"s{k}").over(before).alias(f"c{k}") for k in lanes)).filter("c0 is not null")
    full = summed.join(F.broadcast(prior), ["conv_id", "part"], "left")
    return full.select("conv_id", "part", "pos", "h1", "h2", "bytes", *(f"t{k}" for k in lanes), *(((F.col(f"f{k}") + F.coalesce(f"c{k}", F.lit(0))) % PRIME).alias(f"f{k}") for k in lanes)), sizes


def rebuilt(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], longest: int, attempt: int = 0, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each prefix of each rebuilt conversation, depth 0 included: conv_id, depth, fa, fb (fingerprint), ga, gb (its parent's), h1, h2
    and bytes of the last turn, turn_conv and turn_pos (the turn it refers to), last (the prefix is the whole)."""
    draw = random.Random(attempt)
    bases = [draw.randrange(2, PRIME - 1) for _ in range(LANES)]
    lanes = range(LANES)
    rows, sizes = _placed(_turns(conversations, attempt, conv, turn, role, text), bases)
    first = written(rows.filter(F.col("pos") < longest).drop("part"), "trie-heads")
    lengths = sizes.groupBy("conv_id").agg(F.sum("n").alias("n"))
    named = lengths.select("conv_id", "n", base(F.col("conv_id")).cast("long").alias("base"), head(F.col("conv_id")).cast("long").alias("h"))
    infos = named.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    # the running sums at the end of the base's head and at the end of the own turns that the head replaces
    at_head = first.select(F.col("conv_id").alias("base"), (F.col("pos") + 1).alias("k"), *(F.col(f"f{i}").alias(f"head{i}") for i in lanes))
    at_own = first.select("conv_id", (F.col("pos") + 1).alias("h"), *(F.col(f"f{i}").alias(f"own{i}") for i in lanes))
    infos = written(infos.join(at_head, ["base", "k"], "left").join(at_own, ["conv_id", "h"], "left").fillna(0, [f"{c}{i}" for c in ("head", "own") for i in lanes])
                    .withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-infos")

    def shaped(df: DataFrame, conv_id: str, turn_conv: str) -> DataFrame:
        """From r0.., u0.. (fingerprint and last term) to the packed columns."""
        packed = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
        less = [F.pmod(F.col(f"r{i}") - F.col(f"u{i}"), F.lit(PRIME)) for i in lanes]
        return df.select(F.col(conv_id).alias("conv_id"), "depth", packed(F.col("r0"), F.col("r1")).alias("fa"), F.col("r2").alias("fb"), packed(less[0], less[1]).alias("ga"), less[2].alias("gb"),
                         "h1", "h2", "bytes", F.col(turn_conv).alias("turn_conv"), F.col("pos").alias("turn_pos"), (F.col("depth") == F.col("length")).alias("last"))

    heads = first.withColumnRenamed("conv_id", "base").join(infos.filter("k > 0").select("conv_id", "base", "k", "length"), "base").filter("pos < k")
    heads = heads.withColumns({"depth": F.col("pos") + 1} | {f"r{i}": F.col(f"f{i}") for i in lanes} | {f"u{i}": F.col(f"t{i}") for i in lanes})
    by_part = sizes.select("conv_id", "part").join(infos.filter("n > h").drop("n"), "conv_id")
    own = rows.join(by_part, ["conv_id", "part"]).filter("pos >= h")
    back = [F.get(F.array(*(F.lit(pow(b, -j, PRIME)).cast("long") for j in range(longest + 1))), (F.col("h") - F.col("k")).cast("int")) for b in bases]
    own = own.withColumns({"depth": F.col("k") + F.col("pos") - F.col("h") + 1} | {f"u{i}": F.col(f"t{i}") * back[i] % PRIME for i in lanes}
                          | {f"r{i}": (F.col(f"head{i}") + F.pmod(F.col(f"f{i}") - F.col(f"own{i}"), F.lit(PRIME)) * back[i] % PRIME) % PRIME for i in lanes})
    none = F.lit(0).cast("long")
    roots = infos.select("conv_id", "length", *(none.alias(c) for c in ("depth", "h1", "h2", "bytes", *(f"{c}{i}" for c in "ru" for i in lanes))), F.lit(None).cast("long").alias("turn_conv"), F.lit(None).cast("long").alias("pos"))
    return written(shaped(heads, "conv_id", "base").unionByName(shaped(own, "conv_id", "conv_id")).unionByName(shaped(roots, "conv_id", "turn_conv")), "trie-rows")


def _groups(rows: DataFrame) -> DataFrame:
    """Nodes as groups of (depth, fingerprint), with whether all members agree on the last turn and the parent."""
    one = lambda c: F.min(c) == F.max(c)
    return written(rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.min("ga").alias("ga"), F.min("gb").alias("gb"),
                                           (one("h1") & one("h2") & one("ga") & one("gb")).alias("agreed")), "trie-nodes")


def _chunks(schema: pa.Schema):
    """Arrow step over rows sorted by node and id: the ids of each node in a batch as one text."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.stack([np.asarray(batch.column(c)) for c in NODE])
            ids = np.asarray(batch.column("conv_id"))
            at = np.r_[0, np.flatnonzero((node[:, 1:] != node[:, :-1]).any(axis=0)) + 1, len(ids)]
            made = [*node[:, at[:-1]], ids[at[:-1]], [",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, at[1:])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return join


def _digests(schema: pa.Schema):
    """Arrow step over chunks sorted by node and first id: SHA-256 of a node's ids, streamed."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if row[:3] != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = row[:3], hashlib.sha256(row[3].encode())
                else:
                    state.update(b"," + row[3].encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*key, state.hexdigest()), schema, strict=True)], schema=schema)

    return digest


def _ends(rows: DataFrame) -> DataFrame:
    """Digest of the decimal ids, ascending and joined by commas, of the conversations that end at a node."""
    ends = rows.filter("last").select(*NODE, "conv_id")
    longs = [(c, pa.int64()) for c in NODE]
    chunks = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_chunks(pa.schema([*longs, ("first", pa.int64()), ("ids", pa.string())])), "depth long, fa long, fb long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests(pa.schema([*longs, ("ends", pa.string())])), "depth long, fa long, fb long, ends string")


def _subtrees(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_leaves and saved of each node: what the smallest members give, summed from the end of each conversation and then by node."""
    mine = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    banded = rows.select(*NODE, "conv_id").join(mine, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaf"]).withColumn("band", F.floor(F.col("depth") / BAND))
    sums = banded.groupBy("conv_id", "band").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaf"))
    later = W.partitionBy("conv_id").orderBy(F.col("band").desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select("conv_id", "band", *(F.coalesce(F.sum(f"all_{c}").over(later), F.lit(0)).alias(f"later_{c}") for c in ("saved", "leaf")), "all_saved", "all_leaf").filter("later_saved + later_leaf + all_saved + all_leaf > 0")
    below = W.partitionBy("conv_id", "band").orderBy(F.col("depth").desc())
    suffix = banded.join(carry, ["conv_id", "band"]).select(*NODE, *((F.sum(c).over(below) + F.col(f"later_{c}")).alias(c) for c in ("saved", "leaf")))
    return suffix.filter("saved > 0 or leaf > 0").groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], longest: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes that the subtree
    saves when each of its turns is kept once), ends_sha256, and turn_conv, turn_pos: a stored turn that the node's prefix ends with.

    ``base`` gives the conversation whose first turns are the head, ``head`` how many, at most ``longest``.
    """
    for attempt in count():
        turns = _turns(conversations, attempt, conv, turn, role, text)
        contents = turns.groupBy("h1", "h2", "role", "text").agg(F.lit(1).alias("one")).groupBy("h1", "h2").count()
        if not contents.filter("count > 1").isEmpty():
            continue
        rows = rebuilt(conversations, base, head, longest, attempt, conv, turn, role, text)
        groups = _groups(rows)
        if groups.filter("not agreed").isEmpty():
            break
    parents = F.col("depth") - 1
    kids = groups.filter("depth > 0").groupBy(parents.alias("depth"), F.col("ga").alias("fa"), F.col("gb").alias("fb")).agg(F.count("*").alias("n_children"))
    nodes = written(groups.drop("agreed").join(kids, NODE, "left").fillna(0, ["n_children"]), "trie-children")
    refs = rows.select("conv_id", "depth", "turn_conv", "turn_pos")
    # children meet their parent through the (parent, salt) pairs that there are
    child = nodes.filter("depth > 0").select("conv_id", "depth", parents.alias("up"), "ga", "gb", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt"))
    up = nodes.select(F.col("depth").alias("up"), F.col("fa").alias("ga"), F.col("fb").alias("gb"), F.col("conv_id").alias("parent_conv_id"))
    pairs = child.groupBy("up", "ga", "gb", "salt").agg(F.lit(1).alias("one")).drop("one").join(up, ["up", "ga", "gb"])
    named = child.join(pairs, ["up", "ga", "gb", "salt"]).select("conv_id", "depth", "parent_conv_id")
    whole = nodes.join(_subtrees(rows, nodes), NODE, "left").join(_ends(rows), NODE, "left").join(named, ["conv_id", "depth"], "left").join(refs, ["conv_id", "depth"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
                        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "turn_conv", "turn_pos")
