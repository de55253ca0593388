"""Mixing, the conversation trie and hard negatives against plain versions: nulls, ties, repeated rows, hot groups, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversations, mixing, negatives

CLASH = ("key", "part", "u", "size", "position", "target", "__row_of_caller", "bucket", "dim", "slot", "anchor", "lane", "depth", "fa", "band", "h1", "pos")


def clashing(df):
    return df.select("*", *(F.lit(f"{c} of the caller").alias(c) for c in CLASH if c not in df.columns))


# --- mixing


def fill(sizes, weights, share, epochs):
    """Targets by clamping the source with the least room again and again."""
    targets, left, free = {}, Fraction(share, 100) * sum(sizes.values()), dict(weights)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if epochs * sizes[s] <= level * free[s]]
        if not over:
            return targets | {s: level * w for s, w in free.items()}
        for s in over:
            targets[s] = Fraction(epochs * sizes[s])
            left -= targets[s]
            del free[s]
    return targets


def mix_rows():
    draw = random.Random(3)
    rows = [(i, " ".join("w" * draw.randint(1, 9) for _ in range(draw.randint(0, 40))), draw.choice(["a", "a", "a", "b", "", "Ä", "z9"])) for i in range(400)]
    rows += [(i, " ".join("x" * 3 for _ in range(30)), None) for i in range(400, 420)] + [(7000, "one \t two\n", "tiny"), (7001, None, "void"), (7002, " \n", "void"), (None, None, None), (None, "no id", "a")]
    rows += [(8000, "word " * 50_000, "b")] + [(8001, "same text of six words here", "copies")] * 60
    return rows


@pytest.mark.parametrize(("weights", "share", "epochs"), [((5, 2, 1), 150, 2), ((1,), 100, 1), ((9, 1), 250, 3), ((1, 0), 120, 2)])
def test_mix_reaches_the_targets_of_water_filling(spark, weights, share, epochs):
    rows = mix_rows()
    got = mixing.mix(clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")).repartition(7), weights, share, epochs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), size(t)) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    named = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    want = fill(sizes, {s: weights[i % len(weights)] for i, s in enumerate(named)}, share, epochs)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        whole = int(want[r.source] / sizes[r.source]) * r.size if sizes[r.source] else 0
        assert whole <= r.taken <= min(whole + r.size, epochs * r.size)
    # rows of one digest share what is left in equal parts, so up to a word a row may be missing
    assert all(abs(taken[s] - want[s]) <= (60 if s == "copies" else 1) for s in sizes), (taken, want)


def test_mix_is_seeded_and_independent_of_partitions(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    row = lambda d, **k: sorted(map(str, mixing.mix(d, **k).collect()))
    assert row(df.repartition(1)) == row(df.repartition(9, "text")) != row(df, seed=12)


def test_mix_by_salted_join_and_of_nothing(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(df).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, mixing.mix(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert mixing.mix(df.limit(0)).collect() == [] == mixing.sample(df.limit(0)).collect()


def test_sample_holds_the_words_that_mix_counts(spark):
    df = clashing(spark.createDataFrame(mix_rows(), "doc_id long, text string, source string"))
    sampled = mixing.sample(df)
    assert sampled.columns == [*df.columns, "copy"]
    words, texts = defaultdict(int), {(i, s): t for i, t, s in mix_rows()}
    for r in sampled.collect():
        words[r.doc_id, r.source] += len(r.text.split())
        assert texts[r.doc_id, r.source].startswith(r.text)
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source] += r.taken
    assert words == {k: v for k, v in want.items() if v}


# --- conversation trie


def trie(rows, base, head):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [y[2:] for y in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        seq = own.get(base(c), [])[: head(c)] + turns[head(c) :]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append((c, len(seq) == d))
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, e in members if e)))
        up = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in members), len(p), up, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk():
    draw = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(draw.randint(1, 9)):
            rows.append((c, t + 3, draw.choice(["user", "bot"]), draw.choice(["a", "b", "Ä ß", ""])))
    rows += [(100 + i, t, "user", "same" * (t + 1)) for i in range(40) for t in range(4)]  # many copies
    rows += [(1_000_007, t, None, None) for t in range(1, 4)] + [(1_000_008, None, "user", "first"), (1_000_008, 0, "bot", None), (None, 1, "user", "no conversation"), (1_000_009, 5, "u", "x")]
    rows += [(200, t, "user", f"turn {t % 7}") for t in range(700)] + [(201, t, "user", f"turn {t % 7}") for t in range(700)]  # long copies
    rows += [(-4, 1, "user", "below zero"), (-5, 1, "user", "below zero"), (300, 2, "u", "twice"), (300, 2, "u", "twice")]
    return rows


def nodes_of(spark, rows, parts=4):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(parts)
    found = conversations.prefix_trie(df, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string")) % 9, 8).collect()
    return found, sorted((tuple(r)[:8] for r in found), key=str)


def base5(c):
    return c - int(math.fmod(c, 5))


def test_trie_equals_the_rebuilt_conversations(spark):
    rows = talk()
    found, got = nodes_of(spark, rows)
    assert got == trie(rows, base5, lambda c: zlib.crc32(str(c).encode()) % 9)
    # the stored reference is a turn of the smallest member or of its base
    assert all((r.turn_conv is None) == (r.depth == 0) and r.turn_conv in (None, r.conv_id, base5(r.conv_id)) for r in found)


class Weak(random.Random):
    """Gives 1 as the first constants: a fingerprint is then a plain sum, the same for turns in any order."""

    def __init__(self, attempt):
        super().__init__(attempt)
        self.attempt = attempt

    def randrange(self, *bounds):
        return super().randrange(*bounds) if self.attempt else 1


def test_trie_repeats_when_prefixes_share_a_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(conversations.random, "Random", Weak)
    monkeypatch.setattr(conversations, "BAND", 3)
    tried, groups = [], conversations._groups
    monkeypatch.setattr(conversations, "_groups", lambda rows: tried.append(1) or groups(rows))
    rows = [r for r in talk() if r[0] is not None and r[0] < 40] + [(7, t + 20, "user", x) for t, x in enumerate("pqpqq")] + [(7005, t, "user", x) for t, x in enumerate("stst")] + [(7006, t, "user", x) for t, x in enumerate("tsst" * 4)]
    rows += [(8000, 0, "u", "x"), (8000, 1, "u", "y"), (8005, 0, "u", "y"), (8005, 1, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.prefix_trie(df, lambda c: c, lambda c: c * 0, 1).collect()
    assert sorted((tuple(r)[:8] for r in found), key=str) == trie(rows, lambda c: c, lambda c: 0)
    assert len(tried) == 2


def test_trie_of_nothing(spark):
    assert nodes_of(spark, [])[1] == [] == nodes_of(spark, [(None, 1, "a", "b")])[1]


# --- hard negatives


def plain_negatives(rows, every=100, k=5, low=80):
    good = [(j, i, label, [math.floor(Fraction(256) * Fraction(x)) for x in v]) for j, (i, v, label) in enumerate(rows)
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for j, i, label, v in good:
        if i % every:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), negatives.LONG[0]), negatives.LONG[1]), n, m, other) for m, n, other, w in good if m != j and len(w) == len(v))
        for s, n, *_ in [x for x in scored if x[3] == label][:k]:
            fit = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, n, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fit)]
    return sorted(out)


def vectors(wide=False):
    draw = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(0, 0.2, 6)], int(draw.integers(0, 3))) for i in range(700)]
    rows += [(1000, [0.1] * 6, 1), (1000, [0.1] * 6, 1), (1001, [0.1] * 6, 1), (1002, [0.1] * 6, 2), (1003, [0.1] * 6, 2)]  # ties, a repeated anchor
    rows += [(1100, [], 1), (1101, [], 1), (1102, [], 2), (1200, [0.5], 1), (1201, [0.4], 1), (1202, [0.3], 0)]  # other lengths
    rows += [(1300, None, 1), (1301, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (1302, [math.nan] * 6, 1), (1303, [math.inf] * 6, 2), (None, [0.1] * 6, 1), (1400, [0.1] * 6, None)]
    if wide:
        rows += [(1500, [1e9, -3e15, 7.0, 0.0, 1.5e20, 2.0], 0), (1501, [2e9, -1e15, 7.5, 0.0, 1e3, 2.0], 0), (1502, [1.9e9, -1e15, 7.0, 0.0, 1.0, 2.0], 1)]
    return rows


@pytest.mark.parametrize("wide", [False, True])
def test_negatives_equal_brute_force(spark, wide):
    rows = vectors(wide)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == plain_negatives(rows)


def test_negatives_lane_by_lane(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "BLOCK", 50)
    monkeypatch.setattr(negatives, "FIELDS", 16)
    monkeypatch.setattr(negatives, "HELD", 2)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").repartition(3)
        assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == plain_negatives(vectors())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert negatives.hard_negatives(df.limit(0)).collect() == []


@pytest.mark.parametrize("scale", [1, 1 << 14, 1 << 40])
def test_packed_products_are_exact(scale):
    draw = np.random.default_rng(1)
    block = draw.integers(-150, 150, (2500, 7)) * scale
    block = block if scale < 1 << 30 else block.astype(object)
    anchors = draw.integers(-90, 200, (5, 7)).tolist()
    packed = negatives.Candidates(block, 90, 290)
    for a in anchors:
        want = [min(max(sum(int(x) * y for x, y in zip(row, a)), negatives.LONG[0]), negatives.LONG[1]) for row in block.tolist()]
        assert packed.scores(a).tolist() == want
