"""Language-model scores from a log-bilinear model trained in numpy by noise-contrastive estimation.

Counts. Every token of every training document is counted in Spark. The most frequent tokens go to the workers as a table of ``FREQUENT``
entries at most; the others of a document meet the counts in a shuffle join, so no vocabulary needs to fit anywhere.

Model. Two preceding tokens predict a vector, the sum of their vectors weighted by place; its products with the vectors of the ``CLASSES``
most frequent tokens, the end, and the class of the other tokens, plus a bias, are the scores. Every other token has a cell, named by three
digits: the group and part of its ending and a place in the part. A token of the table has a cell of its own; all further tokens, unseen ones too,
are dealt by their ending and hash to further cells. Digits have vectors as contexts and as targets: after the class the vector predicts digit by digit,
each weighed by the counts below it, and within a hashed cell a token has its smoothed share. So every token is predicted from its
context and predicts, whatever the vocabulary. Training passes once over all training documents in ``ROUNDS`` parts: each task descends on its own
documents from the common start, and the mean of the tasks, weighted by tokens and merged in a tree, is the next start. Scoring normalises
over all classes and over all digits of a level; the probabilities of all tokens, one unseen type in each hashed cell included, sum to 1.

Null counts as empty: the end alone. Null ids never train. Repeated rows count and are scored each. Without training rows the counts are 0.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch_of, fold, slices, texts, written

END = " "  # no word holds a blank
FREQUENT, CLASSES, WIDTH = 131_072, 512, 16
NOISE, FLATTEN, BATCH, RATE, SPREAD, ROUNDS, FAN = 48, 0.6, 4096, 0.1, 0.5, 2, 16
SIDE, HASHED, NOISE_DIGITS = 64, 32, 12  # groups, parts of a group; hashed cells of a part; noise digits of a level


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column, ""))))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # a text without words gives one empty word
    return (flat, sizes) if filled.all() else (flat.filter(pa.array(filled)), np.add.reduceat(filled.astype(np.int64), starts))


def token_totals(docs: DataFrame) -> DataFrame:
    """token, c: counts over all rows, summed by slices and in the tasks before they are shuffled."""
    schema = pa.schema([("token", pa.string()), ("c", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            counts = split(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], schema=schema)
            yield batch_of(schema, [END], [batch.num_rows])

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent tokens with their counts, the classes among them, and the totals."""

    rank: dict[bytes, int]
    count: np.ndarray
    classes: int
    n: int
    v: int

    @property
    def other(self) -> int:
        return self.classes

    def shares(self) -> np.ndarray:
        """Share of each class, the other class last, each at least a little."""
        c = np.r_[self.count[: self.classes], max(self.n - int(self.count[: self.classes].sum()), 0)].astype(float) + 1
        return c / c.sum()

    def other_log(self) -> float:
        """log10 of what the other class divides by."""
        own = self.count[: self.classes]
        return math.log10(max(self.n - int(own.sum()), 0) + max(self.v - int((own > 0).sum()), 0) + 1)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))


@dataclass
class Tokens:
    """The tokens of several texts: ranks, cells, the places after each text; the distinct tokens outside the table and where each stands."""

    ranks: np.ndarray
    cell: np.ndarray
    ends: np.ndarray
    rare: pa.Array
    rare_at: np.ndarray
    rare_code: np.ndarray


def tokens(column: pa.Array, voc: Vocabulary, layout: Cells) -> Tokens:
    """Each distinct token is looked up once."""
    flat, sizes = split(column)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    coded = flat.dictionary_encode()
    ranks = voc.ranks(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
    cells, outside = layout.of_rank[ranks], ranks < 0
    rare = coded.dictionary.filter(pa.array(outside))
    cells[outside] = layout.hashed_cells(rare)
    code = np.full(len(inside), len(ranks))
    code[inside] = coded.indices.to_numpy(zero_copy_only=False)
    end = voc.rank[END.encode()]
    ranks, cells = np.r_[ranks, end], np.r_[cells, layout.of_rank[end]]
    rare_at = np.flatnonzero(ranks[code] < 0)
    return Tokens(ranks[code], cells[code], ends, rare, rare_at, (np.cumsum(outside) - 1)[code[rare_at]])


def vocabulary(totals: DataFrame) -> Vocabulary:
    """Totals, and the tokens of the highest counts: as many bands of counts as hold FREQUENT tokens at most."""
    n, v = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    band = F.floor(F.log2("c") * 64)
    held, least = 0, None
    for r in sorted(totals.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["band"]):
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["band"]
    most = totals.filter(band >= least) if least is not None else totals.limit(0)
    top = sorted(((r["token"], r["c"]) for r in most.filter(F.col("token") != END).collect()), key=lambda x: (-x[1], x[0]))
    end = totals.filter(F.col("token") == END).first()
    top.insert(0, (END, end["c"] if end else 0))
    return Vocabulary({w.encode(): i for i, (w, _) in enumerate(top)}, np.array([c for _, c in top], np.int64), min(CLASSES + 1, len(top)), int(n), int(v))


def _endings(words: list[bytes]) -> np.ndarray:
    """The last eight bytes of each word as a number, the last byte first."""
    return np.frombuffer(b"".join([w[-8:].rjust(8, b"\0") for w in words]), "<u8")


class Cells:
    """A cell (group, part, place) for every token outside the classes, and the counts by cell.

    Tokens of the table are ordered by their endings and cut into parts of even size; each is alone in its cell. Other tokens stand in the
    part of their ending, in one of ``hashed`` more cells.
    """

    def __init__(self, voc: Vocabulary):
        own = sorted(w[::-1] for w, i in voc.rank.items() if i >= voc.classes)
        self.side = min(SIDE, max(1, round(len(own) ** (1 / 3))))
        parts = self.side * self.side
        starts = [-(-b * len(own) // parts) for b in range(parts + 1)]
        self.bounds = [own[i] for i in starts[1:-1]]
        self.own = max((b - a for a, b in zip(starts, starts[1:])), default=0)
        self.hashed = min(HASHED, max(1, -(-(voc.v - len(voc.rank)) // parts)))
        self.places = self.own + self.hashed
        self.of_rank = np.full(len(voc.count) + 1, -1, np.int64)  # the last for tokens outside the table
        self.mass = np.zeros(parts * self.places)
        for part, (a, b) in enumerate(zip(starts, starts[1:])):
            for place, w in enumerate(sorted(x[::-1] for x in own[a:b])):
                self.of_rank[voc.rank[w]] = part * self.places + place
        self.mass[self.of_rank[self.of_rank >= 0]] = voc.count[self.of_rank[:-1] >= 0] + 1

    @property
    def sizes(self) -> tuple[int, int, int]:
        return self.side, self.side, self.places

    def hashed_cell(self, word: bytes) -> int:
        return bisect_right(self.bounds, word[::-1]) * self.places + self.own + zlib.crc32(word) % self.hashed

    def hashed_cells(self, words: pa.Array) -> np.ndarray:
        """``hashed_cell`` of each word; the last eight bytes find the part unless a bound ends with them too."""
        if not len(words):
            return np.zeros(0, np.int64)
        listed = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found, bounds = _endings(listed), _endings([x[::-1] for x in self.bounds])
        part = np.searchsorted(bounds, found, side="right")
        for i in np.flatnonzero(part != np.searchsorted(bounds, found)).tolist():
            part[i] = bisect_right(self.bounds, listed[i][::-1])
        return part * self.places + self.own + np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % self.hashed

    def of(self, words: list[bytes], ranks: np.ndarray) -> np.ndarray:
        """The cells of tokens, -1 for tokens with a class."""
        cells = self.of_rank[ranks]
        for i in np.flatnonzero(ranks < 0).tolist():
            cells[i] = self.hashed_cell(words[i])
        return cells

    def digits(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = cells // self.places
        return part // self.side, part % self.side, cells % self.places

    def weigh(self, mass: dict[int, int]) -> Cells:
        """Add the counts of the tokens outside the table, and one unseen type to each hashed cell; then the shares of digits."""
        for cell, m in mass.items():
            self.mass[cell] += m
        cube = self.mass.reshape(self.sizes)
        cube[:, :, self.own :] += 1
        self.mass_log = np.log10(np.maximum(self.mass, 1))
        part = cube.sum(axis=2)
        with np.errstate(divide="ignore"):
            self.log_shares = [np.log(x).astype(np.float32) for x in (
                (part.sum(axis=1) / part.sum())[None], part / part.sum(axis=1, keepdims=True), (cube / part[:, :, None]).reshape(-1, self.places))]
        self.flat = []
        for axes in ((1, 2), (0, 2), (0, 1)):
            x = (cube.sum(axis=axes) + 1) ** FLATTEN
            self.flat.append(x / x.sum())
        self.flat_log = [np.log(x).astype(np.float32) for x in self.flat]
        return self

    def above(self, digits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each level the rows of ``log_shares`` that hold its digits."""
        return np.zeros_like(digits[0]), digits[0], digits[0] * self.side + digits[1]


def cells(totals: DataFrame, voc: Vocabulary) -> Cells:
    """The cells with the counts of all tokens; what the tasks gather has at most one row for each hashed cell."""
    found = Cells(voc)
    shared = totals.sparkSession.sparkContext.broadcast((voc.rank, found))
    schema = pa.schema([("cell", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, layout = shared.value
        mass: Counter = Counter()
        for batch in slices(batches, 4096):
            for token, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                word = token.encode()
                if word not in rank:
                    mass[layout.hashed_cell(word)] += c + 1
        yield batch_of(schema, list(mass), list(mass.values()))

    rows = totals.select("token", "c").mapInArrow(run, "cell long, m long").groupBy("cell").agg(F.sum("m").alias("m")).collect()
    return found.weigh({r["cell"]: r["m"] for r in rows})


class Net:
    """Vectors of targets r and contexts q, place weights, bias. Context class ``start`` stands before a text.

    With ``sizes``, the numbers of digits of each level, also vectors and biases of digits as targets, and vectors of groups, parts and places as contexts.
    """

    def __init__(self, classes: int, sizes: tuple[int, int, int] | None = None):
        draw = np.random.default_rng(0)
        self.start = classes + 1
        self.r = draw.normal(0, SPREAD, (classes + 1, WIDTH)).astype(np.float32)
        self.q = draw.normal(0, SPREAD, (classes + 2, WIDTH)).astype(np.float32)
        self.place = np.ones((2, WIDTH), np.float32)
        self.bias = np.zeros(classes + 1, np.float32)
        self.names = ["r", "q", "place", "bias"]
        if sizes:
            for k, n in enumerate(sizes):
                setattr(self, f"r{k}", np.zeros((n, WIDTH), np.float32))
                setattr(self, f"bias{k}", np.zeros(n, np.float32))
            for k, n in enumerate((sizes[0], sizes[0] * sizes[1], sizes[2])):
                setattr(self, f"q{k}", np.zeros((n, WIDTH), np.float32))
            self.names += [f"{x}{k}" for x in ("r", "bias", "q") for k in range(3)]

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in self.names]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()]).astype(np.float64)

    def load(self, x: np.ndarray) -> Net:
        at = 0
        for name in self.names:
            old = getattr(self, name)
            setattr(self, name, x[at : at + old.size].astype(np.float32).reshape(old.shape))
            at += old.size
        return self

    def heads(self) -> np.ndarray:
        """Vectors of the context classes, then of the parts: those of the other class, the group and the part."""
        if not hasattr(self, "q1"):
            return self.q
        side = len(self.q0)
        return np.concatenate([self.q, (self.q1.reshape(side, -1, WIDTH) + (self.q0 + self.q[self.start - 1])[:, None]).reshape(-1, WIDTH)])

    def tails(self) -> np.ndarray:
        """Vectors of the places, after none for the classes; with that of its head it is the vector of a context."""
        none = np.zeros((1, WIDTH), np.float32)
        return np.concatenate([none, self.q2]) if hasattr(self, "q2") else none

    def codes(self, before: np.ndarray, cell: np.ndarray, layout: Cells) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``heads`` and ``tails``."""
        inner = cell >= 0
        return np.where(inner, len(self.q) + cell // layout.places, before), np.where(inner, 1 + cell % layout.places, 0)

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """After two classes."""
        return self.q.take(one, axis=0) * self.place[0] + self.q.take(two, axis=0) * self.place[1]


class Inner:
    """The places of a batch whose token has a cell, and its digits."""

    def __init__(self, cell: np.ndarray, layout: Cells):
        self.at = np.flatnonzero(cell >= 0)
        self.cell = cell[self.at]
        self.digits = layout.digits(self.cell)
        self.above = layout.above(self.digits)


class Room:
    """Arrays kept from step to step, by name: fresh ones of this size would cost more than the sums in them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, width: int = WIDTH) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < rows:
            self.held[name] = np.empty((rows, width), np.float32)
        return self.held[name][:rows]

    def rows(self, name: str, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return x.take(at, axis=0, out=self(name, len(at)), mode="clip")


def _gathered(at: np.ndarray, values: np.ndarray, size: int, room: Room) -> np.ndarray:
    """The sums of the rows of each index below ``size``; the rows stand for further indices again."""
    sums = np.zeros((size, WIDTH), np.float32)
    if len(at):
        order = np.argsort(at.astype(np.int16) if size < 1 << 15 else at, kind="stable")
        sorted_at = at.take(order)
        first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
        # in pairs of columns, which are added at once
        sums.view(np.complex64)[sorted_at.take(first)] = np.add.reduceat(room.rows("sorted", values, order if len(at) == len(values) else order % len(values)).view(np.complex64), first, axis=0)
    return sums


def _contrast(p: np.ndarray, r: np.ndarray, bias: np.ndarray, told: list[np.ndarray], drawn: np.ndarray, known_told: list[np.ndarray], known_drawn: np.ndarray | None,
              g_p: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of r and the bias; that of p is written to ``g_p``. Each example against its targets and the drawn noise targets.

    ``p`` has a last column of ones; ``known`` is added to the scores.
    """
    wrong, bare = r.take(drawn, axis=0), p[:, :-1]
    against = -np.c_[wrong, bias.take(drawn)].T
    noise_sums, n = np.zeros((len(drawn), WIDTH + 1), np.float32), len(p)
    with np.errstate(over="ignore"):  # a power too large to hold stands for a chance of nothing
        for i in range(0, n, 512):
            x = p[i : i + 512]
            down = np.matmul(x, against, out=room(f"down{len(drawn)}", len(x), len(drawn)))
            if known_drawn is not None:
                down -= known_drawn[i : i + 512]
            np.exp(down, out=down)
            down += 1
            np.reciprocal(down, out=down)
            np.matmul(down, wrong, out=g_p[i : i + 512])
            noise_sums += down.T @ x
        values, ups = room("values", n * len(told)), []
        for k, target in enumerate(told):
            right, value = room.rows("right", r, target), values[k * n : (k + 1) * n]
            up = -1 / (1 + np.exp(np.einsum("ij,ij->i", bare, right) + bias.take(target) + known_told[k]))
            right *= up[:, None]
            g_p += right
            np.multiply(bare, up[:, None], out=value)
            ups.append(up)
    at = np.concatenate(told)
    g_r = _gathered(at, values, len(r), room)
    np.add.at(g_r, drawn, noise_sums[:, :-1])
    return g_r, np.bincount(at, np.concatenate(ups), len(r)) + np.bincount(drawn, noise_sums[:, -1], len(r))


def descend(net: Net, squares: list[np.ndarray], noise_log: np.ndarray, drawn: np.ndarray, word: np.ndarray, one: np.ndarray, two: np.ndarray,
            layout: Cells | None = None, drawn_digits: list[np.ndarray] | None = None, cells_of: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
            room: Room | None = None) -> None:
    """One step on a batch: each example against its token and the drawn noise tokens; steps shrink with the sum of squares."""
    room, n, codes = room or Room(), len(word), [(one, None), (two, None)]
    if layout:
        codes = [net.codes(x, cell, layout) for x, cell in zip((one, two), cells_of[1:], strict=True)]
    heads, tails = net.heads(), net.tails()
    total, g_p = None, room("g_p", n)
    for k, (head, tail) in enumerate(codes):
        for name, table, code in (("heads", heads, head), ("tails", tails, tail)):
            if code is not None:
                rows = room.rows(name if total is not None else "sum", table * net.place[k], code)
                total = rows if total is None else np.add(total, rows, out=total)
    p = room("p", n, WIDTH + 1)
    p[:, :-1] = total
    p[:, -1] = 1
    g_r, g_b = _contrast(p, net.r, net.bias - np.float32(math.log(len(drawn))) - noise_log, [word], drawn, [np.float32(0)], None, g_p, room)
    g_digits, g_biases = [], []
    if layout:
        inner = Inner(cells_of[0], layout)
        starts = np.cumsum([0, *layout.sizes])
        targets = np.concatenate([net.r0, net.r1, net.r2])
        bias = np.concatenate([getattr(net, f"bias{k}") - layout.flat_log[k] - np.float32(math.log(len(drawn_digits[k]))) for k in range(3)])
        known_told, known_drawn = [], []
        for k in range(3):
            known, row = layout.log_shares[k].ravel(), inner.above[k] * layout.sizes[k]
            known_told.append(known.take(row + inner.digits[k]))
            known_drawn.append(known.take(row[:, None] + drawn_digits[k]))
        p_in = p.take(inner.at, axis=0, out=room("p_in", len(inner.at), WIDTH + 1), mode="clip")
        g_in = room("g_in", len(inner.at))
        g_target, g_bias = _contrast(p_in, targets, bias, [x + a for x, a in zip(inner.digits, starts[:-1], strict=True)],
                                     np.concatenate([x + a for x, a in zip(drawn_digits, starts[:-1], strict=True)]), known_told, np.concatenate(known_drawn, axis=1), g_in, room)
        g_digits, g_biases = np.split(g_target, starts[1:-1]), np.split(g_bias, starts[1:-1])
        g_p[inner.at] += g_in
    by_head = _gathered(np.r_[codes[0][0], codes[1][0] + len(heads)], g_p, 2 * len(heads), room).reshape(2, -1, WIDTH)
    g_heads = by_head[0] * net.place[0] + by_head[1] * net.place[1]
    g_c = np.einsum("kij,ij->kj", by_head, heads)
    steps = [g_r, g_heads[: len(net.q)], g_c, g_b, *g_digits, *g_biases]
    if layout:
        by_tail = _gathered(np.r_[codes[0][1], codes[1][1] + len(tails)], g_p, 2 * len(tails), room).reshape(2, -1, WIDTH)
        g_c += np.einsum("kij,ij->kj", by_tail, tails)
        g_parts = g_heads[len(net.q) :]
        g_groups = g_parts.reshape(layout.side, -1, WIDTH).sum(axis=1)
        steps[1][net.start - 1] += g_groups.sum(axis=0)
        steps += [g_groups, g_parts, (by_tail[0] * net.place[0] + by_tail[1] * net.place[1])[1:]]
    for x, s, g in zip(net.arrays(), squares, steps, strict=True):  # rows without a gradient stay
        s += g * g
        x -= (RATE * g / np.sqrt(s + 1e-8)).astype(np.float32)


def contexts(ranks: np.ndarray, ends: np.ndarray, voc: Vocabulary, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, class before, class before that, of the tokens of several texts; ``ends`` are the places after each text."""
    word = np.where((ranks >= 0) & (ranks < voc.classes), ranks, voc.other)
    return word, *_before(word, ends, start)


def _before(x: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The values one and two places before in the same text, ``start`` where there are none."""
    one, two = np.r_[start, x[:-1]], np.r_[start, start, x[:-2]][: len(x)]
    first = np.r_[0, ends[:-1]]
    one[first] = start
    two[first] = start
    second = first + 1
    two[second[second < len(x)]] = start
    return one, two


def _merged(parts: Iterable[tuple[float, np.ndarray]]) -> tuple[float, np.ndarray] | None:
    total, mean = 0.0, None
    for weight, x in parts:
        total += weight
        mean = x * weight if mean is None else mean + x * weight
    return (total, mean / total) if total else None


def train(docs: DataFrame, voc: Vocabulary, layout: Cells) -> Net:
    """The model after one pass over the training documents."""
    net = Net(voc.classes, layout.sizes)
    shares = voc.shares()
    net.bias = np.log(shares).astype(np.float32)
    flat = shares**FLATTEN / (shares**FLATTEN).sum()  # noise tokens: rarer classes come up more often than in texts
    noise_log = np.log(flat).astype(np.float32)
    kind = pa.schema([("weight", pa.float64()), ("x", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast((voc, layout))

    def fit_from(start: np.ndarray):
        def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voc, layout = shared.value
            own = Net(voc.classes, layout.sizes).load(start)
            squares = [np.full(a.shape, 1.0, np.float32) for a in own.arrays()]
            draw, seen, waiting, held, room = np.random.default_rng(1), 0, [], 0, Room()
            cumulated = [np.cumsum(x) for x in (flat, *layout.flat)]

            def drawn(level: int, n: int) -> np.ndarray:  # one from each equal part
                return np.minimum(np.searchsorted(cumulated[level], (draw.random() + np.arange(n)) / n), len(cumulated[level]) - 1)

            def step() -> None:
                columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
                for i in range(0, len(columns[0]), BATCH):
                    word, one, two, *cells_of = (x[i : i + BATCH] for x in columns)
                    descend(own, squares, noise_log, drawn(0, NOISE), word, one, two, layout, [drawn(k, NOISE_DIGITS) for k in (1, 2, 3)], cells_of, room)
                waiting.clear()

            for batch in slices(batches, 128):
                found = tokens(batch.column(0), voc, layout)
                columns = (*contexts(found.ranks, found.ends, voc, own.start), found.cell, *_before(found.cell, found.ends, -1))
                for i in range(0, len(found.ends), 64):
                    part = slice(found.ends[i - 1] if i else 0, found.ends[min(i + 64, len(found.ends)) - 1])
                    waiting.append([x[part] for x in columns])
                    held += len(waiting[-1][0])
                    if held >= BATCH:
                        seen, held = seen + held, 0
                        step()
            if waiting:
                seen += held
                step()
            if seen:
                yield batch_of(kind, [float(seen)], [own.flat().tobytes()])

        return fit

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _merged((w, np.frombuffer(x)) for b in slices(batches, 1) for w, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if found:
            yield batch_of(kind, [found[0]], [found[1].tobytes()])

    for k in range(ROUNDS):
        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS)) == k).select("text")
        tree = part.mapInArrow(fit_from(net.flat()), "weight double, x binary").repartition(FAN).mapInArrow(merge, "weight double, x binary")
        found = _merged((r["weight"], np.frombuffer(bytes(r["x"]))) for r in tree.collect())
        if found:
            net.load(found[1])
    return net


class Scorer:
    """log10 probabilities of tokens after contexts; the normaliser of a context of two classes is computed once.

    A context's vector is a sum over its places, heads and tails, so the power of a score is a product of powers, which are tables; a normaliser needs
    no powers but theirs. Each row of a table is divided by its largest power; where a product then comes near to nothing, it is computed from the vector.
    """

    def __init__(self, net: Net, voc: Vocabulary, layout: Cells | None = None):
        self.net, self.voc, self.layout, self.side = net, voc, layout, voc.classes + 2
        self.norm, self.room = np.full(self.side * self.side, np.nan), Room()
        levels = [(net.r, net.bias), *((getattr(net, f"r{k}"), getattr(net, f"bias{k}")) for k in range(3 if layout else 0))]
        self.targets = [np.c_[r, bias].T.copy() for r, bias in levels]
        self.reach = [float(np.linalg.norm(x, axis=0).max()) for x in self.targets]
        self.shares = [None, *(np.exp(x) for x in layout.log_shares)] if layout else []
        if layout:
            heads, tails = net.heads(), net.tails()
            self.vectors = [x * place for place in net.place for x in (heads, tails)]
            part = np.arange(layout.side**2)
            self.weights = np.concatenate([self.shares[1 + k][above] for k, above in enumerate((part * 0, part // layout.side, part))], axis=1)
            self.powers, self.digit_powers = zip(*(self._powers(v, with_bias=i == 0) for i, v in enumerate(self.vectors)), strict=True)

    def _powers(self, vectors: np.ndarray, with_bias: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Powers of the products with the targets, divided by the largest of a row, and the logs of these: of the classes, and of all digits."""
        found = []
        for x in self.targets:
            scores = vectors @ x[:-1]
            if with_bias:
                scores += x[-1]
            top = scores.max(axis=1)
            scores -= top[:, None]
            found.append((np.exp(scores, out=scores), top))
        digits = found[1:]
        return found[0], (np.concatenate([x for x, _ in digits], axis=1), np.stack([top for _, top in digits], axis=1))

    def _norm(self, p: np.ndarray, level: int = 0, above: np.ndarray | None = None) -> np.ndarray:
        """Log of the sum over the targets of a level, each weighed by its share where there are shares."""
        p = np.c_[p, np.ones(len(p), np.float32)]
        scores = p @ self.targets[level]
        top = 0.0
        if len(p) and float(np.sqrt((p * p).sum(axis=1).max())) * self.reach[level] > 60:  # else no power overflows or vanishes
            possible = scores if above is None else np.where(self.shares[level][above] > 0, scores, -np.inf)
            top = possible.max(axis=1)
            scores = np.minimum(scores - top[:, None], 0)
        np.exp(scores, out=scores)
        if above is None:
            return top + np.log(scores @ np.ones(scores.shape[1], np.float32))
        shares = self.shares[level]
        return top + np.log(scores @ shares[0] if len(shares) == 1 else np.einsum("ij,ij->i", scores, shares[above]))

    def logs(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Of classes after classes."""
        code = one * self.side + two
        new = np.unique(code[np.isnan(self.norm[code])])
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            self.norm[part] = self._norm(self.net.predicted(part // self.side, part % self.side))
        own = (self.net.predicted(one, two) * self.net.r[word]).sum(axis=1) + self.net.bias[word]
        return (own - self.norm[code]) / math.log(10)

    def token_logs(self, word: np.ndarray, one: np.ndarray, two: np.ndarray, cell: np.ndarray, cell_one: np.ndarray, cell_two: np.ndarray) -> np.ndarray:
        """Of tokens after tokens; one outside the table as if unseen, which has a share of one in its cell."""
        found = np.empty(len(word))
        plain = (cell_one < 0) & (cell_two < 0)
        found[plain] = self.logs(word[plain], one[plain], two[plain])
        codes = [*self.net.codes(one, cell_one, self.layout), *self.net.codes(two, cell_two, self.layout)]
        at = np.flatnonzero(~plain)
        found[at] = self._class_logs([c[at] for c in codes], word[at])
        at = np.flatnonzero(cell >= 0)
        found[at] += self._cell_logs([c[at] for c in codes], cell[at])
        return found

    def _vectors(self, codes: list[np.ndarray]) -> np.ndarray:
        return sum(v.take(c, axis=0) for v, c in zip(self.vectors, codes, strict=True))

    def _sums(self, tables: tuple[tuple[np.ndarray, np.ndarray], ...], codes: list[np.ndarray], gather: np.ndarray, weights: np.ndarray | None = None,
              above: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The products of the rows of the four tables, weighed and summed by ``gather``, and what their logs lack. Tails of classes are left out."""
        n, width = len(codes[0]), gather.shape[0]
        sums, top = np.empty((n, gather.shape[1]), np.float32), sum(tops.take(c, axis=0) for (_, tops), c in zip(tables, codes, strict=True))
        kind = (codes[1] > 0) * 2 + (codes[3] > 0)
        order = np.lexsort((codes[0], kind))  # rows used one after the other stay at hand
        ends = np.searchsorted(kind[order], np.arange(5))
        for k in range(4):
            used = [0, *([1] if k >= 2 else []), 2, *([3] if k % 2 else [])]
            for i in range(ends[k], ends[k + 1], 256):
                x = order[i : min(i + 256, ends[k + 1])]
                product, more = self.room(f"product{width}", len(x), width), self.room(f"more{width}", len(x), width)
                tables[0][0].take(codes[0][x], axis=0, out=product, mode="clip")
                for j in used[1:]:
                    product *= tables[j][0].take(codes[j][x], axis=0, out=more, mode="clip")
                if weights is not None:
                    product *= weights.take(above[x], axis=0, out=more, mode="clip")
                sums[x] = product @ gather
        return sums, top

    def _class_logs(self, codes: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        p = self._vectors(codes)
        sums, top = self._sums(self.powers, codes, np.ones((len(self.net.r), 1), np.float32))
        norm = self._logs_of(sums[:, 0], top, p)
        return (np.einsum("ij,ij->i", p, self.net.r.take(word, axis=0)) + self.net.bias.take(word) - norm) / math.log(10)

    def _cell_logs(self, codes: list[np.ndarray], cell: np.ndarray) -> np.ndarray:
        p, inner, total = self._vectors(codes), Inner(cell, self.layout), np.zeros(len(cell))
        levels = np.repeat(np.eye(3, dtype=np.float32), self.layout.sizes, axis=0)
        sums, top = self._sums(self.digit_powers, codes, levels, self.weights, inner.above[2])
        for k in range(3):
            digit, above = inner.digits[k], inner.above[k]
            told = np.einsum("ij,ij->i", p, getattr(self.net, f"r{k}").take(digit, axis=0)) + getattr(self.net, f"bias{k}").take(digit) + self.layout.log_shares[k][above, digit]
            total += told - self._logs_of(sums[:, k], top[:, k], p, k + 1, above)
        return total / math.log(10) - np.where(inner.digits[2] >= self.layout.own, self.layout.mass_log[cell], 0.0)

    def _logs_of(self, sums: np.ndarray, top: np.ndarray, p: np.ndarray, level: int = 0, above: np.ndarray | None = None) -> np.ndarray:
        """Normalisers of a level from sums of products."""
        few = np.flatnonzero(~(sums > 1e-25))  # also what is no number
        sums[few] = 1
        norm = np.log(sums) + top
        for i in range(0, len(few), 1024):
            x = few[i : i + 1024]
            norm[x] = self._norm(p[x], level, None if above is None else above[x])
        return norm


_ROW = "key long, doc_id long, n_tokens long, known long, base double, model double, rare array<string>, times array<int>"
_ROW_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])


def _score_by(shared, flat: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, layout = shared.value
        scorer = Scorer(Net(voc.classes, layout.sizes).load(flat), voc, layout)
        logs = np.log10(voc.count + 1.0)
        key = TaskContext.get().partitionId() << 36
        for batch in slices(batches, 128):
            found = tokens(batch.column(1), voc, layout)
            ranks, ends, cell = found.ranks, found.ends, found.cell
            sizes = np.diff(ends, prepend=0)
            starts = ends - sizes
            word, one, two = contexts(ranks, ends, voc, scorer.net.start)
            frequent = ranks >= 0
            base = np.where(frequent, logs[ranks], 0.0)
            # a token outside the table adds log10(c + 1) where it meets its count
            model = scorer.token_logs(word, one, two, cell, *_before(cell, ends, -1))
            known = frequent & (voc.count[ranks] > 0)
            # each token outside the table once for its text
            pairs, times = np.unique(np.searchsorted(ends, found.rare_at, side="right") * (len(found.rare) + 1) + found.rare_code, return_counts=True)
            row, code = np.divmod(pairs, len(found.rare) + 1)
            cuts = pa.array(np.searchsorted(row, np.arange(len(ends) + 1)), pa.int32())
            yield batch_of(_ROW_ARROW, np.arange(key, key + len(ends)), batch.column(0), sizes, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts),
                           np.add.reduceat(model, starts), pa.ListArray.from_arrays(cuts, found.rare.take(pa.array(code))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())))
            key += len(ends)

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    docs = texts(docs, id_col, text_col)
    training = docs.filter(fold(folds) != held)
    totals = written(token_totals(training), "token-totals")
    voc = vocabulary(totals)
    layout = cells(totals, voc)
    net = train(training, voc, layout)
    shared = docs.sparkSession.sparkContext.broadcast((voc, layout))
    rows = written(docs.mapInArrow(_score_by(shared, net.flat()), _ROW), "scored")
    # tokens outside the table meet their counts by a shuffle
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    met = rare.join(totals, "token").groupBy("key").agg(F.sum("times").alias("more_known"), F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("more"))
    both = rows.drop("rare", "times").join(met, "key", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    return both.select("doc_id", F.coalesce(fold(folds) == held, F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(voc.n).cast("long").alias("train_tokens"),
                       (F.col("base") + F.col("more") - F.col("n_tokens") * math.log10(voc.n + voc.v + 1)).alias("base_score"), (F.col("model") + F.col("more")).alias("score"))
