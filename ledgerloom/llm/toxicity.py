"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on windows of ordinary documents, one on the fragments of toxic documents that
ordinary ones use less often (byte groups of words, ``SHORTEST`` to ``LONGEST`` long, that stand in ``MIN_TEXTS`` toxic texts or more and take ``ODDS`` times the
places a byte there). Places are counted, not texts: a marker that ordinary texts hold once by chance still tells. A window is
compressed with the ordinary dictionary and with both; what the toxic one saves is its distance. Windows cover the whole
text. Short fragments save less than zstandard's whole bytes can show, so a static coder, which writes one byte for each of the shortest fragments (``stems``),
counts as well: its codes, by the length of the text, and the bytes it saves. The largest and mean savings of a text and those of the coder,
calibrated by a logistic fit on labelled rows, give its score; the threshold is 0.5. The toxic dictionary holds every stem, however many there are.

The fit uses a bounded sample of labelled rows: at most ``SAMPLE`` of each label, smallest hashes of the id first, from rows outside the
held-out fold. Half of them (all, if fewer than ``FEW`` are toxic) make the dictionaries, the others the calibration. Without any toxic
row, or without telling fragments, every score is the share of toxic rows. Labels that are null do not count; a text is scored from its
characters alone, null as empty. Repeated rows and null ids are scored each.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import batch_of, fold, slices, texts, written

SAMPLE, FEW, WINDOWS = 2400, 60, 12
MIN_TEXTS, ODDS, SHORTEST, LONGEST = 8, 10, 4, 8
WINDOW, OVERLAP, LEVEL = 96, 16, 6
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 700
FEATURES = 11


def windows(text: str) -> list[bytes]:
    data = text.lower().encode()
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - OVERLAP), WINDOW - OVERLAP)]


def groups(data: bytes) -> Iterator[bytes]:
    """Every place of every group inside a word."""
    return (w[i : i + n] for w in data.split() for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1))


def fragments(data: bytes, telling: set[bytes]) -> list[bytes]:
    """The parts of words that telling groups cover."""
    found = []
    for word in data.split():
        covered = bytearray(len(word))
        for n in range(SHORTEST, LONGEST + 1):
            for i in range(len(word) - n + 1):
                if word[i : i + n] in telling:
                    covered[i : i + n] = b"\1" * n
        found += [word[m.start() : m.end()] for m in re.finditer(b"\1+", covered)]
    return found


def shortest(found: Iterable[bytes]) -> list[bytes]:
    """Those that hold no other."""
    kept: list[bytes] = []
    for f in sorted(found, key=lambda f: (len(f), f)):
        if not any(k in f for k in kept):
            kept.append(f)
    return kept


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=p)


def _features(text: str, ordinary, both, stems: re.Pattern) -> list[float]:
    d = np.array([len(ordinary(w)) - len(both(w)) for w in windows(text)], float)
    d[::-1].sort()
    high = d > 2
    data = text.lower().encode()
    codes = stems.findall(data)
    n, size = len(codes), np.log(len(data) + 1)
    coder = [np.log1p(n), size, np.log(n + 0.1) - size, np.log1p(sum(map(len, codes)) - n)]
    return [d[0], d[:2].mean(), d[:4].mean(), d.mean(), np.log(len(d)), high.mean(), np.log1p(high.sum()), *coder]


@dataclass
class Model:
    """Everything a worker needs: two dictionaries, the stems of the coder and the calibration."""

    ordinary: bytes
    toxic: bytes
    stems: list[bytes]
    middle: list[float]
    spread: list[float]
    weights: list[float]

    def features(self):
        if not self.toxic:
            return lambda text: [0.0] * FEATURES
        ordinary, both = _compressor(self.ordinary).compress, _compressor(self.toxic + self.ordinary).compress
        stems = re.compile(b"|".join(map(re.escape, self.stems)))
        return lambda text: _features(text, ordinary, both, stems)

    def scorer(self):
        features, middle, spread, weights = self.features(), np.array(self.middle), np.array(self.spread), np.array(self.weights)
        return lambda text: float(1 / (1 + np.exp(-np.clip((np.array(features(text)) - middle) / spread @ weights[:-1] + weights[-1], -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, label: str, folds: int) -> DataFrame:
    """doc_id, text, toxic, half: the bounded labelled sample, at most SAMPLE rows of each label."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    told = told.filter(fold(folds) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    parts = [told.filter(F.col("toxic") == t).orderBy("h").limit(SAMPLE) for t in (0, 1)]
    chosen = parts[0].union(parts[1]).select("doc_id", "toxic", F.pmod(F.shiftright("h", 7), F.lit(2)).alias("half"))
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "half")


def _counted(sample: DataFrame, parts) -> DataFrame:
    """part binary, n, texts: at how many places and in how many texts a part stands; ``parts`` gives the parts of one text, place by place."""
    schema = pa.schema([("part", pa.binary()), ("n", pa.int64()), ("texts", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            places: Counter = Counter()
            holders: Counter = Counter()
            for text in batch.column(0).to_pylist():
                own = Counter(parts((text or "").lower().encode()))
                places.update(own)
                holders.update(own.keys())
            yield batch_of(schema, list(places), list(places.values()), [holders[p] for p in places])

    return sample.select("text").mapInArrow(run, "part binary, n long, texts long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5) -> Model:
    sample = written(_sample(docs, labels, label, folds), "toxic-sample")
    counted = sample.groupBy("toxic", "half").agg(F.count("*").alias("count"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).collect()
    sizes = {(r["toxic"], r["half"]): r["count"] for r in counted}
    toxic, ordinary = (sum(n for (t, _), n in sizes.items() if t == k) for k in (1, 0))
    split = toxic >= FEW
    rate = (toxic + 0.5) / (toxic + ordinary + 1)
    flat = Model(b"", b"", [], [0.0] * FEATURES, [1.0] * FEATURES, [0.0] * FEATURES + [float(np.log(rate / (1 - rate)))])
    if not toxic or not ordinary:
        return flat
    first = sample.filter("half = 0") if split else sample
    n_toxic = sum(n for (t, h), n in sizes.items() if t == 1 and (h == 0 or not split))
    toxic_bytes, ordinary_bytes = (max(1, sum(r["bytes"] for r in counted if r["toxic"] == k and (r["half"] == 0 or not split))) for k in (1, 0))
    least = max(2, min(MIN_TEXTS, 0.1 * n_toxic))
    often = {bytes(r["part"]): r["n"] for r in _counted(first.filter("toxic = 1"), groups).filter(F.col("texts") >= least).collect()}
    usual = {bytes(r["part"]): r["n"] for r in _counted(first.filter("toxic = 0"), lambda data: (g for g in groups(data) if g in often)).collect()}
    telling = {g for g, n in often.items() if n / toxic_bytes >= ODDS * (usual.get(g, 0) + 1) / ordinary_bytes}
    told = _counted(first.filter("toxic = 1"), lambda data: fragments(data, telling)).orderBy("part").collect() if telling else []
    model = flat
    if told:
        draw = random.Random(0)
        choice = draw.choices([bytes(r["part"]) for r in told], weights=[r["n"] for r in told], k=60_000)
        pieces = [b" ".join(choice[i : i + 3]) for i in range(0, len(choice), 3)]

        def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = []
                for text in batch.column(0).to_pylist():
                    w = windows(text or "")
                    out += random.Random(len(w)).sample(w, min(WINDOWS, len(w)))
                yield batch_of(pa.schema([("w", pa.binary())]), out)

        common = sorted(bytes(r["w"]) for r in first.filter("toxic = 0").select("text").mapInArrow(some, "w binary").collect())
        stems = shortest(bytes(r["part"]) for r in told if r["texts"] >= least) or shortest(telling)
        held = _dictionary(max(TOXIC_BYTES, 2 * sum(len(x) + 1 for x in stems)), pieces)
        held = b" ".join([*(x for x in stems if x not in held), held])
        model = Model(_dictionary(ORDINARY_BYTES, common), held, stems, flat.middle, flat.spread, flat.weights)
        model = _calibrated(model, sample.filter("half = 1") if split else sample)
    return model


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; samples too few to train on stand for themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def _calibrated(model: Model, sample: DataFrame) -> Model:
    schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.features()
        for batch in slices(batches):
            yield batch_of(schema, [list(map(float, features(x or ""))) for x in batch.column(0).to_pylist()], batch.column(1))

    rows = sorted(tuple(r["x"]) + (r["y"],) for r in sample.select("text", "toxic").mapInArrow(run, "x array<double>, y int").collect())
    data = np.array(rows).reshape(-1, FEATURES + 1)
    x, y = data[:, :-1], data[:, -1]
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - middle) / spread, np.ones(len(x))]
    prior = np.full(FEATURES + 1, 0.1)
    w = np.zeros(FEATURES + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(prior), a.T @ (p - y) + prior * w)
    return Model(model.ordinary, model.toxic, model.stems, middle.tolist(), spread.tolist(), w.tolist())


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; a column of that name is replaced."""
    rest = docs.drop(score_col) if score_col in docs.columns else docs
    schema = T.StructType([*rest.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slices(batches):
            found = [score(x or "") for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, score_col])

    return rest.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    plain = texts(docs, id_col, text_col)
    scored = with_scores(plain, train(plain, labels, folds=folds))
    return scored.select("doc_id", F.coalesce(fold(folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
