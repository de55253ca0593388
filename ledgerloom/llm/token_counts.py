"""Token counts by a two-tier lookup on the map side.

A piece of the vocabulary holds blanks only at its start, so merging never crosses the beginning of a run of blanks that
follows another character: the text falls into pre-tokens that are encoded one by one, and the lengths add up. Tier one is a
broadcast table of frequent pre-tokens with their lengths, at most ``FREQUENT`` entries; tier two is each worker's own bounded
memory of the rest, filled by encoding. No pre-token is ever shuffled: the frequent ones come from summaries that each task
makes of its own rows and that are merged in a tree, a whole summary at a time. The table decides speed only, never a count.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch_of, slices, texts

MODEL = "piece_bpe_32k.model"
#: Most entries of the broadcast table, of a task's running summary, and of a worker's memory of misses.
FREQUENT, SUMMARY, REMEMBERED = 16_384, 200_000, 400_000
BLANK = "▁"
PRE_TOKEN = re.compile(r" *[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without the blank that the encoder puts before each; a blank alone at the end gives ""."""
    text = text.replace(BLANK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    found = PRE_TOKEN.findall(text)
    return found[:1] + [x[1:] for x in found[1:]]


class Lengths(dict):
    """Pre-token -> number of tokens; what is missing is encoded and remembered, up to a bound."""

    def __init__(self, frequent: dict[str, int], model: str):
        super().__init__(frequent)
        self.frequent, self.encode = frequent, sentencepiece.SentencePieceProcessor(model_file=model).encode
        self[""] = 1

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.frequent) + REMEMBERED:
            self.clear()
            self.update(self.frequent)
            self[""] = 1
        n = len(self.encode(word))
        self[word] = n
        return n


def _shrink(counts: Counter, size: int) -> None:
    kept = counts.most_common(size)
    counts.clear()
    counts.update(dict(kept))


def frequent_pre_tokens(docs: DataFrame, size: int = FREQUENT, fan: int = 16) -> list[str]:
    """About the ``size`` most frequent pre-tokens over all documents; at most fan * size entries reach the driver."""
    schema = pa.schema([("pre_tokens", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(pre_tokens(text or ""))
            if len(counts) > SUMMARY:
                _shrink(counts, SUMMARY // 4)
        _shrink(counts, size)
        yield batch_of(schema, [list(counts)], [list(counts.values())])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 1):
            for words, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update(dict(zip(words, n, strict=True)))
            _shrink(counts, SUMMARY // 4)
        _shrink(counts, size)
        yield batch_of(schema, [list(counts)], [list(counts.values())])

    ddl = "pre_tokens array<string>, n array<long>"
    tree = docs.select("text").mapInArrow(summarise, ddl).repartition(fan).mapInArrow(merge, ddl)
    counts: Counter = Counter()
    for row in tree.toLocalIterator():
        counts.update(dict(zip(row.pre_tokens, row.n, strict=True)))
    return sorted(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_pre_tokens: one row for each row of ``docs``."""
    model = model or public_tokenizers.path(MODEL)
    docs = texts(docs, id_col, text_col)
    frequent = frequent_pre_tokens(docs)
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    lengths = dict(zip(frequent, map(len, processor.encode(frequent, num_threads=1)), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(lengths)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_pre_tokens", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lengths(shared.value, model).__getitem__
        for batch in slices(batches):
            rows = [x or "" for x in batch.column(1).to_pylist()]
            cut = [pre_tokens(x) for x in rows]
            yield batch_of(schema, batch.column(0), [len(x.encode()) for x in rows], [sum(map(look, x)) for x in cut], [len(x) for x in cut])

    counted = docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, n_pre_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pre_tokens")
