"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, every piece that ends there (it follows the output links, longest first); each
relaxes the best score up to that position. A character that is no piece costs the least piece score less 10 and is written as its
UTF-8 bytes. Equal scores: the longer last piece wins. A piece holds blanks only at its start, so the best path passes
through the beginning of every pre-token, and pre-tokens are solved one by one with a bounded memory of solved ones.

This is the segmentation that the library gives for these pieces when they are declared a unigram model; the library's own
order of merges for the file can give others. Decoding restores the text exactly, save that U+2581 becomes a blank.
Null texts encode to an empty list, as empty texts do; decoding null ids gives null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import slices
from ledgerloom.llm.token_counts import BLANK, MODEL, pre_tokens

REMEMBERED = 500_000
NEVER = float("-inf")


class Pieces(dict):
    """Pre-token -> ids of its best segmentation, as bytes of int32; what is missing is solved and remembered, up to a bound."""

    def __init__(self, model: str):
        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.automaton = ahocorasick.Automaton()
        least, self.text, self.byte_ids, self.single = 0.0, [], [0] * 256, set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(piece)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.automaton.add_word(piece, (len(piece), sp.get_score(i), i))
                least = min(least, sp.get_score(i))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = least - 10
        self.bytes = {i: b for b, i in enumerate(self.byte_ids)}
        self.first_plain = max(self.bytes) + 1
        self.spelled = pa.array([bytes([self.bytes[i]]) if i in self.bytes else x.encode() for i, x in enumerate(self.text)], pa.binary())

    def solve(self, text: str) -> list[int]:
        if not self.single.issuperset(text):
            return self.solve_with_unknown(text)
        n = len(text)
        best, back = [0.0] + [NEVER] * n, [(0, 0)] * (n + 1)
        for at, (length, score, i) in self.automaton.iter(text):
            at += 1
            score += best[at - length]
            if score > best[at]:
                best[at], back[at] = score, (length, i)
        ids: list[int] = []
        while n:
            length, i = back[n]
            ids.append(i)
            n -= length
        return ids[::-1]

    def solve_with_unknown(self, text: str) -> list[int]:
        """The same where some character is no piece; such a position may also be reached over the unknown character."""
        n = len(text)
        best, back = [0.0] + [NEVER] * n, [(0, -1)] * (n + 1)
        ending: list[list[tuple]] = [[] for _ in range(n + 1)]
        for at, piece in self.automaton.iter(text):
            ending[at + 1].append(piece)
        for end in range(1, n + 1):
            for length, score, i in ending[end]:
                if best[end - length] + score > best[end]:
                    best[end], back[end] = best[end - length] + score, (length, i)
            if text[end - 1] not in self.single and best[end - 1] + self.unknown > best[end]:
                best[end], back[end] = best[end - 1] + self.unknown, (1, -1)
        ids: list[int] = []
        while n:
            length, i = back[n]
            ids += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(text[n - 1].encode())]
            n -= length
        return ids[::-1]

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = np.array(self.solve(BLANK + word.replace(" ", BLANK)), np.int32).tobytes()
        self[word] = ids
        return ids

    def encoded(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        if min(ids, default=0) >= self.first_plain:
            text = "".join(map(self.text.__getitem__, ids))
        else:
            text = self._with_bytes(ids)
        text = text.replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text

    def decoded(self, ids: pa.Array) -> pa.Array:
        """``decode`` of each list of a column, null for null; column-wise, save where byte pieces spell no UTF-8."""
        flat = pc.list_flatten(ids)
        if not flat.null_count and (pc.min(flat).as_py() or 0) >= 0:
            ends = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(ids), 0).to_numpy()])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.spelled.take(flat)), b"")
            try:
                text = pc.replace_substring(joined.cast(pa.string()), BLANK, " ")
            except pa.ArrowInvalid:
                pass
            else:
                text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
                return pc.if_else(ids.is_valid(), text, None) if ids.null_count else text
        return pa.array([None if x is None else self.decode(x) for x in ids.to_pylist()], pa.string())

    def _with_bytes(self, ids: list[int]) -> str:
        """Runs of byte pieces become the characters that they spell."""
        out: list[str] = []
        for is_byte, run in groupby(ids, self.bytes.__contains__):
            out.append(bytes(map(self.bytes.__getitem__, run)).decode(errors="replace") if is_byte else "".join(map(self.text.__getitem__, run)))
        return "".join(out)


_LOADED: dict[str, Pieces] = {}


def load(model: str) -> Pieces:
    """One automaton for each worker process and model."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _extended(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    rest = df.drop(name) if name in df.columns else df
    return rest, T.StructType([*rest.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", model: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``ids_col``; a column of that name is replaced."""
    model = model or public_tokenizers.path(MODEL)
    rest, schema = _extended(docs, ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in slices(batches):
            ids = [pieces.encoded(x or "") for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids_col])

    return rest.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", model: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and the text of its ids; a column of that name is replaced."""
    model = model or public_tokenizers.path(MODEL)
    rest, schema = _extended(encoded, text_col, T.StringType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in slices(batches):
            found = pieces.decoded(batch.column(batch.schema.get_field_index(ids_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, text_col])

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_hash (of the ids in order), decoded_sha256, restored (null counts as empty)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = decode(encode(plain, model=model), model=model)
    return both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.translate("text", BLANK, " ")).alias("restored"))
