"""Byte-level BPE: token ids of whole texts, and texts of token ids.

A text of at most ``chunk_chars`` characters is split into pre-tokens where it stands. A longer one is
cut into chunks that overlap; all chunks are split in parallel, neighbours are stitched at the first
position in their overlap where both begin a pre-token, and the pieces between those positions are
encoded in parallel. Splitting from a position depends only on the text after it, so a shared
position makes all that follows the same as in one pass; where an overlap has none (a single run
longer than the overlap), that text is cut again into longer chunks with wider overlaps. Either way
the ids equal those of the text encoded at once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buffer_of, renamed, slices, strings, tidied

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, words, numbers, signs and white space, as usual for byte-level vocabularies of this size.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
#: Pre-tokens remembered per worker; longer ones than MEMO_CHARS aren't.
MEMO_ENTRIES = 200_000
MEMO_CHARS = 48
#: What follows the end of a match can change it by so many characters at most.
LOOKAHEAD = 4

ENCODED = "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean"


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary: the byte string of each token id, by id."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class Memo(dict):
    """Answers of a function by pre-token, bounded in number."""

    def __init__(self, base: dict, answer: Callable, most: int = MEMO_ENTRIES):
        super().__init__(base)
        self.base, self.answer, self.most = base, answer, most + len(base)

    def __missing__(self, token: str):
        value = self.answer(token)
        if len(token) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
                self.update(self.base)
            self[token] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary within one process."""

    def __init__(self, vocabulary: list[bytes], pattern: str = PATTERN):
        import tiktoken

        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.merge = tiktoken.Encoding(
            "bytes", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={}
        )._core_bpe.encode_single_piece
        lengths = np.array([len(t) for t in vocabulary], np.int64)
        self.pool = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.ids = Memo({}, lambda t: np.array(self.merge(t.encode()), np.int32).tobytes())

    def encode(self, text: str) -> bytes:
        """Token ids as 32-bit integers, one after the other."""
        return b"".join(map(self.ids.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return np.zeros(0, np.uint8)
        return self.pool[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])]

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.spans(text)]


_codecs: list[tuple[list[bytes], str, Codec]] = []


def codec_of(shared, pattern: str) -> Codec:
    """This worker's codec for a broadcast vocabulary."""
    vocabulary = shared.value
    for known, how, codec in _codecs:
        if known is vocabulary and how == pattern:
            return codec
    del _codecs[:-1]
    _codecs.append((vocabulary, pattern, Codec(vocabulary, pattern)))
    return _codecs[-1][2]


def _lists(parts: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(parts), np.int32)
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoder(shared, pattern: str) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in tidied(batches):
            null = batch.column(1).is_null()
            texts = strings(batch.column(1))
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                parts = [codec.encode(t) for t in part.to_pylist()]
                data, offsets = buffer_of(part)
                flat = np.frombuffer(b"".join(parts), np.int32)
                back = codec.decode(flat)
                if len(back) == len(data) and np.array_equal(back, data):
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([bytes(codec.decode(np.frombuffer(p, np.int32))) == t.encode() for p, t in zip(parts, part.to_pylist(), strict=True)])
                mask = null.slice(a, b - a)
                lists = _lists(parts)
                counts = pa.array([len(p) // 4 for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), lists, counts, pa.array(same), mask], ["doc_id", "token_ids", "n_tokens", "round_trip", "was_null"]
                )

    return encode


def _chunks(chunk: int, overlap: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k // chunk], pa.int64()), pa.array([text[k : k + chunk + overlap]]), pa.array([k + chunk + overlap >= len(text)])], ["key", "k", "part", "last"])

    return emit


def _zones(shared, pattern: str, chunk: int, overlap: int) -> Callable:
    """Of each chunk, the boundaries in the overlaps with its neighbours, counted from the overlap's begin."""

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            heads, tails = [], []
            for text, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at = codec.boundaries(text)
                heads.append([p for p in at if p < overlap])
                tails.append([p - chunk for p in at if chunk <= p and (last or p < len(text) - LOOKAHEAD)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["key", "k", "head", "tail"])

    return zones


def stitch(zones: list[tuple[list[int], list[int]]], chunk: int) -> tuple[list[int], bool]:
    """Positions at which the pieces of one text begin, given the zones of its chunks in order; whether all overlaps gave one."""
    cuts = [0]
    for k in range(1, len(zones)):
        both = set(zones[k - 1][1]) & set(zones[k][0])
        if not both:
            return cuts, False  # what follows has no proven boundary
        cuts.append(k * chunk + min(both))
    return cuts, True


def _stitched(chunk: int) -> Callable:
    def stitched(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["k"].to_pylist(), table["head"].to_pylist(), table["tail"].to_pylist(), strict=True))
        cuts, whole = stitch([(h, t) for _, h, t in rows], chunk)
        return pa.table({"key": [table["key"][0].as_py()], "cuts": pa.array([cuts], pa.list_(pa.int64())), "whole": [whole]})

    return stitched


def _cuts(texts: DataFrame, shared, pattern: str, chunk: int, overlap: int, scratch: Scratch) -> DataFrame:
    """``key, cuts`` of each of ``texts(key, text)``; texts with an overlap that gives no boundary again with a wider one.

    A round's chunks are wider than its overlaps, so it ends at the latest when a chunk holds the longest text.
    """
    done, n = None, 0
    while True:
        zones = texts.mapInArrow(_chunks(chunk, overlap), "key string, k long, part string, last boolean").repartition("key", "k")
        zones = zones.mapInArrow(_zones(shared, pattern, chunk, overlap), "key string, k long, head array<int>, tail array<int>")
        found = scratch.cut(zones.groupBy("key").applyInArrow(_stitched(chunk), "key string, cuts array<long>, whole boolean"), f"cuts-{n}")
        good = found.where("whole").select("key", "cuts")
        done = good if done is None else done.unionByName(good)
        left = found.where("not whole").select("key")
        if left.isEmpty():
            return done
        texts, n = texts.join(left, "key", "left_semi"), n + 1
        chunk, overlap = 8 * chunk, 8 * overlap


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int64()), pa.array([text[a:b]])], ["key", "k", "piece"])


def _piece_encoder(shared, pattern: str) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            parts, same = [], []
            for text in batch.column(2).to_pylist():
                parts.append(codec.encode(text))
                same.append(codec.decode(np.frombuffer(parts[-1], np.int32)).tobytes() == text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(parts), pa.array(same)], ["key", "k", "ids", "same"])

    return encode


def encode_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id, token_ids, n_tokens, round_trip`` for each row of ``docs(doc_id, text, …)``.

    ``round_trip`` tells whether the ids decode to the text's own bytes. A null text has null ids, no
    tokens and a null ``round_trip``; an empty one has an empty list; a very long one, of one run even,
    is encoded whole. Repeated rows each give a row,
    a null ``doc_id`` stays null, other columns are ignored and an empty table gives no rows.
    """
    if not 8 * LOOKAHEAD <= overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk and hold a few characters")
    spark: SparkSession = docs.sparkSession
    rows = renamed(docs, {"doc_id": "long", "text": "string"})
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    limit = chunk_chars + overlap_chars
    is_long = F.coalesce(F.length("text") > limit, F.lit(False))

    short = rows.where(~is_long).mapInArrow(_encoder(shared, pattern), ENCODED + ", was_null boolean")
    null = F.col("was_null")
    short = short.select(
        "doc_id",
        F.when(~null, F.col("token_ids")).alias("token_ids"),
        "n_tokens",
        F.when(~null, F.col("round_trip")).alias("round_trip"),
    )

    scratch = Scratch(spark)
    long = scratch.cut(rows.where(is_long).select("doc_id", F.sha2("text", 256).alias("key"), "text"), "long")
    texts = scratch.cut(long.select("key", "text").dropDuplicates(["key"]), "long-texts")
    cuts = _cuts(texts, shared, pattern, chunk_chars, overlap_chars, scratch)
    pieces = texts.join(cuts, "key").mapInArrow(_pieces, "key string, k long, piece string").repartition("key", "k")
    ids = pieces.mapInArrow(_piece_encoder(shared, pattern), "key string, k long, ids array<int>, same boolean")
    whole = ids.groupBy("key").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(k, ids))), x -> x.ids))").alias("token_ids"), F.bool_and("same").alias("round_trip")
    )
    out = long.select("doc_id", "key").join(whole, "key")
    return short.unionByName(out.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip"))


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` for each row of ``encoded(doc_id, token_ids, …)``: raw bytes concatenated, then read as UTF-8.

    Ids outside the vocabulary and nulls in a list are an error in the data: the row's text is null.
    Null lists give null, empty lists the empty text; bytes that aren't UTF-8 become U+FFFD.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, PATTERN)
        for batch in batches:
            texts: list[str | None] = []
            for ids in batch.column(1):
                flat = None if not ids.is_valid else ids.values
                if flat is None or flat.null_count:
                    texts.append(None)
                    continue
                at = flat.to_numpy(zero_copy_only=False)
                good = not len(at) or (at.min() >= 0 and at.max() < len(codec.lengths))
                texts.append(codec.decode(at).tobytes().decode("utf-8", "replace") if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return renamed(encoded, {"doc_id": "long", "token_ids": "array<int>"}).mapInArrow(decode, "doc_id long, text string")
