"""Token counts of whole texts without encoding most of them.

A vocabulary string that is one pre-token and that the merges turn into its own single id is proven,
once and before any text is read, to count as one token. Pre-tokens among those are counted by
lookup; only the rest are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import PATTERN, VOCABULARY, Memo, codec_of, read_ranks
from .common import renamed, slices, strings, tidied

COUNTED = "doc_id long, n_tokens long, n_pre_tokens long"


def whole_tokens(vocabulary: list[bytes], pattern: str = PATTERN) -> set[str]:
    """The strings of the vocabulary that encode, alone, as one token."""
    from .bpe import Codec

    codec, fits = Codec(vocabulary, pattern), regex.compile(pattern).fullmatch
    proven = set()
    for i, token in enumerate(vocabulary):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if fits(text) and codec.split(text) == [text] and codec.merge(token) == [i]:
            proven.add(text)
    return proven


def _counter(shared, proven, pattern: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        if not hasattr(codec, "counts"):
            codec.counts = Memo(dict.fromkeys(proven.value, 1), lambda t: len(codec.merge(t.encode())))
        tokens_in, split = codec.counts.__getitem__, codec.split
        for batch in tidied(batches):
            texts = strings(batch.column(1))
            for a, b in slices(texts):
                n, pre = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    found = split(text)
                    pre.append(len(found))
                    n.append(sum(map(tokens_in, found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(pre, pa.int64())], ["doc_id", "n_tokens", "n_pre_tokens"])

    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, n_pre_tokens`` for each row of ``docs(doc_id, text, …)``.

    The count equals the length of the text's encoding. Null and empty texts have no tokens, repeated
    rows each give a row, a null ``doc_id`` stays null, other columns are ignored and an empty table
    gives no rows.
    """
    context = docs.sparkSession.sparkContext
    ranks = read_ranks(vocabulary)
    shared, proven = context.broadcast(ranks), context.broadcast(whole_tokens(ranks, pattern))
    return renamed(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_counter(shared, proven, pattern), COUNTED)
