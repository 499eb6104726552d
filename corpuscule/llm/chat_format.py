"""Chat formatting by columnar byte assembly.

The rows of a conversation become one string: for each turn a header with its role, the content and an
end mark. For many conversations at once, the lengths of all segments give the offsets of the output
by a running sum and the position of every output byte in a pool of templates, roles and contents;
one gather fills the preallocated Arrow buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, buffer_of, renamed, strings

HEADER, BETWEEN, FOOTER = "<|im_start|>", "\n", "<|im_end|>\n"
NO_ROLE = "unknown"
#: Bytes that a string of Spark's can have; a longer conversation's text is null.
MOST_BYTES = (1 << 31) - 64

FORMATTED = "conv_id long, n_turns long, text string"


def assemble(roles: pa.Array, texts: pa.Array, starts: np.ndarray, header: str = HEADER, between: str = BETWEEN, footer: str = FOOTER) -> pa.Array:
    """A string per conversation; ``starts`` has the first row of each. Together they have ``MOST_BYTES`` at most."""
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (header, between, footer)]
    role_data, role_at = buffer_of(roles)
    text_data, text_at = buffer_of(texts)
    pools = [*fixed, role_data, text_data]
    pool = np.concatenate(pools) if len(text_data) <= SLICE_BYTES else None
    base = np.cumsum([0, *map(len, fixed), len(role_data)])
    n = len(roles)
    source, size = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for column, k in ((0, 0), (2, 1), (4, 2)):
        source[:, column], size[:, column] = base[k], len(fixed[k])
    source[:, 1], size[:, 1] = base[3] + role_at[:-1], np.diff(role_at)
    source[:, 3], size[:, 3] = base[4] + text_at[:-1], np.diff(text_at)
    source, size = source.ravel(), size.ravel()
    ends = np.cumsum(size)
    total = int(ends[-1]) if n else 0
    if pool is not None:
        out = pool[np.repeat(source - (ends - size), size) + np.arange(total)]
    else:  # few long segments: each copied as a whole, without a position for every byte
        out = np.empty(total, np.uint8)
        for s, k, e in zip(source.tolist(), size.tolist(), ends.tolist(), strict=True):
            p = int(np.searchsorted(base, s, "right")) - 1
            out[e - k : e] = pools[p][s - base[p] : s - base[p] + k]
    rows = np.concatenate([[0], ends[4::5]])
    offsets = np.append(rows[starts], total).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _formatter(header: str, between: str, footer: str, single: bool) -> Callable:
    """Formats rows that stand together by conversation; with ``single``, each is one of its own."""

    def finish(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table["conv_id"].combine_chunks()
        roles = strings(pc.fill_null(table["role"].combine_chunks(), NO_ROLE))
        texts = strings(table["text"].combine_chunks())
        ends = np.append(starts[1:], len(ids))
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(size[ends], size[starts[i]] + SLICE_BYTES, "right")))
            a, b = starts[i], ends[j - 1]
            out = assemble(roles.slice(a, b - a), texts.slice(a, b - a), starts[i:j] - a, header, between, footer)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts[i:j])), pa.array(ends[i:j] - starts[i:j]), out], ["conv_id", "n_turns", "text"])
            i = j

    def firsts(ids: pa.Array) -> np.ndarray:
        if single:
            return np.arange(len(ids))
        null = ids.is_null().to_numpy(zero_copy_only=False)
        number = pc.fill_null(ids, 0).to_numpy()
        new = np.ones(len(ids), bool)
        new[1:] = (number[1:] != number[:-1]) | (null[1:] != null[:-1])
        return np.flatnonzero(new)

    def format_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a conversation that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = firsts(batch.column(0))
            if held and (single or not batch.column(0)[0].equals(held[-1].column(0)[-1])):
                yield from finish(pa.Table.from_batches(held), np.array([0]))
                held = []
            if len(starts) > 1:
                first = 0
                if held:  # by itself, as it can be long
                    yield from finish(pa.Table.from_batches([*held, batch.slice(0, starts[1])]), np.array([0]))
                    held, first = [], 1
                if first < len(starts) - 1:
                    whole = batch.slice(starts[first], starts[-1] - starts[first])
                    yield from finish(pa.Table.from_batches([whole]), starts[first:-1] - starts[first])
            held.append(batch.slice(starts[-1]))
        if held:
            yield from finish(pa.Table.from_batches(held), np.array([0]))

    return format_all


def format_chats(conversations: DataFrame, header: str = HEADER, between: str = BETWEEN, footer: str = FOOTER, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``conv_id, n_turns, text`` for each conversation of ``conversations(conv_id, turn, role, text, …)``.

    Turns are in order of ``turn`` (null first), then role, then text, so ties and repeated rows have a
    set order; each row is a turn. A null role is written ``unknown``, a null text as nothing, an empty
    or very long text as it is. A row of null ``conv_id`` belongs to no other: it is a conversation of
    one turn, whose id stays null. A conversation that would have more than ``most_bytes``, which no
    string can hold, has a null text and all its turns counted; its rows are counted where they stand
    and go to no one task. Other columns are ignored; an empty table gives no rows.
    """
    rows = renamed(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    known = rows.where("conv_id is not null")
    fixed = len((header + between + footer).encode())
    size = F.octet_length(F.coalesce("role", F.lit(NO_ROLE))) + F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(fixed).cast("long")
    sizes = known.groupBy("conv_id").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n_turns"))
    # at most as many as the table's bytes make strings of the greatest length
    over = Scratch(rows.sparkSession).cut(sizes.where(F.col("size") > most_bytes).select("conv_id", "n_turns"), "over-long")
    fits = known.join(F.broadcast(over), "conv_id", "left_anti")
    fits = fits.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    alone = rows.where("conv_id is null").select("conv_id", "role", "text")
    out = fits.mapInArrow(_formatter(header, between, footer, False), FORMATTED)
    out = out.unionByName(alone.mapInArrow(_formatter(header, between, footer, True), FORMATTED))
    return out.unionByName(over.select("conv_id", "n_turns", F.lit(None).cast("string").alias("text")))


SQL = """
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS single FROM conversations) GROUP BY conv_id, single
"""
