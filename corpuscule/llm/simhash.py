"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

Each text has two 64-bit SimHashes. The first (over words, with character trigrams that weigh less
the longer the text) is what is searched: 2^(radius+1)-1 structured bit masks are drawn so that any
two signatures at Hamming distance ``radius`` or less agree under at least one of them, hence collide
in that mask's table. No pair within the radius is missed. The second (over the set of words, with
hashes of its own) confirms a pair: it must be within ``confirm`` bits too.

Texts of equal signatures are one node, so exact copies cost nothing; buckets are searched whole,
without a cap. In a large bucket a breadth-first search emits a spanning forest in place of all
pairs, which leaves the connected groups as they are. A bucket with far too many nodes is split by a
second family of masks, drawn anew: any two of its nodes within the radius agree under one of those
too. Such buckets are known beforehand from a sample of the nodes, so that none goes to one task; the
sample decides only where pairs are looked for, not which are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _WORD, SLICE_BYTES, Scratch, buffer_of, mix, renamed, runs, scan_parts, slices, span_hashes, strings, tidied, tidy

RADIUS = 6
#: Bits in which the confirming signatures may differ.
CONFIRM = 14
#: Weight of the trigrams of a short text, and the number of words at which it is halved.
TRIGRAM_WEIGHT = 1.5
TRIGRAM_WORDS = 150
#: Entries of the tables that one task searches, about.
ROWS_A_TASK = 1_500_000
#: Nodes from which a bucket is split by another family of masks, and how often that is repeated.
HOT = 16_384
DEPTH = 3
#: One node in so many is looked at to know hot buckets beforehand; so many of these are listed at most, the fullest.
LOOKED_AT = 256
MOST_LISTED = 100_000
SEED = 20_240_607

_TRI = np.zeros(256, np.uint8)
_TRI[ord("a") : ord("z") + 1] = np.arange(1, 27)
_TRI[ord("0") : ord("9") + 1] = 27
_TRI[128:] = 28 + (np.arange(128) & 3)


def masks(radius: int = RADIUS, bits: int = 64, family: int = 0) -> np.ndarray:
    """The bits that count in each table of a family.

    Every bit position gets a vector of radius+1 random bits; the table of vector v counts the
    positions whose vector has an odd product with v. ``radius`` differing positions span less
    than the whole space, so some v is orthogonal to all of them: its table ignores them all.
    """
    rng = np.random.default_rng(SEED + family)
    position = rng.integers(0, 1 << (radius + 1), bits, dtype=np.uint64)
    found = []
    for v in range(1, 1 << (radius + 1)):
        odd = np.bitwise_count(position & np.uint64(v)) & 1
        found.append(int(sum(1 << i for i in np.flatnonzero(odd).tolist())))
    return np.array(found, np.uint64)


_plane: list[np.ndarray] = []


def _trigram_planes() -> np.ndarray:
    if not _plane:
        h = mix(np.arange(32768, dtype=np.uint64), 0x7E57ED)
        _plane.append(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1)
    return _plane[0]


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both signatures of each text of a slice. A text without words has hashes of its bytes instead."""
    lower = pc.utf8_lower(column)
    data, offsets = buffer_of(lower)
    starts, ends, doc = runs(data, offsets, _WORD)
    h = span_hashes(data, starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    weight = np.sqrt(np.diff(np.append(first, len(h)))).astype(np.float32)
    n_words = np.bincount(doc, minlength=len(column))
    h, doc = h[first], doc[first]
    bits_a = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
    bits_b = np.unpackbits(mix(h, 0xC0FFEE).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
    at = np.searchsorted(doc, np.arange(len(column) + 1))

    kind = _TRI[data]
    keep = np.empty(len(kind), bool)
    if len(kind):
        keep[0] = True
        keep[1:] = (kind[1:] > 0) | (kind[:-1] > 0)
    begin = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kind = kind[keep].astype(np.int64)
    code = kind[:-2] * 1024 + kind[1:-1] * 32 + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    planes = _trigram_planes()

    a, b = np.zeros((len(column), 64), np.float32), np.zeros((len(column), 64), np.float32)
    for i in range(len(column)):
        s, e = at[i], at[i + 1]
        if s == e:
            continue
        a[i] = weight[s:e] @ bits_a[s:e]
        b[i] = bits_b[s:e].sum(0)
        grams = np.bincount(code[begin[i] : max(begin[i], begin[i + 1] - 2)], minlength=1)
        there = np.flatnonzero(grams)
        scale = TRIGRAM_WEIGHT / (1 + n_words[i] / TRIGRAM_WORDS)
        a[i] += (np.sqrt(grams[there]).astype(np.float32) * np.float32(scale)) @ planes[there]
    out = [np.packbits(x > 0, axis=1).view(np.uint64).ravel() for x in (a, b)]
    bare = np.flatnonzero(n_words == 0)
    if len(bare):
        whole, at0 = buffer_of(column)
        own = span_hashes(whole, at0[bare], at0[bare + 1]) if len(whole) else mix(np.zeros(len(bare), np.uint64))
        out[0][bare], out[1][bare] = mix(own, 1), mix(own, 2)
    return out[0], out[1]


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidied(batches):
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        texts = strings(batch.column(1))
        for s, e in slices(texts, SLICE_BYTES // 2):
            a, b = signatures(texts.slice(s, e - s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s, e - s), pa.array(a.view(np.int64), mask=null[s:e]), pa.array(b.view(np.int64), mask=null[s:e]), batch.column(2).slice(s, e - s)],
                ["doc_id", "sig", "conf", "text_hash"],
            )


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, sig, conf, text_hash`` for each row of ``docs(doc_id, text, …)``."""
    rows = renamed(docs, {"doc_id": "long", "text": "string"}).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(_signer, "doc_id long, sig long, conf long, text_hash long")


#: A node in a table: its signatures, the table, and the table of the second family (from 1) where the bucket is split.
ENTRY = np.dtype([("sig", "<u8"), ("conf", "<u8"), ("first", "u1"), ("second", "u1")])


class Tables:
    """Which bucket a signature falls into, in each table of both families."""

    def __init__(self, radius: int):
        self.first, self.second = masks(radius), masks(radius, family=1)
        self.salt = mix(np.arange(len(self.first), dtype=np.uint64), 0xB0C4E7)

    def bucket(self, sig: np.ndarray, table: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sig & self.first[table]) + self.salt[table])

    def within(self, bucket: np.ndarray, sig: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The bucket, within a split one, in a table of the second family."""
        with np.errstate(over="ignore"):
            return mix(bucket * np.uint64(0x9E3779B97F4A7C15) + mix((sig & self.second[table]) + self.salt[table], 0x51D))

    def of(self, entries: np.ndarray) -> np.ndarray:
        """The bucket of each entry."""
        h = self.bucket(entries["sig"], entries["first"])
        at = np.flatnonzero(entries["second"])
        if len(at):
            h[at] = self.within(h[at], entries["sig"][at], entries["second"][at] - 1)
        return h


def _entries(tables: Tables, sig: np.ndarray, conf: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of these nodes, and their buckets; ``hot`` has the buckets to be split, in order."""
    n = len(tables.first)
    node, first = np.repeat(np.arange(len(sig)), n), np.tile(np.arange(n), len(sig))
    h = tables.bucket(sig[node], first)
    second = np.zeros(len(h), np.int64)
    if len(hot):
        split = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        many = np.flatnonzero(split)
        inner = np.tile(np.arange(len(tables.second)), len(many))
        deep = np.repeat(many, len(tables.second))
        h = np.concatenate([h[~split], tables.within(h[deep], sig[node[deep]], inner)])
        node, first = np.concatenate([node[~split], node[deep]]), np.concatenate([first[~split], first[deep]])
        second = np.concatenate([second[~split], inner + 1])
    out = np.empty(len(h), ENTRY)
    out["sig"], out["conf"], out["first"], out["second"] = sig[node], conf[node], first, second
    return out, h


def _spread(tables: Tables, parts: int, hot: np.ndarray) -> Callable:
    """Each node's entries in all tables, packed by the partition that searches their bucket."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, conf = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            for s in range(0, len(sig), 4_096):
                entries, h = _entries(tables, sig[s : s + 4_096], conf[s : s + 4_096], hot)
                part = (h % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part = part[order]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                offsets = np.append(first, len(part)).astype(np.int64) * ENTRY.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(entries[order])])
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), packed], ["part", "entries"])

    return spread


def _buckets(tables: Tables) -> Callable:
    """Only the buckets that nodes fall into, to be counted."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column(0).to_numpy().view(np.uint64)
            n = len(tables.first)
            for s in range(0, len(sig), 4_096):
                h = tables.bucket(np.repeat(sig[s : s + 4_096], n), np.tile(np.arange(n), len(sig[s : s + 4_096])))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return buckets


def hot_buckets(nodes: DataFrame, n_nodes: int, tables: Tables) -> np.ndarray:
    """The buckets, in order, that have over ``HOT`` nodes by the look of a sample: ``MOST_LISTED`` at most."""
    sample = nodes.where(F.pmod(F.xxhash64("sig", "conf", F.lit(7)), F.lit(LOOKED_AT)) == 0)
    least = max(2, HOT // LOOKED_AT, -(-n_nodes * len(tables.first) // (LOOKED_AT * MOST_LISTED)))
    found = sample.mapInArrow(_buckets(tables), "h long").groupBy("h").count().where(F.col("count") >= least)
    return np.sort(np.array([r.h for r in found.orderBy(F.col("count").desc(), "h").limit(MOST_LISTED).collect()], np.int64).view(np.uint64))


def forest(sig: np.ndarray, conf: np.ndarray, radius: int, confirm: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of row numbers, of the near pairs among these rows."""
    left = np.arange(len(sig))
    pairs_a, pairs_b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (np.bitwise_count(sig[left] ^ sig[at]) <= radius) & (np.bitwise_count(conf[left] ^ conf[at]) <= confirm)
            found = left[near]
            if len(found):
                pairs_a.append(np.full(len(found), at))
                pairs_b.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    if not pairs_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pairs_a), np.concatenate(pairs_b)


def bucket_pairs(h: np.ndarray, sig: np.ndarray, conf: np.ndarray, radius: int, confirm: int, small: int = 12, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of near pairs within buckets, enough to connect all that are near."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(hs)))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wide = np.repeat(size, size)
    ok = (wide > 1) & (wide <= small)
    for d in range(1, small):
        i = np.flatnonzero(ok[:-d] & (hs[:-d] == hs[d:])) if len(hs) > d else []
        if not len(i):
            break
        a, b = order[i], order[i + d]
        near = (np.bitwise_count(sig[a] ^ sig[b]) <= radius) & (np.bitwise_count(conf[a] ^ conf[b]) <= confirm)
        out_a.append(a[near])
        out_b.append(b[near])
    for k in np.flatnonzero(size > small):
        rows = order[first[k] : first[k] + size[k]]
        search = split_pairs if size[k] > HOT and depth else forest
        a, b = search(sig[rows], conf[rows], radius, confirm, *([depth - 1] if search is split_pairs else []))
        out_a.append(rows[a])
        out_b.append(rows[b])
    return np.concatenate(out_a), np.concatenate(out_b)


def split_pairs(sig: np.ndarray, conf: np.ndarray, radius: int, confirm: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, for many rows: within the buckets of another family of masks, one table after the other."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mask in masks(radius, family=2 + depth):
        a, b = bucket_pairs(sig & mask, sig, conf, radius, confirm, depth=depth)
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _pairs(tables: Tables, radius: int, confirm: int) -> Callable:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(packed.as_buffer(), ENTRY) for batch in batches for packed in batch.column(1)]
        if not parts:
            return
        entries = np.concatenate(parts)
        del parts
        h, sig, conf = tables.of(entries), entries["sig"].copy(), entries["conf"].copy()
        del entries
        a, b = bucket_pairs(h, sig, conf, radius, confirm)
        seen = np.unique(np.stack([sig[a], conf[a], sig[b], conf[b]], 1), axis=0) if len(a) else np.zeros((0, 4), np.uint64)
        del h, sig, conf
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(seen[:, i]).view(np.int64)) for i in range(4)], ["sa", "ca", "sb", "cb"])
        tidy()

    return pairs


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root`` of each node of ``edges(u, v)``: the smallest node it is connected with.

    Large-star and small-star steps in turn, each cut by a table in the shared folder, until nothing
    moves; the number of steps grows with the logarithm of the longest path.
    """
    scratch = scratch or Scratch(edges.sparkSession)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = scratch.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = scratch.cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root")


def _rooted(nodes: DataFrame, radius: int, confirm: int, scratch: Scratch) -> DataFrame:
    """``sig, conf, root`` of each of ``nodes(sig, conf)`` that is near another; ids are dense, so no two nodes share one."""
    spark, tables = nodes.sparkSession, Tables(radius)
    n = nodes.count()
    parts = max(scan_parts(spark), -(-n * len(tables.first) // ROWS_A_TASK))
    hot = hot_buckets(nodes, n, tables)
    # as many tasks spread the nodes as search the tables
    rows = nodes.select("sig", "conf").repartition(parts).mapInArrow(_spread(tables, parts, hot), "part int, entries binary").repartitionById(parts, F.col("part"))
    pairs = scratch.cut(rows.mapInArrow(_pairs(tables, radius, confirm), "sa long, ca long, sb long, cb long"), "pairs")
    ends = pairs.select(F.col("sa").alias("sig"), F.col("ca").alias("conf")).unionByName(pairs.select(F.col("sb").alias("sig"), F.col("cb").alias("conf"))).distinct()
    ids = scratch.cut(ends.withColumn("id", F.monotonically_increasing_id()), "ids")
    of = lambda s, c, name: ids.select(F.col("sig").alias(s), F.col("conf").alias(c), F.col("id").alias(name))
    edges = pairs.join(of("sa", "ca", "u"), ["sa", "ca"]).join(of("sb", "cb", "v"), ["sb", "cb"]).select("u", "v")
    # the smallest node of a group is no edge's upper end and has no row of its own
    roots = components(edges, scratch)
    roots = scratch.cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    return ids.join(roots.withColumnRenamed("node", "id"), "id").select("sig", "conf", "root")


def _decided(docs: DataFrame, radius: int, confirm: int, scratch: Scratch) -> DataFrame:
    """``doc_id, text_hash, group_id, group_size, keep`` of each row; a row in no group has a null ``text_hash``.

    Rows are counted by node first, nodes by group then; only what a node's rows share is joined to them.
    """
    signed = scratch.cut(sign(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", "row")).alias("first")
    nodes = scratch.cut(signed.where("sig is not null").groupBy("sig", "conf").agg(F.count(F.lit(1)).alias("n"), first), "nodes")
    rooted = nodes.join(_rooted(nodes, radius, confirm, scratch), ["sig", "conf"], "left")
    together = rooted.where("root is not null").select("root", "sig", "conf", "n", "first")
    group = together.groupBy("root").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    groups = together.select("root", "sig", "conf").join(group, "root").drop("root").unionByName(rooted.where("root is null and n > 1").select("sig", "conf", "n", "first"))
    groups = scratch.cut(groups, "groups")
    scratch.drop("nodes", "pairs", "ids", "edges", "roots")
    named = signed.join(groups, ["sig", "conf"], "left")
    alone = F.col("n").isNull()
    return named.select(
        "doc_id",
        F.when(~alone, F.col("text_hash")).alias("text_hash"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("group_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("keep"),
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """``doc_id, group_id, group_size, keep`` for each row of ``docs(doc_id, text, …)``.

    A group is a connected set of rows whose first signatures differ in ``radius`` bits at most and
    whose second ones in ``confirm`` at most. ``group_id`` is its smallest ``doc_id``, whose row is the
    one with ``keep``; among repeated rows of that id just one is kept. Texts without any word (empty
    ones too) are near only to the same text; very long ones are read whole. A null text is a group of
    its own and kept; a null ``doc_id`` is never the kept one unless the whole group has none. Other
    columns are ignored; an empty table gives none.
    """
    return _decided(docs, radius, confirm, Scratch(docs.sparkSession)).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their own columns, whatever these are called.

    Of a group the row of smallest ``doc_id`` stays; of rows repeated in id and text that whose columns,
    as JSON, come first. Null texts stay; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    decided = _decided(docs, radius, confirm, scratch).where("text_hash is not null")
    gone = decided.groupBy("doc_id", "text_hash").agg(F.bool_or("keep").alias("keep"), F.count(F.lit(1)).alias("n")).where("not keep or n > 1")
    gone = scratch.cut(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("keep").alias("_keep")), "dropped")
    scratch.drop("signatures", "groups")
    names, again = docs.columns, gone.where("_keep")
    # the rows as structs, so that the keys can't clash with columns of the input
    rows = docs.select(F.struct(*names).alias("row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"].cast("string")).alias("_th"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_hash"))
    # the same join at every size: the small side is hashed, the texts aren't sorted
    out = rows.join(gone.hint("shuffle_hash"), same, "left_anti").select("row.*")
    if again.isEmpty():
        return out
    repeated = rows.join(again.hint("shuffle_hash"), same, "left_semi").groupBy("_doc", "_th")
    return out.unionByName(repeated.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
