"""URL filters by a sorted digest array.

The list's rules become files, each for a range of keys: the 64-bit xxhash keys of its rules in order,
and their full strings. Spark hands the files to every executor, where they are memory-mapped, so the
workers of a machine share one copy and only what is probed is read. Each URL gives the keys of its
host, its parent domains and its path's beginnings; a vectorised binary search finds them, and the
stored string is compared, so that no collision blocks. A list of any length is searched like this; it
needs room on each executor's disk, some 60 MB for a million rules.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, renamed, shared_folder

#: Rules in a file, about; a longer list makes more files.
RULES_A_FILE = 2_000_000
MAGIC = b"urldigest1\0\0\0\0\0\0"

FILTERED = "page_id long, url string, blocked boolean, rule string"

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def canonical(url: str | None) -> str:
    """Without scheme, query, fragment and closing slashes; the host in lower case."""
    rest = _SCHEME.sub("", (url or "").strip(" "))
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return (host.lower() + slash + path).rstrip("/")


def keys_of(url: str | None) -> list[str]:
    """What may be listed to block this URL: host, parent domains of two labels or more, path beginnings."""
    whole = canonical(url)
    host, _, path = whole.partition("/")
    if not host:
        return []
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
    if path:
        parts = path.split("/")
        keys += [host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))]
    return keys


def digest(rules: list[str]) -> bytes:
    """The file of these rules."""
    stored = sorted({(xxhash.xxh64_intdigest(r), r.encode()) for r in rules if r})
    keys = np.array([k for k, _ in stored], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for _, r in stored])]).astype(np.int64)
    return MAGIC + np.array([len(stored)], np.int64).tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(r for _, r in stored)


class Digest:
    """A digest file, memory-mapped."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        if bytes(whole[:16]) != MAGIC:
            raise ValueError("not a digest file")
        n = int(whole[16:24].view(np.int64)[0])
        self.keys = whole[24 : 24 + 8 * n].view(np.uint64)
        self.offsets = whole[24 + 8 * n : 32 + 16 * n].view(np.int64)
        self.blob = whole[32 + 16 * n :]

    def find(self, keys: list[str], h: np.ndarray) -> np.ndarray:
        """Which of the keys, whose hashes are ``h``, are listed."""
        listed = np.zeros(len(keys), bool)
        if not len(self.keys) or not keys:
            return listed
        at = np.searchsorted(self.keys, h)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h):
            j, key = int(at[i]), keys[i].encode()
            while j < len(self.keys) and self.keys[j] == h[i]:  # rules of equal hashes stand together
                if self.blob[self.offsets[j] : self.offsets[j + 1]].tobytes() == key:
                    listed[i] = True
                    break
                j += 1
        return listed


class Digests:
    """The files of one list; the first bits of a key tell its file."""

    def __init__(self, names: list[str], bits: int):
        self.parts, self.bits = [Digest(SparkFiles.get(n)) for n in names], bits

    def find(self, keys: list[str]) -> np.ndarray:
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        part = part_of(h, self.bits)
        listed = np.zeros(len(keys), bool)
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            listed[at] = self.parts[p].find([keys[i] for i in at], h[at])
        return listed


def part_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The key range that each key is in, of 2^bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


_open: dict[str, Digests] = {}


def _prober(names: list[str], bits: int) -> Callable:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names[0] not in _open:
            _open.clear()
            _open[names[0]] = Digests(names, bits)
        for batch in batches:
            keys = [keys_of(u) for u in batch.column(1).to_pylist()]
            flat = [k for ks in keys for k in ks]
            rules: list[str | None] = [None] * len(keys)
            row = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys])
            for i in np.flatnonzero(_open[names[0]].find(flat)):
                old, new = rules[row[i]], flat[i]
                if old is None or (len(new), new) > (len(old), old):
                    rules[row[i]] = new
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r is not None for r in rules]), pa.array(rules, pa.string())], ["page_id", "url", "blocked", "rule"])

    return probe


def _publish(spark: SparkSession, content: bytes) -> str:
    """Writes the file to the shared folder and has Spark hand it to all executors; returns its name."""
    name = f"urls-{uuid.uuid4().hex}.digest"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for i in range(0, len(content), 1 << 22):
        out.write(bytearray(content[i : i + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def _parted(bits: int) -> Callable:
    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.fromiter((xxhash.xxh64_intdigest(r) for r in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(h, bits)), batch.column(0)], ["part", "rule"])

    return parted


def _digested(table: pa.Table) -> pa.Table:
    return pa.table({"part": [table["part"][0].as_py()], "content": [digest(table["rule"].to_pylist())]})


def filter_urls(pages: DataFrame, rules: DataFrame, rules_a_file: int = RULES_A_FILE) -> DataFrame:
    """``page_id, url, blocked, rule`` for each row of ``pages(page_id, url, …)``, given ``rules(rule, …)``.

    A rule is a host (blocks it and its subdomains) or a host and the beginning of a path, compared by
    whole segments. ``rule`` is the longest rule that blocks the URL, of equally long ones the last in
    order. Null and empty URLs aren't blocked, nor is any by a null or empty rule; very long ones are
    read whole; repeated rows each give a row; other columns are ignored; an empty table gives no rows,
    an empty list blocks none. The list is cut into as many key ranges as make files of about
    ``rules_a_file`` rules; the driver holds one of them at a time.
    """
    spark = pages.sparkSession
    rows = renamed(pages, {"page_id": "long", "url": "string"})
    scratch = Scratch(spark)
    listed = scratch.cut(renamed(rules, {"rule": "string"}).where("rule <> ''").distinct(), "rules")
    bits = max(0, -(-listed.count() // rules_a_file) - 1).bit_length()
    parts = listed.mapInArrow(_parted(bits), "part long, rule string").groupBy("part").applyInArrow(_digested, "part long, content binary")
    parts = scratch.cut(parts, "digests")
    names = [""] * (1 << bits)
    for r in parts.toLocalIterator():
        names[r.part] = _publish(spark, bytes(r.content))
    nothing = _publish(spark, digest([])) if "" in names else ""
    scratch.drop("rules", "digests")
    return rows.mapInArrow(_prober([n or nothing for n in names], bits), FILTERED)


#: Pages of a host from which its share of unencrypted ones is judged.
LEAST_PAGES = 3


def rules_from_pages(pages: DataFrame) -> DataFrame:
    """A list for the query: hosts that mostly serve unencrypted pages, and addresses crawled more than once."""
    whole = F.regexp_replace(F.regexp_replace(F.trim("url"), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#][\\s\\S]*$", "")
    named = pages.select(
        F.lower(F.split_part(whole, F.lit("/"), F.lit(1))).alias("host"), whole.alias("whole"), F.col("url").startswith("http://").alias("plain")
    ).where("host <> ''")
    named = named.select("host", "plain", F.regexp_replace(F.concat("host", F.expr("substring(whole, length(host) + 1)")), "/+$", "").alias("address"))
    hosts = named.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("plain").cast("int")).alias("n_plain"))
    hosts = hosts.where((F.col("n") >= LEAST_PAGES) & (2 * F.col("n_plain") > F.col("n"))).select(F.col("host").alias("rule"))
    twice = named.where("address <> host").groupBy("address").count().where("count > 1").select(F.col("address").alias("rule"))
    return hosts.unionByName(twice)


SQL = f"""
WITH named AS (
  SELECT n, page_id, url, host, starts_with(url, 'http://') AS plain,
    CASE WHEN host = '' THEN '' ELSE rtrim(host || substr(whole, length(host) + 1), '/') END AS address
  FROM (
    SELECT *, lower(split_part(whole, '/', 1)) AS host FROM (
      SELECT row_number() OVER () AS n, page_id, url,
        regexp_replace(regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#](.|\\n)*$', '') AS whole
      FROM pages))
), rules AS (
  SELECT host AS rule FROM named WHERE host <> '' GROUP BY host
  HAVING count(*) >= {LEAST_PAGES} AND 2 * count(*) FILTER (WHERE plain) > count(*)
  UNION
  SELECT address FROM named WHERE host <> '' AND address <> host GROUP BY address HAVING count(*) > 1
), keys AS (
  SELECT n, array_to_string(list_slice(labels, i, len(labels)), '.') AS rule
  FROM (SELECT n, string_split(host, '.') AS labels, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS i FROM named WHERE host <> '')
  UNION ALL
  SELECT n, host || '/' || array_to_string(list_slice(parts, 1, i), '/')
  FROM (SELECT n, host, string_split(substr(address, length(host) + 2), '/') AS parts,
      unnest(range(1, 1 + len(string_split(substr(address, length(host) + 2), '/')))) AS i
    FROM named WHERE host <> '' AND length(address) > length(host) + 1)
), hits AS (
  SELECT n, arg_max(rule, (length(rule), rule)) AS rule FROM keys JOIN (SELECT DISTINCT rule FROM rules) USING (rule) GROUP BY n
)
SELECT page_id, url, hits.rule IS NOT NULL AS blocked, hits.rule AS rule FROM named LEFT JOIN hits USING (n)
"""
