"""URL filters by a sort-merge range join.

A host with its labels reversed ("org.example.") is a key of which every subdomain's
key is a continuation, so a rule's host covers an interval of the sorted keys. URLs and
rules are dealt out by key ranges (a rule to every range that its interval meets),
sorted within them, and swept once: the stack holds the rules whose intervals are open,
each nested in the one below. Memory is that of the stack, whatever a range holds; a
host with many URLs is split into ranges by path and a hash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ROWS_PER_RANGE = 1_000
MAX_RANGES = 10_000
#: Keys per range in the sample that sets the range bounds (results do not depend on it).
KEYS_PER_RANGE = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first "://" up to "/", "?", "#" or the end, A-Z
    lower-cased; path then up to "?", "#" or the end. Both empty without "://"."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(rows: Iterator[tuple], default: str) -> Iterator[tuple]:
    """Rows (range, key, kind, id, host, path, verdict) sorted by range, key and kind
    (0: rule, 1: URL) to (id, host, path, rule, verdict) of the URLs.

    A rule fits where its host's interval is open and the URL's path starts with its
    path; the longest rule text wins, then the longest host. A rule host's paths are
    looked up by length, so many rules of one host cost only their distinct lengths.
    """
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
    current = None
    for rng, key, kind, ident, host, path, verdict in rows:
        if rng != current:
            stack, current = [], rng
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            paths, lengths = stack[-1][1], stack[-1][2]
            paths.setdefault(path, (host + path, verdict))
            if len(path) not in lengths:
                lengths.append(len(path))
                lengths.sort(reverse=True)
            continue
        best, rank = None, (-1, -1)
        for k, paths, lengths in stack:
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if (len(hit[0]), len(k)) > rank:
                        best, rank = hit, (len(hit[0]), len(k))
                    break
        yield ident, host, path, best[0] if best else None, best[1] if best else default


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``rules``: host, path, verdict (rows with a null are ignored; of equal host and path
    the least verdict counts). A URL that no rule fits, null ones included, gets a null
    rule and the ``default`` verdict. Repeated rows are judged alike.
    """
    host, path = split_url(F.col("url"))
    urls = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
            .select("id", host.alias("host"), path.alias("path")))
    sep = F.lit("\x01")
    urls = written(urls.withColumn("key", F.concat(host_key(F.col("host")), sep, F.col("path"), sep,
                                                   F.hex(F.xxhash64("id")))), "url-keys")
    ranges = max(1, min(MAX_RANGES, -(-urls.count() // ROWS_PER_RANGE)))
    sample = [r.key for r in urls.select("key").orderBy(F.xxhash64("key"), "key").limit(KEYS_PER_RANGE * ranges).collect()]
    sample.sort()
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rng = [bisect_right(bounds, k) for k in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rng, pa.int32()), *b.columns], ["rng", *b.schema.names])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [(bisect_right(bounds, k), bisect_right(bounds, k + "\U0010ffff")) for k in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in at], pa.int32()), pa.array([y for _, y in at], pa.int32())],
                [*b.schema.names, "lo", "hi"])

    kind = pages.schema[id_col].dataType.simpleString()
    dealt = urls.mapInArrow(numbered, f"rng int, id {kind}, host string, path string, key string")
    dealt = dealt.select("rng", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    ruled = (rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
             .select("host", "path", host_key(F.col("host")).alias("key"), "verdict"))
    ruled = (ruled.mapInArrow(covered, "host string, path string, key string, verdict string, lo int, hi int")
             .withColumn("rng", F.explode(F.sequence("lo", "hi")))
             .select("rng", "key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), "host", "path", "verdict"))
    together = dealt.unionByName(ruled).repartition(ranges, "rng").sortWithinPartitions("rng", "key", "kind", "path")
    names = [id_col, "host", "path", "rule", "verdict"]
    arrow_kind: list[pa.DataType] = []

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                if not arrow_kind:
                    arrow_kind.append(b.schema.field(3).type)
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = [arrow_kind[0], *[pa.string()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for r in sweep(rows(), default):
            out.append(r)
            if len(out) >= 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return together.mapInArrow(swept, f"{id_col} {kind}, host string, path string, rule string, verdict string")


def oracle(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    """DuckDB SQL for :func:`judge_urls` over the table pages."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(rh, rp, rv) AS (VALUES {values}),
u AS (SELECT page_id, row_number() OVER () AS rid,
             CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT h.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, '{default}') AS verdict FROM m WHERE k = 1
"""
