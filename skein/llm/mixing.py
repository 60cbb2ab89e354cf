"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, document after document, form a stream that is packed into
blocks of fixed length. Every source gets as many block slots as its target needs. Each
slot draws an output shard, which makes a source's counts over the shards multinomial;
the counts then say which of the source's slots a shard holds: the shards take them in
turn, from the first to the last. A slot's number is mapped through a pseudorandom
permutation of its source's block numbers (another one for each pass over the source),
and the words follow by a join on (source, block).

The permutation is a swap-or-not shuffle: in every round an index and its mirror image
about a point of the round change places or not, by a bit of the larger of the two. It
permutes any number of blocks exactly and is computed for one index alone.

Nothing is ordered over a whole source: documents are numbered within ranges of
(source, id, size, content), whose bounds Spark samples, and the ranges' totals are
summed, so a source that holds most rows, null, repeated or outlying ids are split like
any other. Slots of one source are drawn in pieces of ``SLOTS_PER_PIECE``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running_sum
from .common import written

#: Characters that separate words.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Modulus of the hashes by squares below (a prime; numbers of blocks stay under it).
PRIME = 2147483647
ROUNDS = 12
ROWS_PER_RANGE = 2048
SLOTS_PER_PIECE = 1 << 16


@dataclass(frozen=True)
class Mix:
    """share: total target over all sizes, as numerator and denominator; most: times
    that a source may be taken; block: words of a block; slots_per_shard: on average."""

    share: tuple[int, int] = (3, 2)
    most: int = 2
    block: int = 64
    slots_per_shard: int = 4096
    seed: int = 17


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: src (rank), source, source_size, target, blocks, slots.

    A source's target is the lesser of ``most`` times its size and its weight times
    one level; the level that spends the whole share is the largest of those that the
    sources, in the order in which they fill up, would have with all before them full.
    """
    w = F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), (F.pmod(F.col("src"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = (docs.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
           .withColumn("weight", w).withColumn("cap", mix.most * F.col("source_size")))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    num, den = mix.share
    level = ((F.sum("source_size").over(everything) * num / den - F.coalesce(F.sum("cap").over(filled), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    size, blocks = F.col("source_size"), F.col("blocks")
    return (per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
            .withColumn("blocks", F.ceil(size / mix.block))
            .withColumn("slots", F.when(size > 0, F.least(mix.most * blocks, F.floor(F.col("target") * blocks / size + 0.5)))
                        .otherwise(0).cast("long"))
            .select("src", "source", "source_size", "target", "blocks", "slots"))


def offsets(docs: DataFrame) -> DataFrame:
    """``docs`` (src, doc_id, size, key, rid) with ``off``, the words of the same source
    before the row, in that order. Sums run within ranges, then over the ranges."""
    order = ["doc_id", "size", "key", "rid"]
    parts = max(1, -(-docs.count() // ROWS_PER_RANGE))
    # written, since the bounds are sampled: a row's range must not change
    docs = written(docs.repartitionByRange(parts, "src", *order).withColumn("rng", F.spark_partition_id()), "mix-ranges")
    before = Window.partitionBy("src").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (docs.groupBy("src", "rng").agg(F.sum("size").alias("words"))
              .select("src", "rng", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("src", "rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (docs.withColumn("part", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["src", "rng"])
            .withColumn("off", F.col("base") + F.col("part")).drop("rng", "part", "base"))


def _square(x: Column) -> Column:
    """A number below ``PRIME`` hashed from one up to its square root's reach."""
    return x % PRIME * (x % PRIME) % PRIME * 48271 % PRIME


def _round(x: Column, n: Column, key: Column) -> Column:
    """Where one round of the shuffle puts index ``x`` of 0..n-1."""
    mirror = F.pmod(_square(key) % n - x, n)
    return F.when(F.floor(_square(F.greatest(x, mirror) + key) / 65536) % 2 == 1, mirror).otherwise(x)


def permuted(rows: DataFrame, index: str, n: str, src: str, turn: str, seed: int, name: str) -> DataFrame:
    """``rows`` with ``name``, ``index`` of 0..n-1 in the permutation of (src, turn).

    One projection per round: generated code, where a fold over the rounds as one
    expression would be interpreted row by row."""
    base = F.col(src) * 7919 + F.col(turn) * 104729 + (seed * 1299709 + 1)
    out = rows.withColumn(name, F.col(index))
    for r in range(ROUNDS):
        out = out.withColumn(name, _round(F.col(name), F.col(n), base + r * 15485863))
    return out


def shard_counts(per: DataFrame, mix: Mix) -> DataFrame:
    """(src, blocks, shard, first, slots): the multinomial counts of each source over the
    output shards (those of no slots left out) and the first slot that each holds."""
    total = per.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-total // mix.slots_per_shard))
    cut = (per.where("slots > 0").select("src", "blocks", "slots", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(slots - 1) div {SLOTS_PER_PIECE}"))).alias("piece")))
    parts = max(1, min(total // SLOTS_PER_PIECE + 1, 100_000))
    draws = cut.repartition(parts, "src", "piece").select("src", "blocks", F.explode(F.sequence(
        F.col("piece") * SLOTS_PER_PIECE, F.least(F.col("slots"), (F.col("piece") + 1) * SLOTS_PER_PIECE) - 1)).alias("draw"))
    shard = F.pmod(F.xxhash64("src", "draw", F.lit(mix.seed)), F.lit(shards))
    counts = draws.groupBy("src", "blocks", shard.alias("shard")).agg(F.count("*").alias("slots"))
    counts = running_sum(counts, ["src"], "shard", "slots", "upto")
    return counts.select("src", "blocks", "shard", (F.col("upto") - F.col("slots")).alias("first"), "slots")


def slots(per: DataFrame, mix: Mix) -> DataFrame:
    """(src, shard, slot, block): the slots that each shard holds, and the block that the
    source's permutation of the slot's turn puts there."""
    counts = written(shard_counts(per, mix), "mix-shards")
    total = counts.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first().n
    # few rows make many slots: dealt out by the slots, not by their own size
    parts = max(1, min(total // (SLOTS_PER_PIECE // 4) + 1, 100_000))
    one = counts.repartition(parts, "src", "shard").select("src", "blocks", "shard", F.explode(
        F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot"))
    one = one.withColumn("turn", F.expr("slot div blocks")).withColumn("index", F.col("slot") % F.col("blocks"))
    placed = permuted(one, "index", "blocks", "src", "turn", mix.seed, "block").select("src", "shard", "slot", "block")
    # written: a join's filter on the block would be pushed through the rounds, which triples it at each
    return written(placed, "mix-slots")


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """Rows with words, cut where blocks of their source begin: block, first, words."""
    last = F.expr(f"(off + size - 1) div {block}")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"off div {block}"), last)))
    first = F.greatest(F.col("off"), F.col("block") * block)
    return cut.withColumn("words", F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block) - first).withColumn(
        "first", first - F.col("off"))


def _sized(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """(rows with src and off, sources): the texts are read once, for their sizes. A row's
    key and second key are hashes of its contents, its rid tells equal rows apart."""
    keys = [F.xxhash64(*docs.columns).alias("key"), F.xxhash64(F.lit(7), *docs.columns).alias("key2")]
    slim = written(docs.select("doc_id", "source", *keys, count_words(F.col("text")).alias("size"),
                               F.monotonically_increasing_id().alias("rid")), "mix-sizes")
    per = written(targets(slim, mix), "mix-targets")
    rank = per.select("src", F.col("source").alias("_source"))
    rows = slim.join(rank, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    return written(offsets(rows), "mix-offsets"), per


def mixed_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: (shard, src, slot, block, doc_id, first, words), the words of every
    slot of every output shard as runs of its documents' words."""
    rows, per = _sized(docs, mix)
    return pieces(rows, mix.block).join(slots(per, mix).hint("merge"), ["src", "block"]).select(
        "shard", "src", "slot", "block", "doc_id", "first", "words")


def taken_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    ``taken`` counts the row's words in the mix, repeats included, at most ``most``
    times its size. Null texts have size 0; a null source is a source of its own, the
    last; rows with a null or repeated doc_id are counted each; an empty table gives
    no rows. The same input gives the same result.
    """
    rows, per = _sized(docs.select("doc_id", "source", "text"), mix)
    times = slots(per, mix).groupBy("src", "block").agg(F.count("*").alias("times"))
    # both sides grow with the corpus, though the planner only sees the few sources of one
    got = (pieces(rows, mix.block).join(times.hint("merge"), ["src", "block"], "left")
           .groupBy("src", "rid", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")))
    none = rows.where("size = 0").select("src", "rid", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return got.unionByName(none).join(per, "src").select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, mix: Mix = Mix(block=512)) -> DataFrame:
    """The mix as documents: the columns of ``docs`` (doc_id, text, lang, source,
    n_chars), one row per document and pass over its words.

    A row taken whole keeps its text; one of which the mix takes some blocks only
    has those blocks' words, joined by spaces. Rows without words are not taken; rows
    that repeat others in every column are taken each. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows, per = _sized(docs, mix)
    # the r-th slot of a block, in slot order, belongs to pass r
    nth = slots(per, mix).withColumn("turn", F.row_number().over(Window.partitionBy("src", "block").orderBy("slot")))
    cut = (pieces(rows, mix.block).join(nth.hint("merge"), ["src", "block"])
           .groupBy("key", "key2", "rid", "size", "turn")
           .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("cut"), F.sum("words").alias("got")))
    # texts travel once: equal rows are one here, and the join is by the same keys
    texts = docs.select("*", F.xxhash64(*docs.columns).alias("key"), F.xxhash64(F.lit(7), *docs.columns).alias("key2"))
    texts = texts.dropDuplicates(["key", "key2"])
    words = F.filter(F.split("text", SEPARATORS), lambda x: x != "")
    chosen = F.array_join(F.flatten(F.transform("cut", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")
    mixed = F.when(F.col("got") == F.col("size"), F.col("text")).otherwise(chosen)
    return (cut.join(texts.hint("merge"), ["key", "key2"]).withColumn("mixed", mixed)
            .select("doc_id", F.col("mixed").alias("text"), "lang", "source", F.length("mixed").cast("long").alias("n_chars")))


def oracle(mix: Mix = Mix()) -> str:
    """DuckDB SQL for :func:`taken_words` over the table documents."""
    num, den = mix.share
    weights = ", ".join(map(str, WEIGHTS))
    def square(x: str) -> str:
        return f"((({x}) % {PRIME}) * (({x}) % {PRIME}) % {PRIME} * 48271 % {PRIME})"

    key = f"(src * 7919 + (slot // blocks) * 104729 + {mix.seed * 1299709 + 1} + r * 15485863)"
    mirror = f"((({square(key)} % blocks - x) % blocks + blocks) % blocks)"
    swap = f"CASE WHEN {square(f'greatest(x, {mirror}) + {key}')} // 65536 % 2 = 1 THEN {mirror} ELSE x END"
    block = f"list_reduce(list_prepend(slot % blocks, range({ROUNDS})), lambda x, r: {swap})"
    b, m = mix.block, mix.most
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
              CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS src FROM d GROUP BY source),
s1 AS (SELECT *, [{weights}][1 + src % {len(WEIGHTS)}] AS weight, {m} * source_size AS cap FROM s0),
s2 AS (SELECT *, (CAST((SELECT sum(source_size) FROM s1) AS BIGINT) * {num} / {den}::DOUBLE
                  - coalesce(sum(cap) OVER f, 0)::DOUBLE)
                 / ((SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER f, 0))::DOUBLE AS lv
       FROM s1 WINDOW f AS (ORDER BY cap / weight::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT src, source, source_size, least(cap::DOUBLE, weight * (SELECT max(lv) FROM s2)) AS target,
              CAST(ceil(source_size / {b}::DOUBLE) AS BIGINT) AS blocks FROM s2),
s AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least({m} * blocks, floor(target * blocks / source_size + 0.5)) ELSE 0 END
              AS BIGINT) AS slots FROM s3),
sl AS (SELECT src, blocks, unnest(range(slots)) AS slot FROM s WHERE slots > 0),
t AS (SELECT src, {block} AS block, count(*) AS times FROM sl GROUP BY ALL),
o AS (SELECT d.doc_id, d.size, s.src, row_number() OVER () AS rid,
             coalesce(sum(d.size) OVER (PARTITION BY s.src ORDER BY d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, unnest(range(off // {b}, (off + size - 1) // {b} + 1)) AS block FROM o WHERE size > 0),
g AS (SELECT p.rid, sum((least(off + size, (p.block + 1) * {b}) - greatest(off, p.block * {b})) * coalesce(t.times, 0)) AS taken
      FROM p LEFT JOIN t ON p.src = t.src AND p.block = t.block GROUP BY p.rid)
SELECT o.doc_id, o.size, s.source_size, s.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM o JOIN s ON o.src = s.src LEFT JOIN g ON g.rid = o.rid
"""
