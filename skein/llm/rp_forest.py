"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors recursively at the median of a random projection; vectors
near a threshold go to both sides (spill). Vectors that meet in a leaf are compared in
double precision; pairs at or above the threshold are linked, and links are united over
all leaves and trees.

The upper levels are fitted on a bounded sample and then deal every vector out to
(tree, leaf) groups; a leaf that is still too large is split on in a task, by the same
rule, before anything is compared. A pair is counted by the first final leaf that holds
both ends, which every copy of a vector can tell from its list of final leaves, so pairs
never leave their task: only counts and spanning edges do. Equal vectors are one point with a weight.

A group of near copies larger than a leaf would be cut by splits that pass through it,
so it never meets one. Where the sample is dense, a sampled vector is the centre of a
cell: points that link with a centre belong to the cell of the nearest one and are in no
tree. What may link with them lies within twice the angle of the centre (the cell's
rim), so all links of a cell's points are found, by comparing the cell with itself and
with its rim, a large one by pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components


@dataclass(frozen=True)
class Forest:
    """trees; leaf: vectors that a leaf should hold; spill: share of a node's vectors
    that go to both sides from either side; sample: bound of the fitted sample; dense:
    linked sampled vectors that make a cell (per_leaf of them stand for a leaf)."""

    trees: int = 6
    leaf: int = 2_000
    spill: float = 0.05
    sample: int = 65_536
    per_leaf: int = 32
    dense: int = 12
    seed: int = 29


def direction(seed: int, tree: int, level: int, node: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, level, node, dim]).standard_normal(dim)


def split(x: np.ndarray, r: np.ndarray, spill: float) -> tuple[float, float, float]:
    """(low, median, high) of the projections: left takes those up to high, right those from low."""
    p = x @ r
    return tuple(np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill]))


@dataclass
class Tree:
    """Split values of the upper levels of one tree for one dimension, by node in breadth-first order."""

    tree: int
    dim: int
    depth: int
    low: np.ndarray
    high: np.ndarray
    seed: int

    @classmethod
    def fit(cls, x: np.ndarray, tree: int, depth: int, f: Forest) -> Tree:
        low, high = np.zeros(2 ** depth - 1), np.zeros(2 ** depth - 1)
        nodes = [np.arange(len(x))]
        for level in range(depth):
            below = []
            for k, at in enumerate(nodes):
                r = direction(f.seed, tree, level, k, x.shape[1])
                i = 2 ** level - 1 + k
                low[i], _, high[i] = split(x[at], r, f.spill) if len(at) else (0.0, 0.0, 0.0)
                p = x[at] @ r
                below += [at[p <= high[i]], at[p >= low[i]]]
            nodes = below
        return cls(tree, x.shape[1], depth, low, high, f.seed)

    def leaves(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x) for every leaf that gets rows."""
        nodes = {0: np.arange(len(x))}
        for level in range(self.depth):
            below: dict[int, np.ndarray] = {}
            for k, at in nodes.items():
                if len(at):
                    p = x[at] @ direction(self.seed, self.tree, level, k, self.dim)
                    i = 2 ** level - 1 + k
                    below[2 * k], below[2 * k + 1] = at[p <= self.high[i]], at[p >= self.low[i]]
            nodes = below
        return [(k, at) for k, at in nodes.items() if len(at)]


def dense_centres(x: np.ndarray, least: float, few: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x that become centres, whether each row is in a cell): the rows with the
    most links first, while a centre adds at least ``few`` rows. x has unit rows."""
    y = x.astype(np.float32)
    count = np.concatenate([(y[s:s + 128] @ y.T >= least).sum(axis=1) for s in range(0, len(y), 128)]) if len(y) else np.zeros(0)
    covered, centres = np.zeros(len(y), bool), []
    for i in np.argsort(-count, kind="stable").tolist():
        if count[i] < few:
            break
        if not covered[i]:
            near = y @ y[i] >= least
            if (near & ~covered).sum() >= few:
                centres.append(i)
                covered |= near
    return np.array(centres, int), covered


def sub_leaves(x: np.ndarray, at: np.ndarray, f: Forest, tree: int, level: int, node: int) -> Iterator[np.ndarray]:
    """Leaves of at most twice the wanted size within one group; a node that a split
    does not shrink (all alike) stays whole."""
    if len(at) <= 2 * f.leaf:
        yield at
        return
    r = direction(f.seed, tree, level, node, x.shape[1])
    p = x[at] @ r
    low, _, high = np.quantile(p, [0.5 - f.spill, 0.5, 0.5 + f.spill])
    a, b = at[p <= high], at[p >= low]
    if max(len(a), len(b)) > 0.9 * len(at):
        yield at
        return
    yield from sub_leaves(x, a, f, tree, level + 1, 2 * node)
    yield from sub_leaves(x, b, f, tree, level + 1, 2 * node + 1)


def linked(x: np.ndarray, at: np.ndarray, least: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of ``at`` with cosine of at least ``least``; x has unit rows."""
    y = x[at]
    for s in range(0, len(at), block):
        c = y[s:s + block] @ y[s:].T
        i, j = np.nonzero(c >= least)
        keep = i < j
        if keep.any():
            yield at[s + i[keep]], at[s + j[keep]]


def owned(i: np.ndarray, j: np.ndarray, member: np.ndarray, here: int) -> np.ndarray:
    """Whether ``here`` is the least leaf that both ends of each pair belong to.
    member: rows of leaf numbers, padded with -1."""
    out = np.empty(len(i), bool)
    for s in range(0, len(i), 50_000):
        a, b = member[i[s:s + 50_000]], member[j[s:s + 50_000]]
        shared = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a >= 0) & (a < here)
        out[s:s + 50_000] = ~shared.any(axis=1)
    return out


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after uniting the pairs: the least label over them until nothing changes."""
    apart = label[i] != label[j]
    i, j = i[apart], j[apart]
    while len(i):
        m = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        np.minimum.at(label, old[i], m)
        np.minimum.at(label, old[j], m)
        label = label[label]
        if (label == old).all():
            break
    return label


def result(pdf: pd.DataFrame, links: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Per linked point its counted links and, as an edge, the first point of its part."""
    while (label[label] != label).any():
        label = label[label]
    node, at = pdf["node"].to_numpy(), np.arange(len(label))
    hit = (links > 0) | (label != at) | np.isin(at, label[label != at])
    return pd.DataFrame({"node": node[hit], "h": pdf["h"].to_numpy()[hit], "links": links[hit], "head": node[label][hit]})


def compare_cell(pdf: pd.DataFrame, least: float, kind: str, block: int = 256) -> pd.DataFrame:
    """Of one (cell, x, y): links of the points of chunk x with those of chunk y. A
    point on the rim that has a lower cell is left to that one, which has the pair too."""
    pdf = pdf.sort_values(["node", "h"], kind="stable")
    v, weight = unit_rows(pdf["vec"].tolist(), kind), pdf["w"].to_numpy()
    cell, x, y = (int(pdf[k].iloc[0]) for k in ("cell", "x", "y"))
    mine, rim, own = pdf["mine"].to_numpy(), pdf["rim"].to_numpy().astype(bool), pdf["own"].to_numpy()
    links, label = np.zeros(len(v), np.int64), np.arange(len(v))
    left, right = np.flatnonzero(~rim & (mine == x)), np.flatnonzero((mine == y) & (~rim | (own < 0) | (own > cell)))
    there = v[right].T
    for s in range(0, len(left), block):
        at = left[s:s + block]
        hit = v[at] @ there >= least
        if x == y:
            hit &= rim[right][None, :] | (at[:, None] < right[None, :])
        links[at] += hit @ weight[right]
        links[right] += weight[at] @ hit
        i, j = np.nonzero(hit)
        label = unite(label, at[i], right[j])
    return result(pdf, links, label)


def final_leaves(pdf: pd.DataFrame, f: Forest, kind: str) -> pd.DataFrame:
    """(node, h, leaf) of one (tree, leaf, dim) group that is split on; leaf numbers end
    in the part's number."""
    pdf = pdf.sort_values(["node", "h"], kind="stable")
    here = int(pdf["leaf"].iloc[0])
    parts = list(sub_leaves(unit_rows(pdf["vec"].tolist(), kind), np.arange(len(pdf)), f, here, 64, 0))
    at = np.concatenate(parts)
    return pd.DataFrame({"node": pdf["node"].to_numpy()[at], "h": pdf["h"].to_numpy()[at],
                         "leaf": here + np.repeat(np.arange(len(parts)), [len(p) for p in parts])})


def compare_leaf(pdf: pd.DataFrame, least: float, kind: str) -> pd.DataFrame:
    """Of one final (leaf, dim) group: per point its counted links and, as an edge, the
    first point of its connected part here."""
    pdf = pdf.sort_values(["node", "h"], kind="stable")
    x = unit_rows(pdf["vec"].tolist(), kind)
    here, weight = int(pdf["leaf"].iloc[0]), pdf["w"].to_numpy()
    member = pdf["member"].tolist()
    width = max(map(len, member))
    member = np.array([np.pad(m, (0, width - len(m)), constant_values=-1) for m in member])
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    for i, j in linked(x, np.arange(len(x)), least):
        own = owned(i, j, member, here)
        np.add.at(links, i[own], weight[j[own]])
        np.add.at(links, j[own], weight[i[own]])
        label = unite(label, i, j)
    return result(pdf, links, label)


def cell_tasks(routes: DataFrame, chunk: int) -> DataFrame:
    """Rows of the cells' comparisons (cell, x, y): a cell and its rim in one task, or,
    beyond ``chunk`` points, every pair of chunks of which one at least is the cell's."""
    cols = ["vec", "h", "node", "w", F.col("own")]
    rows = (routes.where("own >= 0").select(F.col("own").alias("cell"), *cols, F.lit(False).alias("rim"))
            .unionByName(routes.select(F.explode("near").alias("cell"), *cols, F.lit(True).alias("rim"))))
    sizes = rows.groupBy("cell").agg(F.count_if(~F.col("rim")).alias("m"), F.count_if("rim").alias("z"))
    small = F.col("m") + F.col("z") <= chunk
    sizes = sizes.select("cell", F.when(small, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("m") / chunk))).cast("long").alias("cs"),
                         F.when(small, 0).otherwise(F.ceil(F.col("z") / chunk)).cast("long").alias("rs"))
    rows = rows.join(F.broadcast(sizes), "cell")  # at most sample / dense cells
    of_rim = F.when(F.col("rs") == 0, 0).otherwise(F.col("cs") + F.pmod(F.xxhash64("h", F.lit(2)), F.greatest(F.lit(1), "rs")))
    rows = rows.withColumn("mine", F.when(F.col("rim"), of_rim).otherwise(F.pmod(F.xxhash64("h", F.lit(1)), F.col("cs"))))
    last = F.when(F.col("rim"), F.col("cs")).otherwise(F.col("cs") + F.col("rs")) - 1
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("cell", F.least("mine", "turn").alias("x"), F.greatest("mine", "turn").alias("y"), "mine", "rim", "own",
                       "vec", "h", "node", "w")


def near_duplicates(vectors: DataFrame, least: float = 0.95, forest: Forest = Forest(), id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component, and
    rows without an id, link with nothing: n_links 0, component_id their own id (null:
    not kept). Vectors of different lengths never link. An id is one node: what any of
    its rows links is one component.
    The index holds every vector. Links of a point that is in a cell are all found; one
    of two other points is missed only if all trees part it.
    """
    kind = "<f8" if "double" in vectors.schema[vec_col].dataType.simpleString() else "<f4"
    id_kind = vectors.schema[id_col].dataType.simpleString()
    col = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    good = (F.col("id").isNotNull() & col.isNotNull() & (F.size(col) > 0)
            & F.coalesce(F.forall(col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists(col, lambda e: e != 0), F.lit(False)))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, dtype=kind).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "vec"])

    ok = rows.where("good").select("id", "v").mapInArrow(packed, "id bigint, vec binary")
    ok = written(ok.withColumn("h", F.xxhash64("vec")), "vectors")
    points = written(ok.groupBy("vec", "h").agg(F.min("id").alias("node"), F.count("*").alias("w")), "points")
    size = kind[-1]
    dims = {r.dim: r.n for r in points.groupBy((F.length("vec") / int(size)).cast("int").alias("dim")).agg(F.count("*").alias("n")).collect()}
    models: list[Tree] = []
    cells: dict[int, tuple[int, np.ndarray]] = {}
    n_cells = 0
    for dim, n in sorted(dims.items()):
        depth = max(0, math.ceil(math.log2(max(1, n / forest.leaf))))
        depth = min(depth, int(math.log2(max(1, forest.sample // forest.per_leaf))))
        few = points.where(F.length("vec") == dim * int(size)).orderBy(F.xxhash64("h"), "h").limit(forest.per_leaf * 2 ** depth)
        x = unit_rows([bytes(r.vec) for r in few.select("vec").collect()], kind) if n > forest.leaf else np.zeros((0, dim))
        centres, covered = dense_centres(x, least, forest.dense)
        cells[dim] = n_cells, x[centres]
        n_cells += len(centres)
        rest = n * (1 - covered.mean()) if len(x) else n
        depth = min(depth, max(0, math.ceil(math.log2(max(1, rest / forest.leaf)))))
        models += [Tree.fit(x[~covered], t, depth, forest) for t in range(forest.trees)]
    sent = vectors.sparkSession.sparkContext.broadcast((models, cells))  # bounded by trees x 2^depth numbers, sample / dense centres
    wide = 2 * least * least - 1 - 1e-9 if least > 0 else -2.0  # cosine of twice the angle

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, dense = sent.value
        for b in batches:
            vec = b.column(0).to_pylist()
            lengths = np.array([len(v) // int(size) for v in vec])
            for dim in sorted(set(lengths.tolist())):
                at = np.flatnonzero(lengths == dim)
                x = unit_rows([vec[i] for i in at], kind)
                mine: list[list[int]] = [[] for _ in at]
                near: list[list[int]] = [[] for _ in at]
                own = np.full(len(at), -1)
                first, centres = dense[dim]
                for s in range(0, len(at) if len(centres) else 0, 1024):
                    c = x[s:s + 1024] @ centres.T
                    own[s:s + 1024] = np.where(c.max(axis=1) >= least, first + c.argmax(axis=1), -1)
                    for i, k in zip(*np.nonzero(c >= wide)):
                        if first + k != own[s + i]:
                            near[s + i].append(first + k)
                rest = np.flatnonzero(own < 0)
                for m in trees:
                    if m.dim == dim:
                        for k, who in m.leaves(x[rest]):
                            for i in rest[who]:
                                mine[i].append((m.tree << 48) | (k << 24))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), dim), pa.int32()), *(c.take(take) for c in b.columns), pa.array(mine, pa.list_(pa.int64())),
                     pa.array(own, pa.int64()), pa.array(near, pa.list_(pa.int64()))], ["dim", *b.schema.names, "member", "own", "near"])

    routes = points.select("vec", "h", "node", "w").mapInArrow(
        dealt, "dim int, vec binary, h bigint, node bigint, w bigint, member array<bigint>, own bigint, near array<bigint>")
    routes = written(routes, "vector-routes")
    shape = "node bigint, h bigint, links bigint, head bigint"
    flat = routes.select(F.explode("member").alias("leaf"), "dim", "h", "node", "vec")
    big = flat.groupBy("leaf", "dim").count().where(F.col("count") > 2 * forest.leaf).select("leaf", "dim").collect()
    in_trees = routes.where("own < 0")
    if big:  # at most trees x 2^depth
        big = F.broadcast(vectors.sparkSession.createDataFrame(big, "leaf bigint, dim int"))
        cut = flat.join(big, ["leaf", "dim"]).groupBy("leaf", "dim").applyInPandas(
            lambda pdf: final_leaves(pdf, forest, kind), "node bigint, h bigint, leaf bigint")
        final = flat.join(big, ["leaf", "dim"], "left_anti").select("node", "h", "leaf").unionByName(cut)
        final = final.groupBy("node", "h").agg(F.sort_array(F.collect_list("leaf")).alias("member"))  # a point's own leaves
        in_trees = written(in_trees.drop("member").join(final, ["node", "h"]), "vector-leaves")
    groups = in_trees.select(F.explode("member").alias("leaf"), "dim", "vec", "h", "node", "w", "member")
    found = groups.groupBy("leaf", "dim").applyInPandas(lambda pdf: compare_leaf(pdf, least, kind), shape)
    if n_cells:
        dense = cell_tasks(routes, 2 * forest.leaf).groupBy("cell", "x", "y")
        found = found.unionByName(dense.applyInPandas(lambda pdf: compare_cell(pdf, least, kind), shape))
    found = written(found, "vector-links")
    rep = points.select(F.col("vec").alias("pv"), F.col("h").alias("ph"), "node")
    named = written(ok.join(rep, (F.col("h") == F.col("ph")) & (F.col("vec") == F.col("pv"))).select("id", "h", "node"), "vector-classes")
    # an id with several vectors ties their points together
    many = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id")
    ties = named.join(many, "id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    comp = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(ties))
    links = found.groupBy("node", "h").agg(F.sum("links").alias("links"))
    per = (points.drop("vec").join(links, ["node", "h"], "left").join(comp, F.col("node") == F.col("id"), "left")
           .select("h", "node", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    linked_rows = named.join(per, ["h", "node"]).select(
        "id", (F.col("links") + F.col("w") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (linked_rows.unionByName(rest)
            .select(F.col("id").cast(id_kind).alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))


def oracle(least: float = 0.95) -> str:
    """DuckDB SQL for :func:`near_duplicates` over the table embeddings with distinct ids:
    all pairs, which the forest equals where one leaf holds the table."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      AND list_cosine_similarity(a.v, b.v) >= {least}),
r(id, comp) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.comp),
c AS (SELECT id, min(comp) AS component_id FROM r GROUP BY id),
k AS (SELECT x, CAST(count(*) AS BIGINT) AS n_links FROM l GROUP BY x)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN k ON k.x = c.id
"""
