"""Near-duplicate vectors by cosine: PCA-ordered, tiled comparison that stops early.

All unit vectors are turned so that the dimensions with most of their weight come first. A cell of a grid over the
first CELLS of these, as wide as two vectors at the threshold can be apart, is cut into tiles of about TILE vectors; cells
of few vectors share a tile. Two tiles are compared if their bounding boxes in the first LEAD dimensions are near
enough to hold a pair. In a pair of tiles the products of leading dimensions are summed first: what the rest can add is
at most the product of both suffix norms (Cauchy-Schwarz), and pairs that cannot reach the threshold any more are left.
Nothing is lost: cells, boxes and bounds only leave out what cannot link.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .simhash import components

TILE = 1024
CELLS, LEAD = 4, 8
_SLACK = 1e-9  # rounding of sums of products of unit vectors
_DENSE = 0.02  # share of pairs still open below which they are summed one by one
_FIRST = 8  # dimensions of the first step; each step then doubles what is summed


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first scaled by their largest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(nodes: DataFrame) -> tuple[int, np.ndarray | None]:
    """The commonest number of dimensions of nodes (e), and the axes that hold most of those vectors' weight, in order.

    Each unit vector is given with its opposite, so that the mean is zero and weight counts from the origin. Spark sums
    the products over all rows; the driver gets one square matrix of the dimensions.
    """
    common = nodes.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return 0, None
    top = F.array_max(F.transform("e", F.abs))
    scaled = F.transform("e", lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x))
    rows = nodes.filter(F.size("e") == common["d"]).withColumn("top", top).withColumn("scaled", scaled).withColumn("norm", norm)
    both = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sign")
    signed = rows.select("scaled", "norm", both).select(array_to_vector(F.transform("scaled", lambda x: x * F.col("sign") / F.col("norm"))).alias("v"))
    axes = PCA(k=common["d"], inputCol="v", outputCol="w").fit(signed).pc.toArray()
    true = np.allclose(axes.T @ axes, np.eye(common["d"]), atol=1e-12)
    return common["d"], axes if true else None


def turned(x: np.ndarray, axes: np.ndarray | None, d: int) -> np.ndarray:
    u = unit(x)
    return u @ axes if axes is not None and u.shape[1] == d else u


def _leading(nodes: DataFrame, axes: np.ndarray | None, d: int) -> DataFrame:
    """nodes with lead, the first LEAD turned coordinates; vectors of fewer dimensions are filled up with zeros."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = batch.column(batch.schema.get_field_index("e"))
        size = e.value_lengths().to_numpy()
        flat, lead = e.flatten().to_numpy(), np.zeros((len(size), LEAD))
        start = np.cumsum(size) - size
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            lead[own, : min(n, LEAD)] = turned(flat[start[own][:, None] + np.arange(n)], axes, d)[:, :LEAD]
        column = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), LEAD).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "lead"])

    return map_batches(nodes, run, "node long, label string, copies long, e array<double>, lead array<double>")


def tiles(led: DataFrame, width: float) -> DataFrame:
    """led with leaf and block, which name its tile, and c1, its first cell.

    A leaf is the largest group of cells, by their first coordinates, that holds at most TILE vectors, or one cell; that is
    dealt to blocks. A label has at most (2 / width + 2) ^ CELLS cells, so the table of cells stays small.
    """
    own = ["label", "d", *(f"c{i + 1}" for i in range(CELLS))]
    placed = led.select("*", F.size("e").alias("d"), *(F.floor(F.get("lead", F.lit(i)) / width).alias(f"c{i + 1}") for i in range(CELLS)))
    cells = materialize(placed.groupBy(*own).agg(F.count("*").alias("n")).withColumn("cell", F.monotonically_increasing_id()), "vectors-cells")
    held, leaf = F.col("n"), F.col("cell")  # of a cell alone
    for depth in reversed(range(CELLS)):
        above = Window.partitionBy(*own[: 2 + depth])
        fits = F.sum("n").over(above) <= TILE
        held, leaf = F.when(fits, F.sum("n").over(above)).otherwise(held), F.when(fits, F.min("cell").over(above)).otherwise(leaf)
    named = cells.select(*own, leaf.alias("leaf"), F.ceil(held / TILE).alias("blocks"))
    return placed.join(named, own).withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("blocks", *own[3:])


def near_tiles(dealt: DataFrame, width: float) -> DataFrame:
    """leaf, block, leaf2, block2, pair: tiles (each with itself and later ones) whose boxes may hold a pair this near."""
    at = lambda f, i: f(F.get("lead", F.lit(i)))
    boxes = dealt.groupBy("label", "d", "leaf", "block").agg(
        F.array(*(at(F.min, i) for i in range(LEAD))).alias("low"), F.array(*(at(F.max, i) for i in range(LEAD))).alias("high"), F.min("c1").alias("from"), F.max("c1").alias("to")
    )
    boxes = materialize(boxes, "vectors-tiles")
    left = boxes.select("*", F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("c"))
    right = boxes.select("label", "d", *(F.col(x).alias(f"{x}2") for x in ("leaf", "block", "low", "high")), F.explode(F.sequence("from", "to")).alias("c"))
    gaps = (F.greatest(F.lit(0.0), F.get("low2", F.lit(i)) - F.get("high", F.lit(i)), F.get("low", F.lit(i)) - F.get("high2", F.lit(i))) for i in range(LEAD))
    apart = reduce(lambda a, b: a + b, (g * g for g in gaps))
    later = (F.col("leaf2") > F.col("leaf")) | ((F.col("leaf2") == F.col("leaf")) & (F.col("block2") >= F.col("block")))
    found = left.join(right, ["label", "d", "c"]).filter(later & (apart <= width * width + _SLACK))
    return materialize(found.select("leaf", "block", "leaf2", "block2").distinct().withColumn("pair", F.monotonically_increasing_id()), "vectors-pairs")


def _steps(d: int) -> list[tuple[int, int]]:
    out, lo, hi = [], 0, min(_FIRST, d)
    while lo < d:
        out.append((lo, hi))
        lo, hi = hi, min(2 * hi, d)
    return out


def reaching(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, cosine of the pairs of unit rows of a and b that reach the threshold, give or take rounding."""
    least = threshold - _SLACK
    steps = _steps(a.shape[1])
    rest = [(np.sqrt((a[:, hi:] ** 2).sum(axis=1)), np.sqrt((b[:, hi:] ** 2).sum(axis=1))) for _, hi in steps]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)))
    i = j = None
    for (lo, hi), (left, right) in zip(steps, rest):
        if i is None:
            total += a[rows, lo:hi] @ b[cols, lo:hi].T
            open_ = total + np.outer(left[rows], right[cols]) >= least
            many = int(np.count_nonzero(open_))
            if not many:
                return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
            if many < _DENSE * open_.size or hi == a.shape[1]:
                i, j = np.nonzero(open_)
                sums = total[i, j]
                i, j = rows[i], cols[j]
            else:
                r, c = open_.any(axis=1), open_.any(axis=0)
                if r.sum() * c.sum() < open_.size // 2:
                    total, rows, cols = total[np.ix_(r, c)], rows[r], cols[c]
        else:
            sums = sums + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
            keep = sums + left[i] * right[j] >= least
            i, j, sums = i[keep], j[keep], sums[keep]
    return i, j, sums


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Of two vectors, from sums without rounding errors of their own."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def links(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray | None, d: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y whose cosine reaches the threshold; without y, pairs of rows of x, the first before the second."""
    a = turned(x, axes, d)
    b = a if y is None else turned(y, axes, d)
    found = []
    for at in range(0, len(a), 256):  # so the sums of one step stay at 256 x TILE
        i, j, sums = reaching(a[at : at + 256], b, threshold)
        i = i + at
        keep = np.ones(len(i), bool) if y is not None else i < j
        for k in np.flatnonzero(keep & (np.abs(sums - threshold) < 1e-6)):
            keep[k] = cosine(x[i[k]], (x if y is None else y)[j[k]]) >= threshold
        found.append(np.stack([i[keep], j[keep]]))
    i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n reaches by the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings (vec_id, embedding, label, any others).

    Rows link when their labels are equal and not null, their vectors have as many components, and the cosine is
    the threshold or more. Null, empty, zero and non-finite vectors link with nothing. Equal vectors of a label are compared
    once and count for each other; rows that share a vec_id count apart and get a row each. A row without a vec_id has
    its component's least vec_id, null if there is none, and is not kept. An empty table gives none. A component's n
    different vectors are all compared, as the count of links asks for, in tiles of TILE: a label, or a dense cell, of n
    costs n squared / TILE copies of rows, less what boxes leave out.
    """
    width = math.sqrt(2 - 2 * threshold) * (1 + 1e-9)
    e, label = F.col("embedding").cast("array<double>"), F.col("label").cast("string")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), e.alias("e"))
    # two hashes of 64 bits stand for label and vector
    name = [F.when(F.col("label").isNotNull() & usable(F.col("e")), F.xxhash64(F.lit(s), "label", "e")).alias(f"k{s}") for s in (1, 2)]
    keyed = rows.select("*", *name)
    nodes = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.any_value("label").alias("label"), F.any_value("e").alias("e"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    d, axes = rotation(nodes)
    led = _leading(nodes.select("node", "label", "copies", "e"), axes, d)
    dealt = materialize(tiles(led, width), "vectors-dealt")
    pairs = near_tiles(dealt, width)
    row = ["node", "copies", "e"]
    here = dealt.select("leaf", "block", *row).join(pairs, ["leaf", "block"]).select("pair", F.lit(0).alias("side"), *row)
    there = pairs.filter("leaf <> leaf2 or block <> block2").select(F.col("leaf2").alias("leaf"), F.col("block2").alias("block"), "pair")
    both = here.unionByName(dealt.select("leaf", "block", *row).join(there, ["leaf", "block"]).select("pair", F.lit(1).alias("side"), *row))

    def compare(group: pa.Table) -> pa.Table:
        side, node, copies = (group.column(c).to_numpy() for c in ("side", "node", "copies"))
        x = np.concatenate([c.flatten().to_numpy() for c in group.column("e").chunks]).reshape(len(side), -1)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = links(x[one], x[two] if len(two) else None, axes, d, threshold)
        i, j = one[i], (two if len(two) else one)[j]
        n = np.bincount(i, copies[j], len(side)) + np.bincount(j, copies[i], len(side))
        order = np.argsort(node)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = node[order][_roots(len(side), place[i], place[j])][place]
        hit = np.flatnonzero(n)
        return pa.table({"node": pa.array(node[hit]), "n": pa.array(n[hit].astype(np.int64)), "root": pa.array(root[hit])})

    found = materialize(both.groupBy("pair").applyInArrow(compare, "node long, n long, root long"), "vectors-links")
    label_of = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = nodes.select("k1", "k2", "node", "copies", "first").join(total, "node", "left").join(label_of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("first").alias("component"))
    known = known.join(least, "label").select(F.col("k1").alias("own1"), F.col("k2").alias("own2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = keyed.select("vec_id", "k1", "k2").join(known, (F.col("k1") == F.col("own1")) & (F.col("k2") == F.col("own2")), "left")
    component = F.when(F.col("own1").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
