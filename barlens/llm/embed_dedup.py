"""Near-duplicate vectors: tiled comparison in principal order with early stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barlens.llm.common import components, cut, table, written

THRESHOLD = 0.9
#: Vectors per strip (a task compares two strips) and per tile within it; memory of a task is bounded by them.
STRIP, TILE = 8192, 1024
#: Leading dimensions are accumulated until this share of the squared length is left, then until the next one.
LEFT = (0.62, 0.3)
#: Slack of the bounds for rounding; the final cosine is compared without any.
EPS = 1e-9


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length in double precision, short ones padded with zeros, and their lengths before padding."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == d).all():
        x = flat.reshape(-1, d).copy()
    else:
        x, at = np.zeros((len(sizes), d)), 0
        for i, n in enumerate(sizes):
            x[i, :n] = flat[at:at + n]
            at += n
    if len(x):
        x /= np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x, sizes.astype(np.int64)


def _moments(d: int):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((d, d))
        for b in batches:
            x, _ = _matrix(b.column(0), d)
            s += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int32()), pa.array(s.ravel())], names=["i", "s"])
    return total


def _pack(d: int, axes: np.ndarray):
    """A partition in principal order becomes rows of TILE vectors: ids, weights, lengths, unit vectors, bounds on the axes."""
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, tile, kept, n = TaskContext.get().partitionId(), 0, [], 0

        def out(rows):
            nonlocal tile
            t = pa.Table.from_batches(rows).combine_chunks()
            x, sizes = _matrix(t.column("e").chunk(0), d)
            y = x @ axes
            order = np.argsort(-y[:, 0], kind="stable")
            row = (strip, tile, len(x), t.column("at").to_numpy()[order].tobytes(), t.column("n").to_numpy()[order].tobytes(),
                   sizes[order].tobytes(), x[order].tobytes(), y.min(axis=0).tolist(), y.max(axis=0).tolist())
            tile += 1
            kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              names=["strip", "tile", "m", "ids", "ns", "sizes", "x", "lo", "hi"])

        for b in batches:
            while b.num_rows:
                take = min(TILE - n, b.num_rows)
                kept.append(b.slice(0, take))
                b, n = b.slice(take), n + take
                if n == TILE:
                    yield out(kept)
                    kept, n = [], 0
        if n:
            yield out(kept)
    return tiles


def _spans(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows p of tile a and rows q of tile b as (node, least node it is linked with here): no more rows than vectors."""
    nodes, at = np.unique(np.concatenate([a[p], b[q]]), return_inverse=True)
    u, v, label = at[:len(p)], at[len(p):], np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _compare(d: int, axes: np.ndarray, stops: tuple[int, int], threshold: float):
    k, k2 = stops

    def side(t: dict) -> tuple:
        x = np.frombuffer(t["x"]).reshape(-1, d)
        y = x @ axes
        tail = lambda n: np.sqrt(np.maximum((y[:, n:] ** 2).sum(axis=1), 0))
        # leading dimensions plus one that holds the suffix norm: its products are the bound on all the rest
        return (np.frombuffer(t["ids"], np.int64), np.frombuffer(t["ns"], np.int64), np.frombuffer(t["sizes"], np.int64), x, y,
                np.column_stack([y[:, :k], tail(k)]), tail(k2), np.array(t["lo"]), np.array(t["hi"]), tail(k).max())

    def pair(a: tuple, b: tuple, same: bool):
        ids_a, n_a, len_a, x_a, y_a, lead_a, tail_a, lo_a, hi_a, rest_a = a
        ids_b, n_b, len_b, x_b, y_b, lead_b, tail_b, lo_b, hi_b, rest_b = b
        corner = np.maximum.reduce([lo_a[:k] * lo_b[:k], lo_a[:k] * hi_b[:k], hi_a[:k] * lo_b[:k], hi_a[:k] * hi_b[:k]])
        if corner.sum() + rest_a * rest_b < threshold - EPS:
            return None
        p, q = np.nonzero(lead_a @ lead_b.T >= threshold - EPS)
        if same:
            p, q = p[p < q], q[p < q]
        parts = []
        for i in range(0, len(p), 1 << 18):
            pp, qq = p[i:i + (1 << 18)], q[i:i + (1 << 18)]
            some = np.einsum("ij,ij->i", y_a[pp, :k2], y_b[qq, :k2]) + tail_a[pp] * tail_b[qq] >= threshold - EPS
            pp, qq = pp[some], qq[some]
            hit = (np.einsum("ij,ij->i", x_a[pp], x_b[qq]) >= threshold) & (len_a[pp] == len_b[qq])
            parts.append((pp[hit], qq[hit]))
        p = np.concatenate([x for x, _ in parts]) if parts else p
        q = np.concatenate([x for _, x in parts]) if parts else q
        if not len(p):
            return None
        node, root = _spans(p, q, ids_a, ids_b)
        links = np.bincount(np.searchsorted(node, ids_a[p]), n_b[q], len(node)) + np.bincount(np.searchsorted(node, ids_b[q]), n_a[p], len(node))
        return node, root, links.astype(np.int64)

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda t: (t["right"], t["tile"]))
        left, right = [side(t) for t in rows if not t["right"]], [side(t) for t in rows if t["right"]]
        found = []
        for i, a in enumerate(left):
            for j, b in enumerate(right or left[i:]):
                if (x := pair(a, b, not right and j == 0)) is not None:
                    found.append(x)
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("node", "root", "links"), cols)))

    return compare


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, strip: int = STRIP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding), by cosine >= threshold in double precision.

    Equal vectors are one node with a weight, so copies are compared once.  Nodes are rotated to principal axes (an
    orthogonal change, from the second moments of all vectors) and range-partitioned along the first axis into strips; a
    task compares two strips tile by tile.  The leading dimensions come first, with the suffix norm as one more dimension, so
    one matrix product gives the bound; only entries whose bound reaches the threshold go on to the next dimensions, and the
    cosine of the original vectors decides.  Strips, then tiles, whose boxes on the axes cannot reach it are not opened.
    A task returns link counts and a spanning forest of its links, never all pairs.

    A vector that is null, empty, zero or has a null or non-finite component links with nothing; vectors of different length
    do not link.  Rows that share a vec_id with different vectors are vectors of their own, each with its links and component; a null vec_id is not linked.
    An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = (F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("e", lambda x: x != 0))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    keys = [F.xxhash64(F.lit(s), "e").alias(f"k{s}") for s in (1, 2)]
    nodes = written(rows.where("fine").groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("e").alias("e"))
                    .withColumn("at", F.monotonically_increasing_id()), "vectors")
    n, d = nodes.agg(F.count("*"), F.max(F.size("e"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    moments = nodes.select("e").mapInArrow(_moments(d), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    gram = np.zeros(d * d)
    gram[[r.i for r in moments]] = [r.s for r in moments]
    energy, axes = np.linalg.eigh(gram.reshape(d, d))
    energy, axes = np.maximum(energy[::-1], 0) / max(energy.sum(), 1e-300), np.ascontiguousarray(axes[:, ::-1])
    left = 1 - np.cumsum(energy)
    stops = tuple(int(min(d, 1 + np.argmax(left <= x))) for x in LEFT)

    first = [float(v) for v in axes[:, 0]]
    along = F.aggregate(F.zip_with("e", F.array(*[F.lit(v) for v in first]), lambda x, v: F.coalesce(x, F.lit(0.0)) * v), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    n_strips = -(-n // strip)
    ordered = nodes.select("at", "n", "e", (along / size).alias("along")).repartitionByRange(n_strips, "along", "at").select("at", "n", "e")
    tiles = written(ordered.mapInArrow(_pack(d, axes), "strip int, tile int, m int, ids binary, ns binary, sizes binary, x binary, lo array<double>, hi array<double>"), "tiles")

    # pairs of strips whose boxes can reach the threshold; one small row per strip
    def box(name, f):
        return F.array(*[f(F.col(name)[i]) for i in range(d)])
    boxes = tiles.groupBy("strip").agg(box("lo", F.min).alias("lo"), box("hi", F.max).alias("hi"))
    boxes = cut(boxes)
    count = tiles.agg(F.max("strip")).first()[0]
    pairs = boxes.withColumn("b", F.explode(F.sequence(F.col("strip"), F.lit(count))))
    pairs = pairs.join(boxes.select(F.col("strip").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "b")
    corner = F.aggregate(F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("lo2", "hi2"), lambda a, b: F.greatest(
        a["lo"] * b["lo2"], a["lo"] * b["hi2"], a["hi"] * b["lo2"], a["hi"] * b["hi2"])), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.where(corner >= threshold - EPS).select(F.col("strip").alias("a"), "b")
    sent = pairs.join(tiles, pairs["a"] == tiles["strip"]).withColumn("right", F.lit(False)).unionByName(
        pairs.where("a <> b").join(tiles, F.col("b") == tiles["strip"]).withColumn("right", F.lit(True)))
    found = sent.select("a", "b", "right", "tile", "ids", "ns", "sizes", "x", "lo", "hi").groupBy("a", "b").applyInArrow(
        _compare(d, axes, stops, threshold), "node long, root long, links long")
    found = written(found, "vector-links")
    links = found.groupBy(F.col("node").alias("at")).agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "at", "component": "_c"})
    # components are found over vectors; the least id of their vectors names them
    of = nodes.select("at", "node").join(comps, "at")
    named = of.join(of.groupBy("_c").agg(F.min("node").alias("component")), "_c").select("at", "component")
    members = rows.select("vec_id", "fine", *keys).join(
        nodes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "node", "n", "at"),
        F.col("fine") & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    out = members.join(links, "at", "left").join(named, "at", "left")
    component = F.coalesce("component", "node", "vec_id")
    return out.select("vec_id", F.when(F.col("fine"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embed_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
