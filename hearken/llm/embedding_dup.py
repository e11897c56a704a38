"""Exact cosine neighbours of embeddings by dual traversal of cover trees.

Equal vectors are collapsed first and counted. The rest is cut into cells, level by level: a cell of more than BLOCK
vectors is dealt to the nearest of a few pivots of its own, until all cells fit; every cell has a centre and a covering
radius. The tree of cells is traversed against itself, level by level too: a pair of cells whose balls are too far apart
is never split further, so pairs of blocks are met only below pairs of cells that are close. Each block gets a cover
tree: nested levels of centres whose covering radii halve at least. The trees of two blocks are traversed together: a
pair of nodes is pruned when the distance of their centres exceeds the threshold distance by more than both covering
radii, and taken whole when both radii cannot carry any pair beyond it; what is left ends in pairs of vectors, which single
precision decides outside a margin for its error and double precision inside it. All is exact: links are neither
sampled nor capped.
"""

from __future__ import annotations

import io
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import drop_written, written
from hearken.llm.graph import components

COSINE, BLOCK, LEAF = 0.9, 2048, 8
#: Pivots of a cell at most; blocks of one cell that are read together; vectors that one task deals in one go; levels after
#: which a cell that its pivots do not divide well is divided by hash.
FAN, GROUP, DEAL, MOST_LEVELS = 64, 8, 65536, 16
#: Products of single precision that are held at once.
CHUNK = 1 << 18
_MARGIN = 1e-9


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(u: np.ndarray, v: np.ndarray) -> float:
    dot = math.fsum((u * v).tolist())
    return dot / math.sqrt(math.fsum((u * u).tolist()) * math.fsum((v * v).tolist()))


class CoverTree:
    """Nodes as flat arrays; the points of a node are contiguous in `order`.

    Node t covers order[start[t]:end[t]] within radius[t] of point centre[t]. It splits into parts: its children, or for a
    leaf its points. A part is a node number, a point and a radius; a part of one point has the number -1. Children hold
    points within half of their parent's radius; their own radius is what their points need, so levels without a split
    are left out.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.x32 = x, x.astype(np.float32)
        n = len(x)
        self.order = np.arange(n)
        self.start, self.end, self.centre, self.radius = [], [], [], []
        kids: list[list[int]] = []
        self._node(0, n, 0, kids)
        todo = [0]
        while todo:
            t = todo.pop()
            a, b = self.start[t], self.end[t]
            if b - a <= LEAF or self.radius[t] <= 1e-7:
                continue
            members = self.order[a:b].copy()
            gram, least = self.x32[members] @ self.x32[members].T, 1 - (self.radius[t] / 2) ** 2 / 2
            left, c, at = np.arange(b - a), int(np.flatnonzero(members == self.centre[t])[0]), a
            while len(left):
                near = gram[c, left] >= least
                near |= left == c
                own = members[left[near]]
                self.order[at : at + len(own)] = own
                k = self._node(at, at + len(own), members[c], kids)
                kids[t].append(k)
                if len(own) > 1:
                    todo.append(k)
                at += len(own)
                left = left[~near]
                c = int(left[0]) if len(left) else -1
        sizes = np.array(self.end) - np.array(self.start)
        self.first, numbers, points = [0], [], []
        for t, own in enumerate(kids):
            if own:
                numbers += [k if sizes[k] > 1 else -1 for k in own]
                points += [self.centre[k] for k in own]
            else:
                numbers += [-1] * int(sizes[t])
                points += self.order[self.start[t] : self.end[t]].tolist()
            self.first.append(len(numbers))
        self.numbers, self.points = np.array(numbers), np.array(points)

    def _node(self, a: int, b: int, centre: int, kids: list) -> int:
        self.start.append(a)
        self.end.append(b)
        self.centre.append(int(centre))
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[self.order[a:b]] @ self.x[centre]))).max() if b - a > 1 else 0.0
        self.radius.append(float(far))
        kids.append([])
        return len(self.start) - 1

    def parts(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, points, radii) of what a node splits into."""
        numbers = self.numbers[self.first[t] : self.first[t + 1]]
        return numbers, self.points[self.first[t] : self.first[t + 1]], np.where(numbers >= 0, np.asarray(self.radius)[numbers], 0.0)

    def covered(self, number: int, point: int) -> np.ndarray:
        return self.order[self.start[number] : self.end[number]] if number >= 0 else np.array([point])

    _SAVED = ("order", "start", "end", "centre", "radius", "first", "numbers", "points")

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: np.asarray(getattr(self, k)) for k in self._SAVED})
        return out.getvalue()

    @classmethod
    def opened(cls, x: np.ndarray, saved: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.x, tree.x32 = x, x.astype(np.float32)
        with np.load(io.BytesIO(saved)) as arrays:
            for k in cls._SAVED:
                setattr(tree, k, arrays[k])
        return tree


class Links:
    """What a traversal finds: weights of linked points, and edges of a spanning forest."""

    def __init__(self, n: int):
        self.weight = np.zeros(n)
        self.group = np.arange(n)  # by point, the least point that its edges reach
        self.edges: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Points a[k] and b[k] are linked. Each pair of groups is met once, however many links it has."""
        ga, gb = self.group[a], self.group[b]
        new = np.flatnonzero(ga != gb)
        if not len(new):
            return
        _, first = np.unique(np.minimum(ga[new], gb[new]) * len(self.group) + np.maximum(ga[new], gb[new]), return_index=True)
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while (p := parent.get(i, i)) != i:
                parent[i] = parent.get(p, p)
                i = p
            return i

        for k in new[first].tolist():
            x, y = find(int(ga[k])), find(int(gb[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((int(a[k]), int(b[k])))
        roots = np.arange(len(self.group))
        for i in parent:
            roots[i] = find(i)
        self.group = roots[self.group]


class Traversal:
    """The state of dual_traversal."""

    def __init__(self, left: CoverTree, right: CoverTree, weights: tuple[np.ndarray, np.ndarray], cosine: float):
        self.left, self.right, (self.wl, self.wr), self.cosine = left, right, weights, cosine
        self.same = left is right
        self.shift = 0 if self.same else len(left.x)
        self.out = Links(len(left.x) if self.same else len(left.x) + len(right.x))
        self.error = 1e-6 + 2.4e-7 * left.x.shape[1]  # of a product in single precision

    def points(self, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> None:
        """Links the pairs of points a[k] and b[k] that reach the threshold; g[k] is their product in single precision."""
        linked = g >= self.cosine + self.error
        near = np.flatnonzero(~linked & (g >= self.cosine - self.error))
        for at in range(0, len(near), 1 << 14):
            some = near[at : at + (1 << 14)]
            exact = np.einsum("ij,ij->i", self.left.x[a[some]], self.right.x[b[some]])
            linked[some] = exact >= self.cosine
            for k in np.flatnonzero(np.abs(exact - self.cosine) < _MARGIN).tolist():
                linked[some[k]] = exact_cosine(self.left.x[a[some[k]]], self.right.x[b[some[k]]]) >= self.cosine
        if self.same:
            linked &= a != b
        a, b = a[linked], b[linked]
        if len(a):
            n = len(self.out.weight)
            self.out.weight += np.bincount(a, self.wr[b], n) + np.bincount(b + self.shift, self.wl[a], n)
            self.out.join(a, b + self.shift)

    def crossed(self, p: np.ndarray, q: np.ndarray) -> None:
        """All pairs of the points p and q."""
        rows = max(1, CHUNK // len(q))
        for at in range(0, len(p), rows):
            g = self.left.x32[p[at : at + rows]] @ self.right.x32[q].T
            i, j = np.nonzero(g >= self.cosine - self.error)
            self.points(p[at + i], q[j], g[i, j])

    def whole(self, p: np.ndarray, q: np.ndarray, own: bool) -> None:
        """Links all points p with all points q, which are the same if own."""
        if own:
            self.out.weight[p] += self.wl[p].sum() - self.wl[p]
        else:
            self.out.weight[p] += self.wr[q].sum()
            self.out.weight[q + self.shift] += self.wl[p].sum()
        self.out.join(np.concatenate([p, np.repeat(p[:1], len(q))]), np.concatenate([np.repeat(q[:1], len(p)), q]) + self.shift)

    def run(self) -> Links:
        left, right, same = self.left, self.right, self.same
        reach = math.sqrt(max(0.0, 2 - 2 * self.cosine))
        todo = [(0, 0)]
        while todo:
            s, t = todo.pop()
            (n1, c1, r1), (n2, c2, r2) = left.parts(s), right.parts(t)
            x2, rows = right.x32[c2].T, max(1, CHUNK // len(c2))
            for at in range(0, len(c1), rows):
                m, c, r = n1[at : at + rows], c1[at : at + rows], r1[at : at + rows]
                g = left.x32[c] @ x2
                limit = self.cosine if not (r.any() or r2.any()) else (1 - np.minimum(2.0, reach + r[:, None] + r2[None, :] + _MARGIN) ** 2 / 2).astype(np.float32)
                i, j = np.nonzero(g >= limit - self.error)
                if same and s == t:
                    i, j = i[i + at <= j], j[i + at <= j]
                g = g[i, j].astype(np.float64)
                single = (m[i] < 0) & (n2[j] < 0)
                self.points(c[i[single]], c2[j[single]], g[single])
                for k in np.flatnonzero(~single).tolist():
                    a, b, slack = int(m[i[k]]), int(n2[j[k]]), float(r[i[k]] + r2[j[k]])
                    own = same and a == b
                    far = 2 * float(r[i[k]]) if own else math.sqrt(max(0.0, 2 - 2 * (g[k] - self.error))) + slack
                    if far > reach - _MARGIN and a >= 0 and b >= 0:
                        todo.append((a, b))
                        continue
                    p, q = left.covered(a, c[i[k]]), right.covered(b, c2[j[k]])
                    if far <= reach - _MARGIN:
                        self.whole(p, q, own)
                    else:
                        self.crossed(p, q)
        return self.out


def dual_traversal(left: CoverTree, right: CoverTree, weights: tuple[np.ndarray, np.ndarray], cosine: float = COSINE) -> Links:
    """All pairs of a point of left and another of right with at least this cosine; left may be right itself. Points of
    right are numbered after those of left, unless they are the same."""
    return Traversal(left, right, weights, cosine).run()


# ---- cells ------------------------------------------------------------------------------------------------------


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _as_bytes(batch: pa.RecordBatch, at: int, kind: str) -> pa.Array:
    """A column of lists of numbers as their bytes."""
    lists = batch.column(at)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


def _deal(rows: DataFrame, sizes: DataFrame, level: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the cells below theirs, the nodes of those cells) for rows of cells above BLOCK, each of which gets pivots
    of its own. The rows of a cell go to as many tasks as they need, each of which reads the pivots once."""
    of = rows.join(sizes, "cell").withColumn("h", F.xxhash64("id", F.lit(level)))
    fan = F.least(F.lit(FAN), F.ceil(2 * F.col("n") / BLOCK).cast("int"))
    found = F.struct("h", "id", "raw")
    one = of.groupBy("cell").agg(F.min(found).alias("p"), F.first("n").alias("n"))
    some = of.filter(F.pmod("h", F.col("n")) < 4 * fan).select("cell", found.alias("p"), "n")  # 256 rows of a cell on average at most
    pivots = one.unionByName(some).groupBy("cell").agg(F.sort_array(F.collect_set("p")).alias("p"), F.first("n").alias("n"))
    pivots = written(pivots.select("cell", F.slice("p.raw", 1, fan).alias("raws"), F.ceil(F.col("n") / DEAL).cast("int").alias("tasks")), "pivots")
    side = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("w"), F.aggregate("raws", F.lit(b""), lambda a, x: F.concat(a, x)).alias("raw"))
    dealt = of.select("cell", F.pmod("h", F.ceil(F.col("n") / DEAL)).cast("int").alias("task"), F.lit(1).alias("part"), "id", "w", "raw").unionByName(side)
    dealt = dealt.repartition("cell", "task").sortWithinPartitions("cell", "task", "part")
    by_hash = level >= MOST_LEVELS

    def run(batches):
        pivots = None
        for batch in batches:
            cells, parts, ids, raws = (batch.column(i).to_pylist() for i in (0, 2, 3, 5))
            heads = [i for i, p in enumerate(parts) if p == 0]
            for a, b in zip([0, *heads], [*heads, len(parts)], strict=True):
                if a < b and parts[a] == 0:
                    dims = int(cells[a].split(".")[0])
                    pivots, a = unit(np.frombuffer(raws[a], kind).reshape(-1, dims)), a + 1
                if a == b:
                    continue
                g = unit(_matrix(raws[a:b], kind)) @ pivots.T
                k = np.array(ids[a:b]) % len(pivots) if by_hash else g.argmax(axis=1)
                far = np.sqrt(np.maximum(0.0, 2 - 2 * (g[:, 0] if by_hash else g[np.arange(b - a), k])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{c}.{i}" for c, i in zip(cells[a:b], k.tolist(), strict=True)]), pa.array(cells[a:b]), pa.array(far), *(batch.column(i).slice(a, b - a) for i in (3, 4, 5))],
                    names=["cell", "parent", "far", "id", "w", "raw"],
                )

    below = written(dealt.mapInArrow(run, "cell string, parent string, far double, id long, w long, raw binary"), "cells")

    def centres(batches):
        for batch in batches:
            for cell, raws in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                x = unit(_matrix(raws, kind))
                yield pa.RecordBatch.from_pydict({"cell": [f"{cell}.{i}" for i in range(len(x))], "centre": x[[0] * len(x)].tolist() if by_hash else x.tolist()})

    balls = below.groupBy("cell", "parent").agg(F.max("far").alias("radius"))
    nodes = written(balls.join(pivots.select("cell", "raws").mapInArrow(centres, "cell string, centre array<double>"), "cell"), "nodes")
    drop_written(pivots)
    return below.select("cell", "id", "w", "raw"), nodes


def _cells(vectors: DataFrame, kind: str) -> tuple[DataFrame, list[DataFrame]]:
    """(rows by their final cell, the nodes of each level) of a table (cell, id, w, raw)."""
    done, levels, rows = [], [], vectors
    while True:
        sizes = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
        large = sizes.filter(F.col("n") > BLOCK)
        done.append(rows.join(sizes.filter(F.col("n") <= BLOCK), "cell", "left_semi"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done), levels
        rows, nodes = _deal(rows, large, len(levels), kind)
        levels.append(nodes)


def _close(rows: DataFrame, reach: float) -> DataFrame:
    apart = F.sqrt(F.aggregate(F.zip_with("ci", "cj", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return rows.filter((F.col("i") == F.col("j")) | F.col("ci").isNull() | F.col("cj").isNull() | (apart <= F.col("ri") + F.col("rj") + reach + 1e-6))


def _block_pairs(roots: DataFrame, levels: list[DataFrame], reach: float) -> DataFrame:
    """(i, j) of the final cells that may hold linked vectors, by descending the tree of cells against itself."""
    none = lambda kind: F.lit(None).cast(kind)
    pairs = roots.select(F.col("cell").alias("i"), none("array<double>").alias("ci"), none("double").alias("ri"), F.col("cell").alias("j"), none("array<double>").alias("cj"), none("double").alias("rj"))
    for nodes in levels:
        below = lambda k: nodes.select(F.col("parent").alias(k), F.col("cell").alias(f"b{k}"), F.col("centre").alias(f"bc{k}"), F.col("radius").alias(f"br{k}"))  # noqa: B023, E731
        split = pairs.join(below("i"), "i", "left").join(below("j"), "j", "left")
        split = split.filter((F.col("i") != F.col("j")) | F.col("bi").isNull() | (F.col("bi") <= F.col("bj")))
        take = lambda k: [F.coalesce(f"b{k}", k).alias(k), F.coalesce(f"bc{k}", f"c{k}").alias(f"c{k}"), F.coalesce(f"br{k}", f"r{k}").alias(f"r{k}")]
        pairs = written(_close(split.select(*take("i"), *take("j")), reach), "cell_pairs")
    return pairs.select("i", "j")


def _group(cell) -> F.Column:
    """The name of the few blocks that are read with this one: those of the same parent, GROUP at a time."""
    parent = F.regexp_replace(cell, r"\.[0-9]+$", "")
    return F.when(cell.contains("."), F.concat_ws("/", parent, F.floor(F.substring_index(cell, ".", -1).cast("int") / GROUP).cast("string"))).otherwise(cell)


def _links(vectors: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(id, other, w): rows with a null other hold weights linked to id, the rest are edges."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + _MARGIN
    rows, levels = _cells(vectors, kind)

    def gathered(pdf):
        import pandas as pd

        raw = b"".join(pdf["raw"])
        x = unit(np.frombuffer(raw, kind).reshape(len(pdf), -1))
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "weights": [pdf["w"].to_numpy(np.float64).tobytes()], "raw": [raw], "tree": [CoverTree(x).saved()]})

    blocks = written(rows.select("cell", "id", "w", "raw").groupBy("cell").applyInPandas(gathered, "cell string, ids binary, weights binary, raw binary, tree binary"), "blocks")
    pairs = _block_pairs(vectors.select("cell").distinct(), levels, reach)
    gi, gj = _group(F.col("i")), _group(F.col("j"))
    pairs = written(pairs.select(F.concat_ws("|", F.least(gi, gj), F.greatest(gi, gj)).alias("to"), "i", "j"), "block_pairs")
    tasks = pairs.agg(F.count_distinct("to")).first()[0]
    needed = pairs.select("to", F.explode(F.array("i", "j")).alias("cell")).distinct().join(blocks, "cell")
    empty = F.lit(None)
    both = needed.select("to", F.lit(0).alias("part"), F.col("cell").alias("i"), empty.cast("string").alias("j"), "ids", "weights", "raw", "tree")
    both = both.unionByName(pairs.select("to", F.lit(1).alias("part"), "i", "j", *[empty.cast("binary").alias(c) for c in ("ids", "weights", "raw", "tree")]))
    # a row here is a task's work: dealt by number, so that it is not merged again by its size
    both = both.repartition(max(1, min(8192, tasks)), "to").sortWithinPartitions("to", "part")

    def traverse(batches):
        of, held = None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                to, part, i, j = (batch.column(k)[at].as_py() for k in range(4))
                if to != of:
                    of, held = to, {}
                if part == 0:
                    ids, w, raw, tree = (batch.column(k)[at].as_py() for k in range(4, 8))
                    ids = np.frombuffer(ids, np.int64)
                    held[i] = ids, np.frombuffer(w, np.float64), CoverTree.opened(unit(np.frombuffer(raw, kind).reshape(len(ids), -1)), tree)
                    continue
                (ids, w, left), (more, w2, right) = held[i], held[j]
                out = dual_traversal(left, right, (w, w2), cosine)
                if i != j:
                    ids = np.concatenate([ids, more])
                hit = np.flatnonzero(out.weight)
                edges = np.array(out.edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[hit], ids[edges[:, 0]]]), pa.int64()),
                        pa.array([None] * len(hit) + ids[edges[:, 1]].tolist(), pa.int64()),
                        pa.array(np.concatenate([out.weight[hit], np.zeros(len(edges))]), pa.float64()),
                    ],
                    names=["id", "other", "w"],
                )

    return both.mapInArrow(traverse, "id long, other long, w double")


def linked_vectors(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding).

    Rows whose vector is null, empty, zero, or holds a null or a number that is not finite, and rows without an id, link
    with nothing: n_links 0, their own component, kept. Vectors of different lengths do not link. Repeated rows count
    as vectors of their own.
    """
    kind = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    sound = rows.filter(F.coalesce(good, F.lit(False)))

    def to_bytes(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), _as_bytes(batch, 3, kind)], names=["cell", "id", "w", "raw"])

    # each vector once, under the smallest of its ids
    groups = written(sound.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")), "vectors")
    roots = groups.select(F.size("embedding").cast("string").alias("cell"), "id", "w", "embedding")
    found = written(_links(written(roots.mapInArrow(to_bytes, "cell string, id long, w long, raw binary"), "roots"), kind, cosine), "links")
    weight = found.filter("other is null").groupBy("id").agg(F.sum("w").alias("linked"))
    group = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per = groups.join(weight, "id", "left").join(group, "id", "left")
    per = per.select("embedding", (F.coalesce("linked", F.lit(0.0)).cast("long") + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = sound.join(per, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
