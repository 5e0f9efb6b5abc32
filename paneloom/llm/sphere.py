"""Embedding near-duplicates by spherical-cap filters.

A vector of dimension d is normalised, turned by a fixed random rotation, so that both halves carry
like energy whatever the vectors are, and cut into two halves; each half has a random code of unit
directions, and a filter is one direction of each half. Each vector is list-decoded to all filters
whose inner product with it reaches its threshold, by the halves' sorted inner products; the
threshold is its own `filters`-th greatest inner product (a threshold that is the same for all would
give some vectors none and others thousands). Vectors that meet in a filter are compared by their
cosine in double precision; a pair counts in the least filter that both have, and so counts once.

The codes grow with the number of vectors, so that a filter holds about as many of unrelated vectors
whatever the size of the table (up to MOST_CODE), and `filters` is the least number with which, for
the code and dimension at hand, RECALL of random pairs of exactly the wanted cosine meet.

Vectors that are equal take part once, with their number. A filter's bucket with more than BUCKET
vectors is cut into chunks by a hash, and each pair of chunks is a task of bounded size; nothing is
left out. Null vectors, zero vectors and those with null or non-finite components link with nothing;
vectors of different lengths don't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.graph import components
from paneloom.llm.shared import by_value, cut, drop_cut, small_batches

by_value(__name__)

SEED, CODE, BUCKET = 42, 512, 1000
#: Directions of a half at most; filters of unrelated vectors that the codes are sized for; the share of pairs at the bound that meet.
MOST_CODE, IN_A_FILTER, RECALL = 1 << 15, 100, 0.985


def code_size(vectors: int) -> int:
    """Directions of a half: twice as many whenever filters would hold too many of so many vectors."""
    code = CODE
    while code < MOST_CODE and 32 * vectors > IN_A_FILTER * code * code:
        code *= 2
    return code


def code_of(dim: int, code: int = CODE) -> list[np.ndarray]:
    """Directions of the two halves, a row each; one half for a single dimension.

    The halves are of the rotated vector. The rotation is part of the directions, which therefore
    take the whole vector as it is. A half of one dimension has two directions only.
    """
    rng = np.random.default_rng([SEED, dim])
    cuts = [0, dim // 2, dim] if dim > 1 else [0, 1]
    turn, out = np.linalg.qr(rng.standard_normal((dim, dim)))[0], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        c = rng.standard_normal((code, b - a)) if b - a > 1 else np.array([[-1.0], [1.0]])
        out.append((c / np.linalg.norm(c, axis=1, keepdims=True)) @ turn[:, a:b].T)
    return out


def pairs_at(cosine: float, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors with that cosine."""
    a, b = np.random.default_rng([SEED, dim, n]).standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    return a, cosine * a + (1 - cosine * cosine) ** 0.5 * b


def filters_for(halves: list[np.ndarray], cosine: float, recall: float = RECALL, n: int = 600) -> int:
    """The least number of filters, by steps of a fifth from 16, with which so many of n random pairs meet."""
    a, b = pairs_at(cosine, halves[0].shape[1], n)
    filters = 16
    while True:
        met = sum(not set(x.tolist()).isdisjoint(y.tolist()) for x, y in zip(decode(a, halves, filters), decode(b, halves, filters), strict=True))
        if met >= recall * n or filters >= 4096:
            return filters
        filters = filters * 6 // 5 + 1


def _greatest(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest of each row, in falling order."""
    if scores.shape[1] > 4 * n:
        part = np.argpartition(-scores, n, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def decode(unit: np.ndarray, halves: list[np.ndarray], filters: int) -> list[np.ndarray]:
    """The filters of each row; some rows at a time, as large codes have many inner products a row."""
    step = max(1, (1 << 22) // len(halves[0]))
    return [f for at in range(0, len(unit), step) for f in _decode(unit[at : at + step], halves, filters)]


def _decode(unit: np.ndarray, halves: list[np.ndarray], filters: int) -> list[np.ndarray]:
    """For each row the filters that exceed its threshold: the `filters`-th greatest inner product, and all equal to it.

    Directions are sorted within each half; the pair of ranks (i, j) can be among the greatest n only if
    (i + 1) * (j + 1) <= n, so few pairs are looked at. Where a pair just outside equals the threshold,
    all pairs of the row are.
    """
    code = len(halves[-1])
    scores = [unit @ c.T for c in halves]
    if len(scores) == 1:
        scores.append(np.zeros((len(unit), 1)))
    tops = [_greatest(s, filters + 1) for s in scores]
    best = [np.take_along_axis(s, t, axis=1) for s, t in zip(scores, tops, strict=True)]
    wide, high = (t.shape[1] for t in tops)
    i, j = np.array([(x, y) for x in range(wide) for y in range(high) if (x + 1) * (y + 1) <= filters]).T
    sums = best[0][:, i] + best[1][:, j]
    names = tops[0][:, i] * code + tops[1][:, j]
    least = -np.sort(-sums, axis=1)[:, min(filters, sums.shape[1]) - 1]
    chosen = [n[s >= t] for n, s, t in zip(names, sums, least, strict=True)]
    edge = np.array([(x, filters // (x + 1)) for x in range(wide) if filters // (x + 1) < high], dtype=np.int64).reshape(-1, 2)
    tied = (best[0][:, edge[:, 0]] + best[1][:, edge[:, 1]] >= least[:, None]).any(axis=1)
    for row in np.flatnonzero(tied):
        x, y = np.nonzero(scores[0][row][:, None] + scores[1][row] >= least[row])
        chosen[row] = x * code + y
    return chosen


def _prepared(vectors: DataFrame, code: int, cosine: float) -> DataFrame:
    """(node, n, v, filters): distinct usable vectors, of length one."""

    def run(batches):
        known: dict[int, tuple] = {}
        for b in batches:
            rows = [(i, n, np.array(v, dtype=np.float64)) for i, n, v in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True)]
            out = []
            for dim in {len(r[2]) for r in rows}:
                if dim not in known:
                    halves = code_of(dim, code)
                    known[dim] = halves, filters_for(halves, cosine)
                part = [r for r in rows if len(r[2]) == dim]
                x = np.stack([r[2] for r in part])
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for r, u, f in zip(part, unit, decode(unit, *known[dim]), strict=True):
                    out.append((r[0], r[1], u, np.unique(f)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64())), pa.array([o[3] for o in out], pa.list_(pa.int64()))], ["node", "n", "v", "filters"])

    return vectors.mapInArrow(run, "node long, n long, v array<double>, filters array<long>")


def _buckets(batches: Iterator) -> Iterator[tuple[tuple, list]]:
    """Batches sorted by (filter, low, high) -> groups as lists of table slices; a group holds two chunks at most."""
    at, held = None, []
    for b in batches:
        keys = np.stack([b.column(k).to_numpy() for k in range(3)])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            if s == e:
                continue
            key = tuple(keys[:, s].tolist())
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append(b.slice(s, e - s))
    if held:
        yield at, held


def _lesser(left: list[np.ndarray], right: list[np.ndarray], name: int) -> np.ndarray:
    """Whether rows of the two sides share a filter below `name`: a product of their incidence matrices, some filters at a time."""
    own = [[f[f < name] for f in side] for side in (left, right)]
    flat = [np.concatenate(side) if side else np.zeros(0, dtype=np.int64) for side in own]
    names = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), dtype=bool)
    rows = [np.repeat(np.arange(len(side)), [len(f) for f in side]) for side in own]
    for at in range(0, len(names), 512):
        some = names[at : at + 512]
        sides = []
        for side, f, r in zip(own, flat, rows, strict=True):
            place = np.minimum(np.searchsorted(some, f), len(some) - 1)
            there = some[place] == f
            m = np.zeros((len(side), len(some)), dtype=np.float32)
            m[r[there], place[there]] = 1
            sides.append(m)
        out |= sides[0] @ sides[1].T > 0
    return out


def _stars(met: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row and each column reaches through pairs that met."""
    a, b, none = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        x = np.minimum(a, np.where(met, b[None, :], none).min(axis=1))
        y = np.minimum(b, np.where(met, x[:, None], none).min(axis=0))
        if (x == a).all() and (y == b).all():
            return a, b
        a, b = x, y


def compared(name: int, left: tuple, right: tuple | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(node, least node reached, vectors linked) of the rows that a filter links; sides are (nodes, numbers, vectors, filters), one side if a chunk meets itself.

    Only pairs whose least common filter is this one count.
    """
    nodes, n, x, filters = left
    other = left if right is None else right
    met = x @ other[2].T >= cosine
    if right is None:
        np.fill_diagonal(met, False)
    i, j = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
    if not len(i):
        return None
    met = met[np.ix_(i, j)] & ~_lesser([filters[k] for k in i], [other[3][k] for k in j], name)
    a, b = _stars(met, nodes[i], other[0][j])
    if right is None:  # both sides are the same rows
        out = nodes[i], a, met @ n[j]
    else:
        out = np.concatenate((nodes[i], other[0][j])), np.concatenate((a, b)), np.concatenate((met @ other[1][j], n[i] @ met))
    some = out[2] > 0
    return tuple(c[some] for c in out) if some.any() else None


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, bucket: int = BUCKET) -> DataFrame:
    """(id, n_links, component): one row per row of vectors; rows of one id and one vector count each."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    rows = cut(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    classes = cut(rows.where("usable").groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).where("node is not null"), "classes")
    table = cut(_prepared(classes.select("node", "n", "v"), code_size(classes.count()), cosine), "caps")
    sizes = table.select(F.explode("filters").alias("filter")).groupBy("filter").count().where("count > 1")
    spread = table.select("node", "n", "v", "filters", F.explode("filters").alias("filter")).join(sizes, "filter")
    chunks = F.ceil(F.col("count") / bucket).cast("int")
    own = F.pmod(F.hash("node"), F.col("chunks"))
    placed = spread.withColumn("chunks", chunks).withColumn("own", own).select("filter", "own", "node", "n", "v", "filters", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = placed.select("filter", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "v", "filters")
    ordered = dealt.repartition("filter", "low", "high").sortWithinPartitions("filter", "low", "high")

    def run(batches):
        for (name, low, high), held in _buckets(batches):
            part = pa.Table.from_batches(held).combine_chunks()
            own, node, n = (part.column(k).to_numpy() for k in (3, 4, 5))
            lists = [part.column(k).combine_chunks() for k in (6, 7)]
            flat, ends = zip(*[(c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()], c.offsets.to_numpy() - c.offsets[0].as_py()) for c in lists], strict=True)
            dims = np.diff(ends[0])
            for dim in np.unique(dims).tolist():
                sides = []
                for chunk in (low, high) if low != high else (low,):
                    at = np.flatnonzero((dims == dim) & (own == chunk))
                    sides.append((node[at], n[at], flat[0][ends[0][at][:, None] + np.arange(dim)], [flat[1][ends[1][k] : ends[1][k + 1]] for k in at]))
                if min(len(x[0]) for x in sides) and (got := compared(name, sides[0], sides[1] if low != high else None, cosine)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["a", "b", "n"])

    found = cut(ordered.mapInArrow(run, "a long, b long, n long"), "links")
    drop_cut(table)
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    joined = components(found.where("a <> b").select("a", "b"))
    known = cut(classes.join(counted, "node", "left").join(joined, "node", "left").select(F.col("v").alias("kv"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "known")
    drop_cut(classes, found)
    return rows.join(known, F.col("usable") & (F.col("v") == F.col("kv")), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
