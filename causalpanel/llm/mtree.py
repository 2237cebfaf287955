"""Exact top-k search by inner product with M-trees, best first.

Inner product becomes a metric by one more coordinate: with M the largest norm, x' = (x, sqrt(M^2 -
|x|^2)) and q' = (q, 0) have d(q', x')^2 = |q|^2 + M^2 - 2 q.x, so the nearest x' has the largest
product. Vectors are dealt to the nearest of a bounded number of centres, parts of bounded size; each
part is an M-tree whose pages keep covering radii and distances to their parent's routing object. The
trees are built once and are rows of a table; queries come to them. A query first searches the part
that it lies in; its k-th score then rules out parts by their balls, and nodes and entries by the
triangle inequality, and only what is left is computed, exactly in integers.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Entries in a page, vectors in a part (fewer if they are long: BYTES a part), centres of a family
#: (which bounds what is broadcast).
PAGE, PART, BYTES, MOST_CENTRES = 256, 4096, 1 << 24, 1024
#: Partitions that the parts are dealt to, at most; queries that are held against all balls at once.
MOST_PARTITIONS, TOGETHER = 8192, 512
SCALE = 256
#: Vectors of a squared norm below this have products that fit a long. Others form families by the
#: binary exponent of that square, FAMILY exponents each, and are multiplied in Python's integers.
WIDE, FAMILY = 2.0**61, 32
#: Products whose magnitude is bounded by these are exact in doubles, in longs.
IN_DOUBLE, IN_LONG = 2.0**52, 2.0**62
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
#: Slack on distances, relative: floats only rule out, they never decide.
SLACK = 1e-9
KEYS = ["dim", "family", "centre", "sub"]
FOUND = "_query long, query_id long, vec_id long, score long, _beyond string, _none boolean"


class MTree:
    """A bulk-loaded M-tree over vectors of whole numbers, for the largest inner products."""

    def __init__(self, vectors: np.ndarray):
        """``vectors``: (n, d), whole numbers, as doubles or longs."""
        self.x = vectors.astype(np.float64)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.most = float(self.square.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.most - self.square, 0.0))
        self.longs = vectors.astype(np.int64) if IN_DOUBLE <= self.most < WIDE else None
        #: A node: (is a page, entries' object, entries' distance to the parent, radii, child nodes).
        self.nodes: list[tuple] = []
        self.computed = 0
        self.root = self._build(np.arange(len(vectors)), None)
        # vectors lie in the order of the pages, so that a page is a slice; ``at`` leads back
        self.at = np.concatenate([objects for page, objects, *_ in self.nodes if page])
        self.place = np.argsort(self.at)
        self.x, self.square, self.extra = self.x[self.at], self.square[self.at], self.extra[self.at]
        self.longs = None if self.longs is None else self.longs[self.at]
        self.nodes = [(page, self.place[objects], *rest) for page, objects, *rest in self.nodes]

    def _distances(self, objects: np.ndarray, to: int) -> np.ndarray:
        plain = self.square[objects] + self.square[to] - 2.0 * (self.x[objects] @ self.x[to])
        return np.sqrt(np.maximum(plain + (self.extra[objects] - self.extra[to]) ** 2, 0.0))

    def _build(self, objects: np.ndarray, parent: int | None) -> int:
        here = np.zeros(len(objects)) if parent is None else self._distances(objects, parent)
        if len(objects) <= PAGE:
            self.nodes.append((True, objects, here, None, None))
            return len(self.nodes) - 1
        count = min(PAGE, max(2, math.ceil(len(objects) / (PAGE // 2))))
        centres = objects[np.linspace(0, len(objects) - 1, count).astype(int)]
        near = np.stack([self._distances(objects, int(c)) for c in centres]).argmin(axis=0)
        groups = [objects[near == k] for k in range(count)]
        if max(map(len, groups)) > len(objects) // 2:  # mostly one place: any even split is as tight
            biggest = max(range(count), key=lambda k: len(groups[k]))
            pieces = np.array_split(groups[biggest], max(2, math.ceil(len(groups[biggest]) / PAGE)))
            centres = np.concatenate([np.delete(centres, biggest), np.full(len(pieces), centres[biggest])])
            groups = [*groups[:biggest], *groups[biggest + 1 :], *pieces]
        kept = [k for k, g in enumerate(groups) if len(g)]
        routing = centres[kept]
        radii = np.array([self._distances(groups[k], int(c)).max() for k, c in zip(kept, routing, strict=True)])
        children = [self._build(groups[k], int(c)) for k, c in zip(kept, routing, strict=True)]
        apart = np.zeros(len(routing)) if parent is None else self._distances(routing, parent)
        self.nodes.append((False, routing, apart, radii, children))
        return len(self.nodes) - 1

    def _page_scores(self, query: np.ndarray, bound: float) -> Callable:
        """A function of (rows, objects, floor) -> (objects that may reach the floor, exact scores); rows: a slice or the objects."""
        q = query.astype(np.float64)

        def reaching(some, score, low):
            if low is not None:
                kept = np.flatnonzero(score >= low)
                some, score = some[kept], score[kept]
            return some, score.astype(np.int64).tolist()

        if bound < IN_DOUBLE:
            return lambda rows, some, low: reaching(some, self.x[rows] @ q, low)
        if bound < IN_LONG and self.most < WIDE:
            whole, x = query.astype(np.int64), self.x if self.longs is None else self.longs
            return lambda rows, some, low: reaching(some, x[rows].astype(np.int64) @ whole, low)
        whole, error = [int(c) for c in query.tolist()], bound * len(query) * 2.0**-50

        def wide(rows, some, low):
            if low is not None:
                some = some[self.x[some] @ q + error >= low]
            return some, [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in self.x[some].tolist()]

        return wide

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, skip: int = -1, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, object), ties to the smaller id, none below ``floor``, without ``skip``.

        ``ids`` orders the objects among equal scores. Nodes come in order of the least distance that
        they can hold; an entry is passed over without computing its distance if its stored distance
        to the parent and the query's rule it out.
        """
        q = query.astype(np.float64)
        own = float(q @ q)
        base, scores = own + self.most, self._page_scores(query, math.sqrt(own) * math.sqrt(self.most))
        skip = int(self.place[skip]) if skip >= 0 else skip
        slack = SLACK * (math.sqrt(base) + 1.0) + (1e-6 + math.sqrt(len(q) * 2.0**-48)) * math.sqrt(base)
        found: list[tuple[int, int, int]] = []  # (-score, id, object), the best k in order

        def least_score() -> int | None:
            low = -found[k - 1][0] if len(found) == k else floor
            return low if floor is None or low is None else max(low, floor)

        def reach() -> float:
            low = least_score()
            return math.inf if low is None else math.sqrt(max(base - 2.0 * float(low), 0.0)) + slack

        limit, heap = reach(), [(0.0, self.root, None)]
        while heap:
            least, node, to_parent = heapq.heappop(heap)
            if least > limit:
                break
            page, objects, apart, radii, children = self.nodes[node]
            at = np.arange(len(objects))
            if to_parent is not None:
                at = np.flatnonzero(np.abs(to_parent - apart) - (0.0 if page else radii) <= limit)
            if not len(at):
                continue
            some = objects[at]
            self.computed += len(some)
            if page:
                low = least_score()
                rows = slice(objects[0], objects[-1] + 1) if len(some) == len(objects) else some
                some, score = scores(rows, some, low)
                new = [(-s, int(ids[self.at[o]]), o) for s, o in zip(score, some.tolist(), strict=True) if o != skip and (low is None or s >= low)]
                if new:
                    found = sorted([*found, *new])[:k]
                    limit = reach()
                continue
            far = np.sqrt(np.maximum(base - 2.0 * (self.x[some] @ q), 0.0))
            nearest = np.maximum(far - radii[at], 0.0)
            for j in np.flatnonzero(nearest <= limit).tolist():
                heapq.heappush(heap, (float(nearest[j]), children[at[j]], float(far[j])))
        return [(-s, int(self.at[o])) for s, _, o in found]


def _matrix(column, width: int) -> np.ndarray:
    """(n, width) doubles of a list column, Arrow table or batch."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _trees(d: DataFrame, partitions: int) -> DataFrame:
    """A row per part: its keys, its M-tree with the tags and ids of its vectors."""
    import pyarrow as pa

    def built(table):
        width = table.column("dim")[0].as_py()
        raw = table.column("vec_id").to_pylist()
        tags = table.column("tag").to_pylist()
        order = np.array([MOST_LONG if i is None else i for i in raw], np.int64)
        body = pickle.dumps((MTree(_matrix(table.column("v"), width)), tags, raw, order), protocol=5)
        keys = [table.column(c).slice(0, 1).combine_chunks() for c in KEYS]
        return pa.Table.from_arrays([*keys, pa.array([body], pa.binary())], [*KEYS, "tree"])

    kind = "dim int, family int, centre int, sub int, tree binary"
    return cut(d.repartition(partitions, *KEYS).groupBy(*KEYS).applyInArrow(built, kind))


def _part(dim: int) -> int:
    """Vectors of ``dim`` components in a part."""
    return min(PART, max(PAGE, BYTES // (8 * max(dim, 1))))


def _told(score: int) -> tuple[int, str | None]:
    """A score as a long and, at or beyond the limits of one, a string that sorts as the scores do."""
    if LEAST_LONG < score < MOST_LONG:
        return score, None
    return min(max(score, LEAST_LONG), MOST_LONG), f"{score + (1 << 1100):0340d}"


def _searched(trees: DataFrame, probes: DataFrame, k: int, partitions: int) -> DataFrame:
    """Every probe against the tree of its part: a part's tree comes first, its probes stream after it."""
    import pyarrow as pa

    none = lambda kind: F.lit(None).cast(kind)
    a = trees.select(*KEYS, F.lit(0).alias("kind"), "tree", none("long").alias("tag"), none("long").alias("vec_id"), none("array<double>").alias("v"), none("long").alias("floor"))
    b = probes.select(*KEYS, F.lit(1).alias("kind"), none("binary").alias("tree"), "tag", "vec_id", "v", "floor")
    both = a.unionByName(b).repartition(partitions, *KEYS).sortWithinPartitions(*KEYS, "kind")
    kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
    names = ["_query", "query_id", "vec_id", "score", "_beyond", "_none"]

    def run(batches):
        tree = ids = place = raw = None
        for batch in batches:
            rows = [[] for _ in kinds]
            flat, ends = batch.column("v").values.to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
            values = zip(*(batch.column(c).to_pylist() for c in ("kind", "tag", "vec_id", "floor")), strict=True)
            for n, (kind, tag, own, floor) in enumerate(values):
                if not kind:
                    tree, tags, raw, ids = pickle.loads(batch.column("tree")[n].as_py())
                    place = {t: n for n, t in enumerate(tags)}
                    continue
                for score, o in tree.search(flat[ends[n] : ends[n + 1]], k, ids, place.get(tag, -1), floor):
                    for column, value in zip(rows, (tag, own, raw[o], *_told(score), raw[o] is None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names)

    return both.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("_query").orderBy(F.desc("score"), F.desc_nulls_last("_beyond"), "_none", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best others.

    Components become floor(256 * x), x as a double; the score is their integer inner product, ties
    go to the smaller vec_id (a null id comes last and asks nothing). Null vectors and those with a
    null or non-finite component take no part, all others do: products that could pass a long's
    range are made, and ranked, in Python's integers, and a score beyond that range is shown as the
    range's end. (A double beyond 2^480, which no float reaches, counts as not finite.) Vectors meet
    only those of their own length. Rows that repeat an id are rows of their own. Other columns are
    not read; an empty table gives an empty result.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    ship(spark)
    e = F.col(vector)
    sound = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**480)), F.lit(False))

    def scaled(x):
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole

    d = vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, scaled).alias("v"), F.size(e).alias("dim"), F.monotonically_increasing_id().alias("tag"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    d = cut(d.withColumn("family", F.when(square < WIDE, 0).otherwise(1 + F.floor(F.log2(F.greatest(square, F.lit(1.0))) / FAMILY)).cast("int")))
    counts = {(r["dim"], r["family"]): r["count"] for r in d.groupBy("dim", "family").count().collect()}  # a row per length and family
    centres: dict[tuple[int, int], np.ndarray] = {}
    for (dim, family), n in counts.items():
        wanted = min(MOST_CENTRES, math.ceil(n / _part(dim)))
        drawn = d.where((F.col("dim") == dim) & (F.col("family") == family)).select("v", F.xxhash64("tag", "vec_id").alias("h")).orderBy("h").limit(wanted).collect()
        centres[dim, family] = np.array([r["v"] for r in drawn], np.float64).reshape(wanted, dim)

    def near(batches):
        for batch in batches:
            best, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            group = np.stack([batch.column(c).to_numpy() for c in ("dim", "family")], axis=1)
            for dim, family in np.unique(group, axis=0).tolist():
                rows = np.flatnonzero((group == (dim, family)).all(axis=1))
                c = centres[dim, family]
                for some in np.array_split(rows, -(-len(rows) // TOGETHER)):
                    x = _matrix(batch.column("v").take(pa.array(some)), dim)
                    square = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * x @ c.T
                    best[some] = square.argmin(1)
                    far[some] = np.linalg.norm(x - c[best[some]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(far)], [*batch.schema.names, "centre", "far"])

    d = cut(d.mapInArrow(near, "vec_id long, v array<double>, dim int, tag long, family int, centre int, far double"))
    balls = {(r["dim"], r["family"], r["centre"]): (r["n"], r["far"]) for r in d.groupBy("dim", "family", "centre").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    subs = {key: math.ceil(n / _part(key[0])) for key, (n, _) in balls.items()}
    partitions = min(MOST_PARTITIONS, max(1, sum(subs.values())))
    cuts = [F.lit(x) for key, s in subs.items() if s > 1 for x in (":".join(map(str, key)), s)]
    sub_count = F.coalesce(F.try_element_at(F.create_map(*cuts), F.concat_ws(":", "dim", "family", "centre")), F.lit(1)) if cuts else F.lit(1)
    d = d.withColumn("sub", F.pmod(F.xxhash64("tag"), sub_count).cast("int"))
    trees = _trees(d, partitions)
    queries = d.where(F.col("vec_id") % every == 0).select(*KEYS, "tag", "vec_id", "v")
    first = cut(_searched(trees, queries.withColumn("floor", F.lit(None).cast("long")), k, partitions))
    floors = first.groupBy("_query").agg(F.count("*").alias("_n"), F.min("score").alias("floor"))
    known = (F.col("_n") >= k) & (F.col("floor") > LEAST_LONG)
    floors = floors.select(F.col("_query").alias("tag"), F.when(known, F.col("floor")).alias("floor"))
    asked = queries.join(floors, "tag", "left")
    by_length: dict[int, list[tuple[int, int]]] = {}
    for dim, family, centre in sorted(balls):
        by_length.setdefault(dim, []).append((family, centre))

    def probing(batches):
        names = ["dim", "family", "centre", "sub", "tag", "vec_id", "v", "floor"]
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                dims = part.column("dim").to_numpy()
                home = list(zip(*(part.column(c).to_pylist() for c in ("family", "centre", "sub")), strict=True))
                floor = np.array([-math.inf if f is None else f for f in part.column("floor").to_pylist()], float)
                at, to = [], []
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    q = _matrix(part.column("v").take(pa.array(rows)), dim)
                    c = np.stack([centres[dim, f][n] for f, n in by_length[dim]])
                    far = np.array([balls[dim, f, n][1] for f, n in by_length[dim]])
                    norm = np.linalg.norm(q, axis=1)[:, None]
                    slack = 1e-9 * norm * (np.linalg.norm(c, axis=1) + far)[None] + 1e-6
                    best = q @ c.T + norm * far[None] + slack
                    for n, b in np.argwhere(best >= floor[rows][:, None]).tolist():
                        family, centre = by_length[dim][b]
                        for s in range(subs[dim, family, centre]):
                            if (family, centre, s) != home[rows[n]]:
                                at.append(int(rows[n]))
                                to.append((family, centre, s))
                kept = part.take(pa.array(at, pa.int32()))
                where = [pa.array([t[n] for t in to], pa.int32()) for n in range(3)]
                yield pa.RecordBatch.from_arrays([kept.column("dim"), *where, *(kept.column(c) for c in names[4:])], names)

    probes = asked.mapInArrow(probing, "dim int, family int, centre int, sub int, tag long, vec_id long, v array<double>, floor long")
    second = _searched(trees, probes, k, partitions)
    return _best(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")
