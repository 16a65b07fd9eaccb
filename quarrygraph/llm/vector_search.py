"""Nearest neighbours by inner product over balanced posting lists.

Geometry: with one more component that lifts every vector to the largest norm (queries get 0 there)
the largest inner products are the smallest distances, so clustering by distance serves the search.

Index: equal vectors are one *kind* with the ``k`` + 1 smallest of its ids, which are all that any
answer can hold.  Centroids are fitted on a bounded sample by k-means that splits lists which are too
long; above ``COARSE`` lists the sample's centroids are cells, and each cell's lists are fitted on
vectors of its own, by tasks.  Their number grows with the rows, at first one for ``PER_LIST`` kinds,
then as the root of the kinds (see ``lists_for_kinds``), so that lists and centroids grow alike; what is
broadcast of them stays below ``MOST_BYTES``, beyond which lists grow longer instead.

The centroids form an in-memory graph.  Tasks link each with its nearest ones among those of the
nearest ``REACH`` blocks; a few spread links and a ring keep every centroid within reach.  A beam
search walks the graph, for postings and for queries alike.

Every kind is posted to the list of the nearest centroid found, and to up to ``COPIES`` - 1 further
ones whose distance is within ``BOUNDARY`` of the nearest, unless a list that has it already lies
closer to that centroid (the relative neighbourhood rule).

Search: lists whose distance is within a ratio of the nearest are read, and more only while those
hold too few kinds to fill an answer.  The beam grows until its last centroid lies beyond both.  The
ratio is the one that would have found ``RECALL`` of the true neighbours of about ``PROBES`` indexed
vectors, which are compared with all others for that: on clustered vectors it stays near 1, on
directions without clusters it has to take in a good part of all lists.

Equal query vectors are searched once.  About ``LISTS_PER_BLOCK`` neighbouring lists make a block; a
query goes to each block once, with the lists that it reads there.  Blocks and their queries are cut
into segments of about ``SEGMENT`` rows, and each segment meets each part of the queries in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

TOP = 20
PER_LIST = 64
#: Lists for the root of the kinds: the centroids, which are broadcast, number at most so many times it.
PER_ROOT = 12
#: Vectors that the first centroids (or cells) are fitted on, and those for each further list, about.
SAMPLE, OF_CELL = 65_536, 16
COARSE = 1024
COPIES, BOUNDARY = 4, 1.15
RECALL, PROBES = 0.96, 256
#: Centroids that a walk keeps for a query, and for a vector that is posted.
BEAM, POSTING_BEAM = 128, 32
LISTS_PER_BLOCK, SEGMENT = 128, 8_192
#: Blocks whose centroids are looked at for links; links to near and to spread centroids.
REACH, NEAR_LINKS, SPREAD_LINKS = 6, 24, 7
#: What centroids and their graph may take, in bytes.
MOST_BYTES = 512 << 20


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Id and vector (array of float or double) of the rows that can take part.

    Null, empty and zero vectors, those with a null or non-finite component, and those of another
    length than most have are left out.
    """
    kind = vectors.schema[col].dataType
    v = F.col(col) if kind == T.ArrayType(T.FloatType(), kind.containsNull) else F.col(col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (length[0].d if length else 0))


def kinds_of(rows: DataFrame, most: int) -> DataFrame:
    """``v``, ``ids``: distinct vectors, each with the ``most`` smallest of its ids.

    Rows are made distinct first and the rank limit is taken before the shuffle too, so a very common
    vector sends no more than ``most`` rows from each task.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.distinct().withColumn("nth", nth).filter(F.col("nth") <= most)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def lists_for_kinds(n: int, per_list: int = PER_LIST) -> int:
    return max(1, min(-(-n // per_list), int(PER_ROOT * n**0.5)))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """k-means, then lists above twice the mean are split in two until none can be, up to twice as many lists."""
    rng = np.random.default_rng(seed)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    near = _nearest(x, c)
    queue, done = [np.flatnonzero(near == i) for i in range(len(c))], []
    most = max(4, 2 * len(x) // lists)
    while queue:
        m = queue.pop()
        if not len(m):
            continue
        if len(m) <= most or len(queue) + len(done) + 2 > 2 * lists:
            done.append(x[m].mean(0))
            continue
        two = x[m[rng.choice(len(m), 2, replace=False)]]
        for _ in range(4):
            side = _nearest(x[m], two)
            if side.all() or not side.any():
                break
            two = np.stack([x[m[side == 0]].mean(0), x[m[side == 1]].mean(0)])
        side = _nearest(x[m], two)
        if side.all() or not side.any():
            done.append(x[m].mean(0))
        else:
            queue += [m[side == 0], m[side == 1]]
    return np.array(done)


class Centroids:
    """The centroids, their graph, the block of each, and how many kinds each has as its nearest."""

    def __init__(self, points: np.ndarray, near: np.ndarray, block: np.ndarray, seed: int = 13):
        """``near``: the nearest other centroids of each, however many; missing ones name itself."""
        n, rng = len(points), np.random.default_rng(seed)
        self.points, self.block, self.size = points, block, np.zeros(n, np.int64)
        self.square = (points * points).sum(1)
        ring = (np.arange(n)[:, None] + 1) % n
        self.graph = np.concatenate((near, rng.integers(0, n, (n, SPREAD_LINKS)), ring), axis=1)
        self.entry = np.sort(rng.choice(n, min(n, 16), replace=False))

    @staticmethod
    def _picked(beam: int) -> int:
        """Centroids that one step of a walk expands for each query."""
        return min(64, max(4, beam // 16))

    def parts(self, rows: np.ndarray, beam: int) -> list[np.ndarray]:
        """``rows`` in parts that a walk takes at once: a step looks at so many centroids for each."""
        return np.array_split(rows, max(1, -(-len(rows) * self._picked(beam) // 1024)))

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found for each query, nearest first, and the distances.

        The graph is connected, so a beam as wide as all centroids finds them all.
        """
        m, n = len(q), len(self.points)
        beam, pick = min(beam, n), self._picked(beam)
        norm = (q * q).sum(1)
        ids, dist = np.full((m, beam), -1), np.full((m, beam), np.inf)
        unread = np.zeros((m, beam), bool)
        seen = np.zeros(m * n, bool)
        fresh = (np.arange(m)[:, None] * n + self.entry).ravel()
        while True:
            fresh = np.unique(fresh[~seen[fresh]])
            seen[fresh] = True
            r, c = np.divmod(fresh, n)
            count = np.bincount(r, minlength=m)
            at = np.arange(len(r)) - (np.cumsum(count) - count)[r]
            more, far = np.full((m, count.max(initial=0)), -1), np.full((m, count.max(initial=0)), np.inf)
            more[r, at] = c
            far[r, at] = np.maximum(norm[r] + self.square[c] - 2 * np.einsum("ij,ij->i", q[r], self.points[c]), 0)
            ids, dist, unread = np.hstack((ids, more)), np.hstack((dist, far)), np.hstack((unread, more >= 0))
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, unread = (np.take_along_axis(x, best, 1) for x in (ids, dist, unread))
            r, j = np.nonzero(unread & (np.cumsum(unread, axis=1) <= pick))
            if not len(r):
                return ids, np.sqrt(dist)
            unread[r, j] = False
            fresh = (r[:, None] * n + self.graph[ids[r, j]]).ravel()

    def lists_for(self, q: np.ndarray, ratio: float, least: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, list) to read: lists within ``ratio``, and more while they hold fewer than ``least`` kinds.

        Queries whose beam ends with a list that is still to be read walk again with twice the beam.
        """
        n, rows, found = len(self.points), np.arange(len(q)), []
        while len(rows):
            left = []
            for part in self.parts(rows, beam):
                ids, dist = self.walk(q[part], beam)
                held = self.size[ids]
                use = (dist <= ratio * dist[:, :1]) | (np.cumsum(held, axis=1) - held < least)
                settled = np.full(len(part), beam >= n) | ~use[:, -1]
                a, b = np.nonzero(use & settled[:, None])
                found.append((part[a], ids[a, b]))
                left.append(part[~settled])
            rows, beam = np.concatenate(left), 2 * beam
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def linked(points: DataFrame) -> Centroids:
    """Centroids with their graph from rows ``point`` (array of double); tasks find the nearest ones.

    Only the centroids and ``NEAR_LINKS`` numbers for each come to the driver.
    """
    spark = points.sparkSession
    points = shared.materialise(points.select("point").withColumn("key", F.monotonically_increasing_id()), "centroids")
    t = points.toArrow()
    key = t["key"].to_numpy()
    order = np.argsort(key)
    x, key = _matrix(t["point"])[order], key[order]
    some = np.random.default_rng(17).choice(len(x), min(len(x), SAMPLE), replace=False)
    hubs = spark.sparkContext.broadcast(balanced_centroids(x[np.sort(some)], max(1, len(x) // LISTS_PER_BLOCK)))

    def visit(batches):
        for b in batches:
            p = _matrix(b.column("point"))
            k = min(REACH, len(hubs.value))
            near = np.concatenate([np.argsort(_distances(p[i : i + 1024], hubs.value), axis=1, kind="stable")[:, :k] for i in range(0, len(p), 1024)]) if len(p) else np.zeros((0, k), int)
            at = pa.array(np.repeat(np.arange(len(p)), k))
            own = pa.array(np.tile(np.arange(k) == 0, len(p)))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int64()), own, b.column("key").take(at), b.column("point").take(at)], names=["hub", "own", "key", "point"])

    def nearest(t: pa.Table) -> pa.Table:
        p, name, own = _matrix(t["point"]), t["key"].to_numpy(), t["own"].to_numpy()
        there = np.flatnonzero(own)
        k = min(NEAR_LINKS + 1, len(there))
        a, b, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(0, len(p) if k else 0, 1024):
            far = _distances(p[i : i + 1024], p[there])
            far[name[i : i + 1024, None] == name[there]] = -1.0  # itself first: that row tells its block
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            a.append(np.repeat(name[i : i + 1024], k))
            b.append(name[there][best].ravel())
            d.append(np.take_along_axis(far, best, 1).ravel())
        hub = np.full(sum(map(len, a)), t["hub"][0].as_py())
        return pa.table({"key": np.concatenate(a), "near": np.concatenate(b), "distance": np.concatenate(d), "hub": hub})

    types = "hub long, own boolean, key long, point array<double>"
    links = points.mapInArrow(visit, types).groupBy("hub").applyInArrow(nearest, "key long, near long, distance double, hub long")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("distance", "near"))
    got = links.withColumn("nth", nth).filter(F.col("nth") <= NEAR_LINKS + 1).select("key", "near", "hub", "nth").toArrow()
    hubs.unpersist()
    shared.drop_table(points)
    a, b, nth = np.searchsorted(key, got["key"].to_numpy()), np.searchsorted(key, got["near"].to_numpy()), got["nth"].to_numpy()
    near = np.repeat(np.arange(len(x))[:, None], min(NEAR_LINKS, max(1, len(x) - 1)), axis=1)
    use = (nth > 1) & (nth <= near.shape[1] + 1)
    near[a[use], nth[use] - 2] = b[use]
    block = np.zeros(len(x), np.int64)
    block[a[nth == 1]] = got["hub"].to_numpy()[nth == 1]
    return Centroids(x, near, block)


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]))


def fit(kinds: DataFrame, per_list: int = PER_LIST, sample: int = SAMPLE, coarse: int = COARSE, most_bytes: int = MOST_BYTES) -> tuple[Centroids | None, float]:
    """Centroids from a share of the kinds by hash (about ``sample``), and the largest norm of all.

    More than ``coarse`` lists are fitted in two levels: the sample gives ``coarse`` cells, and tasks
    give each cell lists in proportion to its vectors, from ``OF_CELL`` vectors a list or so.
    """
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    spark = kinds.sparkSession
    n, top, length = kinds.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not n:
        return None, 0.0
    a_list = 8 * (length + 1 + NEAR_LINKS + SPREAD_LINKS + 4)
    lists = max(1, min(lists_for_kinds(n, per_list), most_bytes // (2 * a_list)))
    cells = min(lists, coarse)
    picked = kinds.filter(shared.share(F.col("v"), min(sample, 64 * cells) / n)).select("v").toArrow()
    if not picked.num_rows:
        picked = kinds.select("v").limit(1).toArrow()
    first = balanced_centroids(_lifted(_matrix(picked["v"]), top), cells)
    if cells == lists:
        return linked(spark.createDataFrame(pa.table({"point": pa.array(first.tolist(), pa.list_(pa.float64()))}))), top
    of_cell = spark.sparkContext.broadcast(first)
    kind = kinds.schema["v"].dataType.simpleString()
    part = min(1.0, OF_CELL * lists / n)

    def nearest(batches):
        for b in batches:
            near = _nearest(_lifted(_matrix(b.column("v")), top), of_cell.value)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), b.column("v")], names=["cell", "v"])

    def split(t: pa.Table) -> pa.Table:
        x = _lifted(_matrix(t["v"]), top)
        points = balanced_centroids(x, max(1, round(len(x) * lists / (part * n))))
        return pa.table({"point": pa.array(points.tolist(), pa.list_(pa.float64()))})

    dealt = kinds.filter(shared.share(F.col("v"), part)).select("v").mapInArrow(nearest, f"cell long, v {kind}")
    return linked(dealt.groupBy("cell").applyInArrow(split, "point array<double>")), top


def needed_ratio(posted: DataFrame, fitted: Centroids, k: int, recall: float = RECALL, probes: int = PROBES) -> float:
    """The ratio of distances within which the lists of ``recall`` of the true neighbours of some kinds lie."""
    own = posted.filter("own")
    total = int(fitted.size.sum())
    asked = own.filter(shared.share(F.reverse("v"), probes / total)).select(F.element_at("ids", 1).alias("id"), "v").toArrow()
    q, names = _matrix(asked["v"]), asked["id"].to_numpy()
    if not len(q) or total < 2:
        return 1.0
    sent = own.sparkSession.sparkContext.broadcast((q, names))

    def run(batches):
        q, names = sent.value
        best, at = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        for b in batches:
            s = q @ _matrix(b.column("v")).T
            first = pc.list_element(b.column("ids"), 0).to_numpy(zero_copy_only=False)
            s[names[:, None] == first[None]] = -np.inf
            s = np.hstack((best, s))
            lists = np.hstack((at, np.broadcast_to(b.column("list").to_numpy(), (len(q), b.num_rows))))
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best, at = np.take_along_axis(s, top, 1), np.take_along_axis(lists, top, 1)
        r, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(best[r, j]), pa.array(at[r, j])], names=["q", "score", "list"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))
    found = own.select("ids", "v", "list").mapInArrow(run, "q long, score double, list long").withColumn("nth", nth).filter(F.col("nth") <= k)
    found = found.select("q", "list").toArrow()  # probes times k rows
    d = np.sqrt(_distances(np.hstack((q, np.zeros((len(q), 1)))), fitted.points))
    need = d[found["q"].to_numpy(), found["list"].to_numpy()] / np.maximum(d.min(axis=1)[found["q"].to_numpy()], 1e-12)
    return max(1.0, float(np.quantile(need, recall, method="higher"))) if len(need) else 1.0


def post(kinds: DataFrame, centroids, top: float, copies: int = COPIES, boundary: float = BOUNDARY, beam: int = POSTING_BEAM) -> DataFrame:
    """``list``, ``block``, ``ids``, ``v``, ``own`` (the nearest list found) for each kind and list that it is posted to."""

    def run(batches):
        c = centroids.value
        for b in batches:
            x = _lifted(_matrix(b.column("v")), top)
            for rows in c.parts(np.arange(len(x)), beam):
                # the nearest few lists found, dropped by the boundary and the neighbourhood rule
                near, d = c.walk(x[rows], beam)
                near, d = near[:, : 2 * copies], d[:, : 2 * copies]
                k = near.shape[1]
                p = c.points[near]
                square = (p * p).sum(2)
                between = np.sqrt(np.maximum(square[:, :, None] + square[:, None] - 2 * p @ p.transpose(0, 2, 1), 0))
                taken = np.zeros(near.shape, bool)
                taken[:, 0] = True
                for j in range(1, k):
                    ok = (d[:, j] <= boundary * d[:, 0] + 1e-12) & (taken.sum(1) < copies)
                    for e in range(j):
                        ok &= ~(taken[:, e] & (between[:, j, e] < d[:, j]))
                    taken[:, j] = ok
                r, j = np.nonzero(taken)
                at = pa.array(rows[r])
                yield pa.RecordBatch.from_arrays([pa.array(near[r, j], pa.int64()), pa.array(c.block[near[r, j]], pa.int64()), b.column("ids").take(at), b.column("v").take(at), pa.array(j == 0)], names=["list", "block", "ids", "v", "own"])

    types = {n: kinds.schema[n].dataType.simpleString() for n in ("ids", "v")}
    return kinds.mapInArrow(run, f"list long, block long, ids {types['ids']}, v {types['v']}, own boolean")


def _best(q: np.ndarray, numbers: np.ndarray, wanted: np.ndarray, x: np.ndarray, of_list: np.ndarray, ids: np.ndarray, kind: np.ndarray, k: int):
    """For each query the ``k`` ids of largest product; ties, however many, go to the smaller ids.

    ``wanted`` (queries x lists) and ``of_list`` (the list of each row of ``x``) say what a query reads.
    ``ids`` and ``kind`` (its row of ``x``) belong together, in ascending order of ids; an id that has
    several vectors or stands in several lists counts by the best of them.
    """
    out = []
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    for i in range(0, len(q), 256):
        s = np.where(wanted[i : i + 256][:, of_list], q[i : i + 256] @ x.T, -np.inf)[:, kind]
        of_id = s if len(start) == len(ids) else np.maximum.reduceat(s, start, axis=1)
        kk = min(k, of_id.shape[1])
        least = -np.partition(-of_id, kk - 1, axis=1)[:, kk - 1]
        # rounding of the product must not decide a tie: take a little more, then score one by one
        slack = 1e-12 * (np.abs(s, where=np.isfinite(s), out=np.zeros_like(s)).max(axis=1) + 1e-300)
        a, b = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
        exact = (q[a + i] * x[kind[b]]).sum(axis=1)
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        if of_id is not s:
            _, once = np.unique(np.stack((a, ids[b])), axis=1, return_index=True)
            once.sort()
            a, b, exact = a[once], b[once], exact[once]
        keep = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
        out.append((numbers[a[keep] + i], ids[b[keep]], exact[keep]))
    return [np.concatenate(c) for c in zip(*out)]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", col: str = "embedding", k: int = TOP, per_list: int = PER_LIST, recall: float = RECALL, ratio: float | None = None, beam: int = BEAM, sample: int = SAMPLE, coarse: int = COARSE, segment: int = SEGMENT) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's ``k`` nearest found, its own id left out.

    Scores are inner products in double precision; ties go to the smaller id.  Rows that cannot take
    part (see ``usable``; null ids too) neither ask nor answer.  Repeated rows are candidates with
    one id and count once; an id with several vectors asks with each and answers with its best.  Lists
    are read until they hold more than ``k`` distinct vectors, so that an answer is full wherever the
    table can fill it.  ``ratio`` replaces the one that ``recall`` asks for.  Other columns, whatever their names, are not read.  An empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    fewest = k + 1
    kinds = shared.materialise(kinds_of(usable(vectors, id_col, col).filter("id is not null"), k + 1), "kinds")
    fitted, top = fit(kinds, per_list, sample, coarse)
    if fitted is None:
        shared.drop_table(kinds)
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score double")
    sent = spark.sparkContext.broadcast(fitted)
    posted = shared.materialise(post(kinds, sent, top), "postings")
    shared.drop_table(kinds)
    for r in posted.filter("own").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per list
        fitted.size[r.list] = r.n
    if ratio is None:
        ratio = needed_ratio(posted, fitted, k, recall)
    sent.unpersist()
    sent = spark.sparkContext.broadcast(fitted)
    asking = shared.materialise(usable(queries, id_col, col).filter("id is not null").distinct(), "asking")
    distinct = shared.materialise(asking.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    kind = distinct.schema["v"].dataType.simpleString()

    def ask(batches):
        c = sent.value
        for b in batches:
            x = _matrix(b.column("v"))
            lifted = np.hstack((x, np.zeros((len(x), 1))))
            for i in range(0, len(x), 256):
                a, lists = c.lists_for(lifted[i : i + 256], ratio, fewest, beam)
                order = np.lexsort((lists, c.block[lists], a))
                a, lists = a[order], lists[order]
                first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(c.block[lists]) != 0))[: len(a)])
                read = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pa.array(lists, pa.int64()))
                at = pa.array(a[first] + i)
                yield pa.RecordBatch.from_arrays([pa.array(c.block[lists[first]], pa.int64()), read, b.column("q").take(at), b.column("v").take(at)], names=["block", "lists", "number", "v"])

    asked = shared.materialise(distinct.mapInArrow(ask, f"block long, lists array<long>, number long, v {kind}"), "asked")
    parts = lambda df, name: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / segment).cast("int").alias(name))
    size = parts(posted, "x_parts").join(parts(asked, "q_parts"), "block")

    def grid(df: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        dealt = df.join(size, "block").withColumn(mine, F.pmod(F.xxhash64(key), F.col(f"{mine}_parts")).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).drop("x_parts", "q_parts")

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "id": x["ids"].combine_chunks().flatten()[:0], "score": pa.array([], pa.float64())})
        names, of_list = np.unique(x["list"].to_numpy(), return_inverse=True)
        lists = q["lists"].combine_chunks()
        asks, read = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(names, read), len(names) - 1)
        wanted = np.zeros((len(lists), len(names)), bool)
        wanted[asks[names[at] == read], at[names[at] == read]] = True
        ids = x["ids"].combine_chunks()
        each, flat = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy()), ids.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(flat, kind="stable")
        a, b, s = _best(_matrix(q["v"]), q["number"].to_numpy(), wanted, _matrix(x["v"]), of_list, flat[order], each[order], k + 1)
        return pa.table({"q": a, "id": b, "score": s})

    key = ["block", "x", "q"]
    found = grid(asked, "number", "q", "x").groupBy(*key).cogroup(grid(posted, "v", "x", "q").groupBy(*key)).applyInArrow(compare, f"q long, id {id_type}, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    found = found.groupBy("q").agg(F.collect_list(F.struct("id", "score")).alias("found"))
    # equal query vectors share what was found; each leaves out its own id
    answers = asking.join(distinct, "v").select(F.col("id").alias("query_id"), "q").join(found, "q").select("query_id", F.explode("found").alias("f"))
    answers = answers.filter(F.col("f.id") != F.col("query_id")).groupBy("query_id", "f.id").agg(F.max("f.score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
