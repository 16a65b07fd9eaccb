"""SimHash near-duplicates: bit-sliced Hamming search and distributed components.

Fingerprints that differ in at most ``radius`` bits agree wholly in two of five bands (pigeonhole:
three errors spoil three bands at most), so ten tables of band pairs put every link into a bucket
without a miss.  Within a bucket fingerprints lie vertically, plane by plane: a machine word holds
one bit of 64 of them, carry-save counters add the mismatches of all 64 at once, and a block is
given up as soon as all of its counters have passed the radius.  A bucket that outgrows ``CHUNK``
fingerprints is dealt anew by further bits: its members differ in at most ``radius`` of the bits that
its bands leave, so they agree in one of ``radius + 1`` bands of those, and so on.

Similar shingle sets (``similar_groups``) meet in buckets of minimum keys.  A large one is cut into
chunks that all meet a few common members, which joins what is alike.  Sets that are then still apart
leave the bucket for those of their rarest shingles, as many as two similar sets must share one of
(``prefix_keys``): a text that thousands of unlike documents hold brings none of them together.

A bucket never emits its pairs: it returns a spanning forest of its links, one edge for each member
but the first of a component, and the forests' components are those of all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import connected

RADIUS = 3
SHINGLE = 3
SEED = 42
CHUNK = 512
PIVOTS = 32
SIMILARITY = 0.8
_PAIRS_AT_ONCE = 1 << 15
_WORDS_AT_ONCE = 1 << 12
_ROWS_AT_ONCE = 1 << 14


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter text is one shingle, none if blank."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.fromiter([digest(whole[a:b], seed) for a, b in zip(starts, ends)], np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """Bit by bit, 1 where over half of the hashes have a 1; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles; a text without words gives 0."""
    return majority(shingle_hashes(text, shingle, seed))


def least_hashes(h: np.ndarray, tables: int, rows: int) -> list[int]:
    """A key per table: the least shingles under ``rows`` orders, hashed together."""
    if not len(h):
        return [0] * tables
    h = np.unique(h)
    out = []
    for t in range(tables):
        key = np.array([t], np.uint64)
        for r in range(rows):
            order = np.uint64(2 * xxhash.xxh64_intdigest(bytes([t, r])) + 1 & (1 << 64) - 1)
            v = h * order
            key = shared.mix64(key ^ (v ^ (v >> np.uint64(29))).min(), 9)
        out.append(int(key.view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, words: int = 1, tables: int = 0, rows: int = 3, sets: bool = False) -> DataFrame:
    """``docs`` without its text, with ``fp`` (binary, ``words`` times 64 bits, little-endian) and ``keys``.

    Further words are majorities of the same shingles under other hashes.  ``keys`` (array<long>)
    are minimum keys of the shingle set, for candidates beyond a small radius; none by default.
    With ``sets`` a repeated shingle counts once, and ``node`` (long) is a hash of the shingle set.
    """
    keep = [c for c in docs.columns if c not in ("fp", "keys", text) and not (sets and c == "node")]
    schema = docs.select(*keep).schema.add("fp", "binary").add("keys", T.ArrayType(T.LongType()))

    def run(batches):
        for b in batches:
            fps, keys, nodes = [], [], []
            for t in shared.column_bytes(b.column(text)):
                h = shingle_hashes(t, shingle, seed)
                if sets:
                    h = np.unique(h)
                    nodes.append(xxhash.xxh64_intdigest(h.tobytes(), seed) - (1 << 63))
                fps.append(b"".join(majority(shared.mix64(h, i) if i else h).to_bytes(8, "little") for i in range(words)))
                keys.append(least_hashes(h, tables, rows))
            made = [pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))] + ([pa.array(nodes, pa.int64())] if sets else [])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=[*keep, "fp", "keys"] + ["node"] * sets)

    return docs.select(*keep, text).mapInArrow(run, schema.add("node", "long") if sets else schema)


def bands(radius: int = RADIUS) -> list[int]:
    """Masks of the tables: pairs of the ``radius + 2`` bands of 64 bits."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(masks, 2)]


class Forest:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if np.array_equal(up, r):
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.root)))


def _planes(lanes: np.ndarray) -> np.ndarray:
    """(units, 64, words) to (64 * words planes, units): bit j of a plane's word is lane j's bit."""
    units, _, words = lanes.shape
    out = np.empty((64 * words, units), np.uint64)
    for b in range(64 * words):
        bit = ((lanes[:, :, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(bit, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def within(planes: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """For units x queries, the word of lanes within ``radius`` of the query.

    ``planes`` is (bits, units); ``query`` is (units, queries, words).  Counters are carry-save:
    plane ``k`` of the counter holds bit k of all 64 lanes' mismatch counts.  Blocks (a unit with a
    query) whose lanes have all passed the radius are left out of later planes.
    """
    units, n, _ = query.shape
    levels = radius.bit_length()
    full = ~np.uint64(0)
    # a start of 2^levels - 1 - radius makes the carry out of the top level mean "over the radius"
    first = (1 << levels) - 1 - radius
    count = [np.full(units * n, full if first >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros(units * n, np.uint64)
    result = np.zeros(units * n, np.uint64)
    live = np.arange(units * n)
    unit, query = live // n, query.reshape(units * n, -1)
    for b in range(len(planes)):
        bit = (query[live, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        carry = planes[b][unit] ^ (np.uint64(0) - bit)
        for k in range(levels):
            old = count[k]
            count[k] = old ^ carry
            carry = carry & old
        over |= carry
        if b % 16 == 15:
            stay = over != full
            if not stay.all():
                live, unit, over, count = live[stay], unit[stay], over[stay], [c[stay] for c in count]
                if not len(live):
                    return result.reshape(units, n)
    result[live] = ~over
    return result.reshape(units, n)


def bucket_links(fps: np.ndarray, size: np.ndarray, radius: int) -> np.ndarray:
    """Root position of each fingerprint among its bucket's links.

    ``fps`` is (fingerprints, words), bucket after bucket; ``size`` has the buckets' sizes.
    """
    forest = Forest(len(fps))
    first = np.cumsum(size) - size
    words = -(-size // 64)
    bucket = np.repeat(np.arange(len(size)), words)
    at = first[bucket] + 64 * (np.arange(len(bucket)) - np.repeat(np.cumsum(words) - words, words))
    room = np.minimum(64, first[bucket] + size[bucket] - at)
    planes = _planes(fps[np.minimum(at[:, None] + np.arange(64), len(fps) - 1)])
    valid = np.where(room == 64, ~np.uint64(0), (np.uint64(1) << (room % 64).astype(np.uint64)) - np.uint64(1))
    step = 16
    for r in range(0, int(size.max(initial=0)), step):
        # only lanes from the query's word on: an earlier word has asked about this pair already
        use = np.flatnonzero((size[bucket] > r) & (at + 64 > first[bucket] + r))
        for part in np.array_split(use, max(1, -(-len(use) * step // _PAIRS_AT_ONCE))):
            ask = first[bucket[part]][:, None] + r + np.arange(step)
            there = ask < (first + size)[bucket[part]][:, None]
            near = within(planes[:, part], fps[np.minimum(ask, len(fps) - 1)], radius) & valid[part][:, None]
            near[~there] = 0
            u, q = np.nonzero(near)
            for i in range(0, len(u), _WORDS_AT_ONCE):  # where all are alike a word is 64 links
                v, w = u[i : i + _WORDS_AT_ONCE], q[i : i + _WORDS_AT_ONCE]
                bits = np.unpackbits(near[v, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                hit, j = np.nonzero(bits)
                forest.link(ask[v[hit], w[hit]], at[part][v[hit]] + j)
    return forest.roots()


def _whole_groups(batches, names: list[str]):
    """Columns of many whole groups at a time; the stream is sorted by its column ``group``."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < _ROWS_AT_ONCE or not b.num_rows:
            continue
        t = pa.Table.from_batches(held)
        group = t["group"].to_numpy()
        differ = group[::-1] != group[-1]
        last = len(group) - int(differ.argmax()) if differ.any() else 0  # where the last group begins
        if last:
            yield [t[n][:last] for n in names]
            held = t.slice(last).combine_chunks().to_batches()
            rows = len(t) - last
    if rows:
        t = pa.Table.from_batches(held)
        yield [t[n] for n in names]


def near_links(groups: DataFrame, radius: int) -> DataFrame:
    """Spanning edges (``a``, ``b`` long) of each ``group`` of rows ``node``, ``fp`` within ``radius``.

    Each hangs a node onto the smallest one of its class in the group, so groups that share members
    mostly give the same edges.
    """

    def run(batches):
        for node, fp, group in _whole_groups(batches, ["node", "fp", "group"]):
            node, group = node.to_numpy(), group.to_numpy()
            fp = np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(node), -1)
            size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
            use = np.repeat(size > 1, size)
            node, fp, size = node[use], fp[use], size[size > 1]
            if not len(size):
                continue
            root = node[bucket_links(fp, size, radius)]
            far = root != node
            if far.any():
                a, b = np.unique(np.stack([root[far], node[far]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.select("group", "node", "fp").repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "a long, b long")


def finer(mask: int, radius: int) -> list[int]:
    """``mask`` with each of ``radius`` + 1 bands of the bits that it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i]


def band_groups(kinds: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``node``, ``fp``, ``group`` for rows with ``node`` (the fingerprint) and ``fp``.

    Any two within ``radius`` share a group, and none has more than ``chunk`` rows: larger ones are
    dealt into groups of finer masks, as often as it takes.  It ends, since fingerprints are distinct.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m

    def split(batches):
        for b in batches:
            masks = [finer(m % (1 << 64), radius) for m in b.column("mask").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(masks)), [len(m) for m in masks]))
            made = pa.array([signed(x) for m in masks for x in m], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("node").take(at), b.column("fp").take(at), made], names=["node", "fp", "mask"])

    now, done = kinds.select("node", "fp", F.explode(F.array(*[F.lit(signed(m)) for m in bands(radius)])).alias("mask")), None
    while True:
        keyed = now.withColumn("group", F.xxhash64("mask", F.col("node").bitwiseAND(F.col("mask"))))
        size = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        dealt = shared.materialise(keyed.join(size, "group"), "bands")
        small = dealt.filter(F.col("n") <= chunk).select("node", "fp", "group")
        done = small if done is None else done.union(small)
        large = dealt.filter(F.col("n") > chunk)
        if large.isEmpty():
            return done
        now = large.select("node", "fp", "mask").mapInArrow(split, "node long, fp binary, mask long").distinct()


def linked(keyed: DataFrame, compare, chunk: int = CHUNK, pivots: int = PIVOTS, finer=None) -> DataFrame:
    """Edges (``a``, ``b``) that connect whatever ``compare`` connects among rows that share a key.

    ``keyed``: ``node``, ``key``; ``compare`` takes groups (``node``, ``group``, ``class``) to spanning
    edges.  Groups above ``chunk`` are cut into parts, which all get the group's first ``pivots``
    members by hash, so near copies come together at the cost of one row each.  Keys whose members are
    then still apart give way to the keys that ``finer`` names for their nodes (``node`` to ``node``,
    ``key``; it must lose no link).  What is above ``chunk`` even there is compared with all that is not
    of its class: the largest class of a key in chunks with the chunks of the others, and those with
    each other.
    """
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = shared.materialise(keyed.join(size, "key"), "keyed")
    apart = F.col("node").alias("class")
    groups = dealt.filter(F.col("n") <= chunk).select("node", F.col("key").alias("group"), apart)
    large = dealt.filter(F.col("n") > chunk).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    some_large = not large.isEmpty()
    if some_large:
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(5)), "node"))
        first = large.withColumn("nth", nth).filter(F.col("nth") <= pivots)
        mine = F.array(F.pmod(F.xxhash64("node", F.lit(7)), "parts").cast("int"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        for rows, part in ((large, mine), (first, every)):
            rows = rows.select("node", "key", F.explode(part).alias("part"))
            groups = groups.union(rows.select("node", F.xxhash64("key", "part").alias("group"), apart))
        groups = groups.distinct()
    edges = shared.materialise(compare(groups), "links")
    if not some_large:
        shared.drop_table(dealt)
        return edges
    found = shared.materialise(connected(edges), "classes")
    shared.drop_table(edges)
    # what the first round has joined goes on as stars
    stars = found.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    classed = shared.materialise(_with_class(large, found), "classes")
    shared.drop_table(dealt)
    mixed = _several_classes(classed)
    if finer is not None:
        mixed_table = mixed = shared.materialise(classed.join(mixed.select("key"), "key", "left_semi").select("node").distinct(), "apart")
        shared.drop_table(classed)
        if mixed.isEmpty():
            shared.drop_table(mixed_table)
            return stars
        classed = shared.materialise(_with_class(finer(mixed), found), "classes")
        shared.drop_table(mixed_table)
        mixed = _several_classes(classed)
    more = shared.materialise(compare(_across(classed.join(mixed, "key"), chunk)), "links")
    shared.drop_table(classed)
    return stars.union(more)


def _with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.select("node", "key").join(found, "node", "left").select("node", "key", F.coalesce("root", "node").alias("class"))


def _several_classes(classed: DataFrame) -> DataFrame:
    """``key``, ``big`` (largest class), its size ``m`` and the key's ``n``, where a key has several classes."""
    per = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "class")).alias("big"), F.sum("n").alias("n"))
    return per.filter(F.col("n") > F.col("big.n")).select("key", F.col("big.class").alias("big"), F.col("big.n").alias("m"), "n")


def _across(rows: DataFrame, chunk: int) -> DataFrame:
    """Groups in which members of a key meet all that are not of its largest class; one where it is small."""
    parts = lambda n: F.ceil(n / chunk).cast("int")
    x, y = parts(F.col("m")), parts(F.col("n") - F.col("m"))
    of_big, small = F.col("class") == F.col("big"), F.col("n") <= chunk
    mine = F.when(small, 0).when(of_big, F.pmod(F.xxhash64("node", F.lit(7)), x)).otherwise(x + F.pmod(F.xxhash64("node", F.lit(7)), y)).cast("int")
    others = F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.when(of_big, x).otherwise(0), x + y - 1))
    rows = rows.select("node", "key", "class", mine.alias("mine"), F.explode(others).alias("other"))
    return rows.select("node", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), "class")


def prefix_keys(texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``node``, ``key``: shingles of which any two sets of ``similarity`` share one, as rare ones as can be.

    ``texts``: distinct ``node``, ``text``.  A set's shingles stand in one order for all, by the number of
    sets that hold them.  If two sets of a and b >= a shingles share ``similarity`` of their union, then
    at least 2s / (1 + s) of a and s of b are common, so the first shingles up to those that may all
    lie behind the last common one meet.  Keys without a set that could be the smaller one are left out.
    """

    def run(batches):
        nodes, held, rows = [], [], 0

        def made():
            n = np.array([len(h) for h in held])
            cols = [np.repeat(np.array(nodes, np.int64), n), np.repeat(n, n), np.concatenate(held).view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "n", "key"])

        for b in batches:
            for node, t in zip(b.column("node").to_pylist(), shared.column_bytes(b.column("text"))):
                nodes.append(node)
                held.append(np.unique(shingle_hashes(t, shingle)))
                rows += len(held[-1])
                if rows > _ROWS_AT_ONCE:
                    yield made()
                    nodes, held, rows = [], [], 0
        if held:
            yield made()

    every = shared.materialise(texts.select("node", "text").mapInArrow(run, "node long, n long, key long"), "shingles")
    often = every.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("held", F.lit(1)), "key"))
    first = lambda part: F.col("nth") <= F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1
    placed = every.join(often, "key", "left").withColumn("nth", nth).filter(first(similarity) & F.col("held").isNotNull())
    placed = shared.materialise(placed.select("node", "key", first(2 * similarity / (1 + similarity)).alias("lead")), "prefixes")
    shared.drop_table(every)
    use = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("lead").alias("lead")).filter("n > 1 and lead")
    return placed.join(use.select("key"), "key", "left_semi").select("node", "key")


def _number(fp: Column) -> Column:
    """The long whose little-endian bytes are ``fp``."""
    parts = [F.shiftleft(F.conv(F.hex(F.substring(fp, i + 1, 1)), 16, 10).cast("long"), 8 * i) for i in range(8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: its id, ``fp`` (long) and ``component_id`` (smallest reachable id).

    Documents link if their fingerprints differ in at most ``radius`` bits.  Null, empty and blank
    texts have fingerprint 0 and link with each other and whatever lies near 0.  Repeated rows stay
    repeated.  A null id never names a component unless all of its members' ids are null.  Other
    columns are not read.  An empty table gives an empty one.
    """
    made = fingerprints(docs.select(F.col(id_col), F.col(text).cast("string").alias(text)), text, shingle, seed)
    made = shared.materialise(made.drop("keys"), "simhash")
    made = made.withColumn("node", _number(F.col("fp")))
    kinds = made.groupBy("node").agg(F.min(id_col).alias("least"), F.first("fp").alias("fp"))
    named = connected(shared.materialise(near_links(band_groups(kinds, radius), radius), "links"))
    named = kinds.select("node", "least").join(named, "node", "left").select("node", "least", F.coalesce("root", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    return made.join(named, "node").select(id_col, F.col("node").alias("fp"), "component_id")


def set_links(sets: list[np.ndarray], fps: np.ndarray, radius: int, similarity: float, classes: np.ndarray | None = None) -> np.ndarray:
    """Root position of each set among the exact links of those within ``radius`` by fingerprint.

    Pairs that earlier links or equal ``classes`` connect already are not compared: a group of near
    copies costs about one comparison a member.  What is left to ask of a set is counted in batches that
    double, by marks over the group's numbered shingles: unlike sets cost a look at each shingle, no merge.
    """
    root = np.arange(len(sets))
    if classes is not None:
        _, first, where = np.unique(classes, return_index=True, return_inverse=True)
        root = first[where]
    length = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(length)[:-1])
    marks = np.zeros(max((int(c.max()) + 1 for c in codes if len(c)), default=0), bool)
    for i in range(len(sets) - 1):
        near = np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(axis=1) <= radius
        low, high = np.minimum(length[i + 1 :], length[i]), np.maximum(length[i + 1 :], length[i])
        ask, batch = i + 1 + np.flatnonzero(near & (low + 1e-9 >= similarity * high)), 1
        marks[codes[i]] = True
        while len(ask := ask[root[ask] != root[i]]):
            now, ask, batch = ask[:batch], ask[batch:], 2 * batch
            upto = np.concatenate(([0], np.cumsum(marks[np.concatenate([codes[j] for j in now])])))
            ends = np.cumsum(length[now])
            common = upto[ends] - upto[ends - length[now]]
            for j in now[common + 1e-9 >= similarity * (length[now] + length[i] - common)]:
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
        marks[codes[i]] = False
    return root


def exact_links(groups: DataFrame, radius: int, similarity: float, shingle: int) -> DataFrame:
    """Like ``near_links``, of pairs whose shingle sets are compared too; rows have ``text`` and ``class``."""

    def roots(rows: list[tuple]) -> pa.RecordBatch:
        node = np.array([r[0] for r in rows])
        fps = np.frombuffer(b"".join(r[1] for r in rows), "<u8").reshape(len(rows), -1)
        sets = [np.unique(shingle_hashes(r[3], shingle)) for r in rows]
        root = node[set_links(sets, fps, radius, similarity, np.array([r[2] for r in rows]))]
        far = root != node
        return pa.RecordBatch.from_arrays([pa.array(root[far]), pa.array(node[far])], names=["a", "b"])

    def run(batches):
        # a partition is sorted by group, and a group never spans two of them
        held, now = [], None
        for b in batches:
            for group, *row in zip(*(b.column(c).to_pylist() for c in ("group", "node", "fp", "class")), shared.column_bytes(b.column("text"))):
                if group != now and held:
                    yield roots(held)
                    held = []
                now = group
                held.append(row)
        if held:
            yield roots(held)

    # the work is in the comparisons, which the bytes that adaptive execution goes by do not show
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("group", "node", "fp", "class", "text").repartition(parts, "group").sortWithinPartitions("group", "node").mapInArrow(run, "a long, b long")


def _texts_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (``one`` and more) with their texts, stored: read again without another look at all texts.

    The members are stored first: while Spark broadcasts their numbers, no text but theirs is shuffled.
    """
    members = shared.materialise(members, "members")
    theirs = texts.join(members.select("one"), "one", "left_semi")
    out = shared.materialise(theirs.join(members, "one").drop("one"), "texts")
    shared.drop_table(members)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = 5, words: int = 4, tables: int = 16, rows: int = 3, row: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Like ``near_duplicates``, for documents whose shingle sets share ``similarity`` or more.

    Candidates: fingerprints of the shingle sets have ``words`` times 64 bits, documents meet in
    buckets of minimum keys (``tables`` of ``rows``; at 0.8 one pair in 100,000 meets in none), and
    the bit-sliced comparison takes a radius seven deviations above the mean at ``similarity``, since
    sets of a few shingles lie further apart than long ones.  Every real link among them lies within
    a component of candidates; there the shingle sets themselves are compared, and only links of
    ``similarity`` remain.  Components above ``chunk`` are compared as ``linked`` says.

    ``row`` names a column of distinct longs of a stored table, which is returned too; without it
    rows are numbered here.
    """
    if row is None:
        row = shared.spare(docs, "row")
        docs = shared.materialise(docs.select(id_col, text).withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = docs.select(F.col(row).alias("one"), F.col(text).cast("string").alias("text"))
    made = fingerprints(docs.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")), "text", shingle, SEED, words, tables, rows, sets=True)
    made = shared.materialise(made, "simhash")
    apart = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * words
    radius = int(bits * apart + 7 * np.sqrt(bits * apart * (1 - apart)))
    kinds = made.groupBy("node").agg(F.min("row").alias("one"), F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    kinds = shared.materialise(kinds, "kinds")
    keyed = kinds.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    fps = kinds.select("node", "fp")

    def finer(nodes: DataFrame) -> DataFrame:
        return prefix_keys(_texts_of(texts, kinds.select("one", "node").join(nodes, "node", "left_semi")), similarity, shingle)

    maybe = connected(linked(keyed, lambda groups: near_links(groups.join(fps, "node"), radius), chunk, finer=finer))
    maybe = shared.materialise(maybe, "candidates")
    of_maybe = _texts_of(texts, kinds.select("one", "node", "fp").join(maybe.select("node"), "node", "left_semi"))
    again = lambda nodes: prefix_keys(of_maybe.join(nodes, "node", "left_semi"), similarity, shingle)
    edges = linked(maybe.select("node", F.col("root").alias("key")), lambda groups: exact_links(groups.join(of_maybe, "node"), radius, similarity, shingle), chunk, finer=again)
    shared.drop_table(of_maybe)
    named = connected(edges).select("node", "root")
    named = kinds.select("node", "least").join(named, "node", "left").select("node", "least", F.coalesce("root", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "component", "component_id")
    return made.join(named, "node").select(F.col("id").alias(id_col), "fp", "component_id", F.col("row").alias(row), "component")
