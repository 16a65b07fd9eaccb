"""Exact ranked search over shards of dual-sorted wavelet trees.

A shard holds the postings of some documents as one sequence of document numbers: terms one after
another, each term's postings by falling impact.  A wavelet tree (its levels laid out as a matrix: at every
level zeros before ones, order kept) over that sequence makes the same list navigable by document: a node
is a range of numbers that share leading bits, a term's postings there are an interval, and since order is
kept the interval's first posting has the largest impact.  The sum of these first impacts bounds every
document below the node, and at a leaf it is the score.

Search takes nodes by falling bound, intersects them with all of a question's terms at once, and ends when
no bound reaches the score (ties: the id) of the k-th document found.  What one shard has found
prunes the next ones of its task.  Shards are made from the rows of a scan's tasks as they come, so that
neither the index nor the search shuffles texts or postings; only each task's k best go on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: A term in whole UTF-8 text: ASCII letters and digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
POSTINGS = 1 << 19
#: Nodes of a question that one step looks at; the first steps of a shard have fewer.
STEP = 64
#: Terms (with repeats removed) and bytes of a block of questions, which is what is sent to tasks.
BLOCK_TERMS = 1 << 17
BLOCK_BYTES = 8 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "docs binary, nulls long, n_docs long, sequence binary, impacts binary, terms binary, starts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def corpus_totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    n = F.regexp_count(text, F.lit(TERM))
    r = docs.select(n.cast("long").alias("n")).filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    return r.docs, r.terms or 0


class Shard:
    """The postings of some documents, ready for navigation."""

    def __init__(self, docs: np.ndarray, nulls: int, sequence: np.ndarray, impacts: np.ndarray, terms: list[bytes], starts: np.ndarray):
        self.docs, self.nulls, self.terms, self.starts = docs, nulls, terms, starts
        self.depth = max(1, (len(docs) - 1).bit_length())
        n = len(sequence)
        self.impact = np.zeros((self.depth + 1, n + 1), np.int64)
        self.ones = np.zeros((self.depth, n + 1), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        self.impact[0, :n] = impacts
        for level in range(self.depth):
            bit = ((sequence >> (self.depth - 1 - level)) & 1).astype(bool)
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, -1]
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
            now = self.impact[level, :n]
            self.impact[level + 1, :n] = np.concatenate((now[~bit], now[bit]))

    def below(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """The intervals in a node's left or right child."""
        a, b = self.ones[level, lo].astype(np.int64), self.ones[level, hi].astype(np.int64)
        return (a + self.zeros[level], b + self.zeros[level]) if one else (lo - a, hi - b)


def build(rows: list[tuple[int | None, bytes]], documents: int, total: int) -> dict:
    """A shard as stored: postings by term, in it by falling impact, then by document number.

    Documents are numbered by id, null ids last.  Impacts are the scores' part without the term's weight.
    """
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    number: dict[bytes, int] = {}
    flat, n = [], np.empty(len(rows), np.int64)
    for at, i in enumerate(order):
        found = terms_of(rows[i][1])
        n[at] = len(found)
        flat.append(np.fromiter((number.setdefault(t, len(number)) for t in found), np.int64, len(found)))
    keys, tf = np.unique(np.concatenate(flat) * len(rows) + np.repeat(np.arange(len(rows)), n), return_counts=True)
    term, doc = keys // len(rows), keys % len(rows)
    m = 75 + 25 * n * documents // total
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    by = np.lexsort((doc, -impact, term))
    ids = [rows[i][0] for i in order]
    nulls = sum(x is None for x in ids)
    return {
        "docs": np.array([x or 0 for x in ids], np.int64).tobytes(), "nulls": nulls, "n_docs": len(ids),
        "sequence": doc[by].astype(np.uint32).tobytes(), "impacts": impact[by].astype(np.uint32).tobytes(),
        "terms": b" ".join(number), "starts": np.searchsorted(term, np.arange(len(number) + 1)).astype(np.uint32).tobytes(),
    }


def index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", postings: int = POSTINGS) -> tuple[DataFrame, int, int]:
    """The shards (a stored table), the number of documents with terms, and all their terms.

    A task closes a shard at about ``postings`` postings, or with the document that goes beyond them.
    """
    documents, total = corpus_totals(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def stored():
            shard = build(rows, documents, total)
            return pa.RecordBatch.from_arrays([pa.array([shard[k]], pa.int64() if k in ("nulls", "n_docs") else pa.binary()) for k in shard], names=list(shard))

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), shared.column_bytes(b.column("text"))):
                distinct = len(set(terms_of(t)))
                if not distinct:
                    continue
                if rows and held + distinct > postings:
                    yield stored()
                    rows, held = [], 0
                rows.append((i, t))
                held += distinct
        if rows:
            yield stored()

    shards = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, INDEX)
    return shared.materialise(shards, "shards"), documents, total


def frequencies(shards: DataFrame, wanted: set[bytes]) -> Counter:
    """How many documents hold each of the wanted terms (a block's, so bounded)."""
    sent = shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        total = Counter()
        for b in batches:
            for names, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist()):
                n = np.diff(np.frombuffer(starts, np.uint32))
                for i, t in enumerate(names.split(b" ")):
                    if t in sent.value:
                        total[t] += int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = shards.select("terms", "starts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sent.unpersist()
    return Counter({bytes(r.term): r.n for r in rows})


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The k best documents so far of each question: falling scores, then rising ids, null ids last."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.score = np.zeros((questions, k), np.int64)
        self.null = np.ones((questions, k), bool)
        self.doc = np.zeros((questions, k), np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        for one in np.unique(q):
            mine = q == one
            s, z, d = (np.concatenate((a[one], b[mine])) for a, b in ((self.score, score), (self.null, null), (self.doc, doc)))
            order = np.lexsort((d, z, -s))[: self.k]
            self.score[one], self.null[one], self.doc[one] = s[order], z[order], d[order]

    def worse(self, q: np.ndarray, bound: np.ndarray, null: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which bounds, with the first document below, cannot come in: not even by the tie."""
        s, z, d = self.score[q, -1], self.null[q, -1], self.doc[q, -1]
        tie = (null > z) | ((null == z) & (doc >= d))
        return (bound < s) | ((bound == s) & ((bound == 0) | tie))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of every span, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def look(shard: Shard, asked: list[tuple[np.ndarray, np.ndarray]], best: Best, step: int = STEP) -> int:
    """Best-first search of one shard for all questions at once; returns the nodes taken.

    ``asked``: each question's term numbers here and their weights (times repeats).  Nodes wait in flat
    arrays: question, level, leading bits, bound, and where their intervals lie in a pool.
    """
    count = np.array([len(t) for t, _ in asked])
    live = np.flatnonzero(count)
    if not len(live):
        return 0
    t, w = np.concatenate([asked[q][0] for q in live]), np.concatenate([asked[q][1] for q in live])
    lo, hi = shard.starts[t].astype(np.int64), shard.starts[t + 1].astype(np.int64)
    at = np.cumsum(count[live]) - count[live]
    q, level, code = live, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    bound, length, taken = np.add.reduceat(w * shard.impact[0, lo], at), count[live], 0
    first_null = len(shard.docs) - shard.nulls

    def hopeless(q, level, code, bound):
        first = code << (shard.depth - level)
        return best.worse(q, bound, first >= first_null, shard.docs[np.minimum(first, len(shard.docs) - 1)])

    while len(q):
        order = np.lexsort((level, -bound, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order], side="left")
        now = np.sort(order[place < step])
        taken += len(now)
        pick = _spans(at[now], length[now])
        node = np.repeat(np.arange(len(now)), length[now])
        kids = []
        for one in (False, True):
            a, b = shard.below(level[now][node], lo[pick], hi[pick], one)
            some = b > a
            a, b, n, ww = a[some], b[some], node[some], w[pick][some]
            if not len(n):
                continue
            head = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
            who, deeper = now[n[head]], level[now[n[head]]] + 1
            sums = np.add.reduceat(ww * shard.impact[deeper[np.cumsum(np.append(False, n[1:] != n[:-1]))], a], head)
            kids.append((q[who], deeper, 2 * code[who] + one, sums, np.diff(np.append(head, len(n))), a, b, ww))
        rest = np.ones(len(q), bool)
        rest[now] = False
        keep = _spans(at[rest], length[rest])
        kids.append((q[rest], level[rest], code[rest], bound[rest], length[rest], lo[keep], hi[keep], w[keep]))
        q, level, code, bound, length, lo, hi, w = (np.concatenate(c) for c in zip(*kids))
        leaf = np.flatnonzero(level == shard.depth)
        if len(leaf):
            leaf = leaf[~hopeless(q[leaf], level[leaf], code[leaf], bound[leaf])]
            best.add(q[leaf], bound[leaf], code[leaf] >= first_null, shard.docs[code[leaf]])
        stay = (level < shard.depth) & ~hopeless(q, level, code, bound)
        at = np.cumsum(length) - length
        keep = _spans(at[stay], length[stay])
        q, level, code, bound, length, lo, hi, w = q[stay], level[stay], code[stay], bound[stay], length[stay], lo[keep], hi[keep], w[keep]
        at = np.cumsum(length) - length
    return taken


def answers(shards: DataFrame, questions: list[tuple[int, dict[bytes, int]]], k: int = TOP, step: int = STEP) -> DataFrame:
    """``q, null, doc, score``: each task's ``k`` best documents for each of a block's questions.

    ``questions``: number and weights by term (times repeats).
    """
    numbers: dict[bytes, list[tuple[int, int]]] = {}
    for at, (_, weights) in enumerate(questions):
        for term, w in weights.items():
            numbers.setdefault(term, []).append((at, w))
    names = np.array([n for n, _ in questions], np.int64)
    sent = shards.sparkSession.sparkContext.broadcast((numbers, names))

    def run(batches):
        numbers, names = sent.value
        best = Best(len(names), k)
        for b in batches:
            for r in b.to_pylist():
                asked: list[tuple[list[int], list[int]]] = [([], []) for _ in names]
                terms = r["terms"].split(b" ")
                for i, term in enumerate(terms):
                    for at, w in numbers.get(term, ()):
                        asked[at][0].append(i)
                        asked[at][1].append(w)
                if not any(x for x, _ in asked):
                    continue
                read = lambda c, kind: np.frombuffer(r[c], kind)  # noqa: B023, E731
                shard = Shard(read("docs", np.int64), r["nulls"], read("sequence", np.uint32), read("impacts", np.uint32), terms, read("starts", np.uint32))
                look(shard, [(np.array(x, np.int64), np.array(y, np.int64)) for x, y in asked], best, step)
        q, place = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(best.null[q, place]), pa.array(best.doc[q, place]), pa.array(best.score[q, place])], names=["q", "null", "doc", "score"])

    return shards.mapInArrow(run, "q long, null boolean, doc long, score long")


def blocks(spark: SparkSession, asked: DataFrame, terms: int = BLOCK_TERMS, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, Counter]]]:
    """Blocks of questions (number, their terms with repeats) of a bounded size; one text alone may be larger."""
    block, held, long = [], 0, 0
    for r in asked.select("q", "text").orderBy("q").toLocalIterator(prefetchPartitions=False):
        found = Counter(terms_of((r.text or "").encode()))
        if block and (held + len(found) > terms or long + sum(map(len, found)) > size):
            yield block
            block, held, long = [], 0, 0
        block.append((r.q, found))
        held, long = held + len(found), long + sum(map(len, found))
    if block:
        yield block


def search(docs: DataFrame, questions: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", k: int = TOP, postings: int = POSTINGS, step: int = STEP) -> DataFrame:
    """item, rank (from 1), id, score: each question's ``k`` highest-scoring documents with a score above 0.

    A score is the sum over the question's terms, repeats included, of the term's weight
    floor(1000 ln((2N + 2) / (2 df + 1))) times floor(10^9 tf / (1000 tf + 12 m)), with m = 75 + floor(25 n N / L)
    for a document of n terms; all but the weight is in whole numbers.  Equal scores go by rising id, null ids
    last.  Repeated rows are documents of their own and each has a rank; repeated questions are answered once
    each.  Null, empty and term-less texts answer nothing and ask nothing.  Other columns are not read.  Ids are
    whole numbers.  Empty tables give an empty result.

    Questions go to the shards in blocks of a bounded size, whatever their number.
    """
    spark = docs.sparkSession
    asked = shared.materialise(questions.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"), F.col(query).alias("text")), "questions")
    shards, documents, total = index(docs, id_col, text, postings)
    found = None
    for block in blocks(spark, asked):
        df = frequencies(shards, {t for _, c in block for t in c})
        weighted = [(q, {t: n * weight(documents, df[t]) for t, n in c.items() if df[t]}) for q, c in block]
        part = shared.materialise(answers(shards, weighted, k, step), "found")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "q long, null boolean, doc long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "null", "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    doc = F.when(~F.col("null"), F.col("doc")).cast(docs.schema[id_col].dataType)
    return ranked.join(asked.select("q", "item"), "q").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), doc.alias(id_col), "score")
