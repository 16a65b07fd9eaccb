"""Ranked search against a plain scoring of all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest

from quarrygraph.llm import lexical_search as ls

SCHEMA = "doc_id long, text string, score string, rank int, q long, terms string, docs string"
ASKED = "item_id long, text string, doc_id long, score double"


def terms(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(ls.TERM, lower)


def plain(docs, questions, k):
    split = [(r[0], terms(r[1])) for r in docs]
    split = [(i, t) for i, t in split if t]
    n, total = len(split), sum(len(t) for _, t in split)
    df = collections.Counter(x for _, t in split for x in set(t))
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    counted = [(i, len(t), collections.Counter(t)) for i, t in split]
    out = []
    for item, q in ((r[0], terms(r[1])) for r in questions):
        found = []
        for i, size, tf in counted:
            m = 100 - 25 + 25 * size * n // total
            s = sum(w[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in q if t in tf)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé7", k=rng.randint(1, 5))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(len(words))]
    line = lambda n: " ".join(rng.choices(words, weights, k=n))
    passage = line(30)
    docs = [(i, line(rng.randint(1, 120))) for i in range(300)] + [(400 + i, f"{line(20)}. {passage}!") for i in range(5)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]
    docs += [(2000, None), (2001, ""), (2002, " .,;\n"), (2003, "Ünï CÖDÉ日本 — naïve_x-y"), (2004, line(20000)), (None, passage), (None, "no id"), docs[3], docs[3]]
    asked = [(i, line(rng.randint(1, 25))) for i in range(12)] + [(50, passage), (51, docs[7][1]), (52, ""), (53, None), (54, "zzzz"), (55, "CÖDÉ日本 ünï É"), (None, "a b"), (12, "a a a b"), (12, "c d")]
    rng.shuffle(docs)
    return [(*r, "x", 1, 2, "y", "z") for r in docs], [(*r, 5, 0.5) for r in asked]


@pytest.mark.parametrize("k,postings,step,parts", [(20, 1 << 19, 64, 3), (20, 300, 1, 4), (3, 2000, 8, 1), (1000, 4000, 64, 2)])
def test_search(spark, k, postings, step, parts):
    docs, asked = corpus()
    got = ls.search(spark.createDataFrame(docs, SCHEMA).repartition(parts), spark.createDataFrame(asked, ASKED), k=k, postings=postings, step=step)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, asked, k)


def test_blocks_of_questions(spark, monkeypatch):
    docs, asked = corpus()
    monkeypatch.setattr(ls.blocks, "__defaults__", (40, 1 << 20))
    got = ls.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(asked, ASKED))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, asked, ls.TOP)


def test_empty_tables(spark):
    docs, asked = corpus()
    d, q = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(asked, ASKED)
    assert ls.search(d.limit(0), q).count() == ls.search(d, q.limit(0)).count() == ls.search(d.filter("doc_id = 2000"), q).count() == 0
    assert ls.search(d.limit(0), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_prune():
    docs, asked = corpus()
    split = [t for _, t in ((r[0], terms(r[1])) for r in docs) if t]
    n, total = len(split), sum(map(len, split))
    stored = ls.build([(r[0], r[1].encode()) for r in docs if terms(r[1])], n, total)
    names = stored["terms"].split(b" ")
    starts = np.frombuffer(stored["starts"], np.uint32)
    shard = ls.Shard(np.frombuffer(stored["docs"], np.int64), stored["nulls"], np.frombuffer(stored["sequence"], np.uint32), np.frombuffer(stored["impacts"], np.uint32), names, starts)
    at = {t: i for i, t in enumerate(names)}
    q = [at[t] for t in dict.fromkeys(ls.terms_of(asked[12][1].encode()))]
    w = np.array([ls.weight(n, int(starts[t + 1] - starts[t])) for t in q])
    best = ls.Best(1, 5)
    # five documents hold the question's passage: few nodes beyond the way to these
    taken = ls.look(shard, [(np.array(q), w)], best, 4)
    assert (best.score > 0).all() and taken < len(split) / 2
