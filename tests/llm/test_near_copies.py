"""The near-copy stage's exact comparison: right links, no merge per pair, texts shuffled once at most."""

import numpy as np
from pyspark.sql import functions as F

from quarrygraph.llm import simhash


def some_sets(n, rng):
    words = rng.integers(0, 2**63, 150).astype(np.uint64)
    out = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    while len(out) < n:
        x = out[rng.integers(len(out))]
        x = x[rng.random(len(x)) < 0.9] if rng.random() < 0.5 else rng.choice(words, rng.integers(1, 50))
        out.append(np.unique(np.concatenate([x, rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])))
    return out


def brute(sets, similarity, classes=None):
    root = np.arange(len(sets)) if classes is None else np.array([list(classes).index(c) for c in classes])
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            union = len(np.union1d(a, sets[j]))
            if len(a) + len(sets[j]) - union + 1e-9 >= similarity * union:
                x, y = sorted((root[i], root[j]))
                root[root == y] = x
    return root


def test_links_of_sets_equal_brute_force():
    rng = np.random.default_rng(3)
    for turn in range(20):
        sets = some_sets(int(rng.integers(2, 90)), rng)
        fps = np.zeros((len(sets), 4), np.uint64)
        classes = rng.integers(0, 100, len(sets)) if turn % 2 else None
        assert (simhash.set_links(sets, fps, 1, 0.8, classes) == brute(sets, 0.8, classes)).all()


def test_unlike_sets_are_not_merged_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(np.arange(1000, dtype=np.uint64), 200)) for _ in range(100)]
    merged, union = [], np.union1d
    monkeypatch.setattr(np, "union1d", lambda a, b: merged.append(1) or union(a, b))
    assert (simhash.set_links(sets, np.zeros((100, 4), np.uint64), 1, 0.8) == np.arange(100)).all()
    assert len(merged) < len(sets)


def test_comparisons_are_dealt_to_all_partitions(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("group"), F.col("id").alias("node"), F.lit(b"\0" * 32).alias("fp"), F.col("id").alias("class"), F.concat(F.lit("one two three four five "), F.col("id").cast("string")).alias("text"))
    links = simhash.exact_links(rows, 10, 0.8, 5)
    links.write.format("noop").mode("overwrite").save()
    assert links.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
