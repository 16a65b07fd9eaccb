"""Vector codes against plain Lloyd over all parts, in Python's own integers."""

import hashlib
import math
import random

import pytest

from quarrygraph.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, g int, row int, pos int"


def plain(rows, entries, rounds, parts=4):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = sorted(([math.floor(1024 * x) for x in r[1]], r) for r in kept)
    whole.sort(key=lambda w: (w[1][0] is None, w[1][0] or 0))
    size = len(whole[0][0]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for v, _ in whole] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [c[:entries] for c in cut]
    best = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            at = [best(p, v) for v in cut[p]]
            groups = [[v for v, e in zip(cut[p], at) if e == k] for k in range(len(books[p]))]
            moved.append([tuple(sum(c) // len(g) for c in zip(*g)) if g else books[p][k] for k, g in enumerate(groups)])
        books = moved
    out = []
    for i, (_, r) in enumerate(whole):
        at = [best(p, cut[p][i]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for e in at), sum(far(cut[p][i], books[p][at[p]]) for p in range(parts))))
    by = {}
    for _, label, _, e in out:
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, lab, c, e, by[lab]) for i, lab, c, e in out), key=str), digest


def rows(scale=1.0, n=300, dim=8):
    rng = random.Random(3)
    vec = lambda: [round(rng.gauss(0, 1), 1) * scale for _ in range(dim)]
    common = vec()
    out = [(i, vec() if i % 3 else common, rng.choice([0, 1, None])) for i in range(n)]
    out += [(900, None, 1), (901, [], 1), (902, [None] * dim, 2), (903, [float("nan")] * dim, 2), (904, [float("inf")] + [0.0] * (dim - 1), 1), (None, vec(), None), out[4], out[4]]
    return [(*r, "x", "y", 1, 2, 3) for r in out]


@pytest.mark.parametrize("entries,rounds,scale", [(16, 4, 1.0), (256, 2, 1.0), (3, 4, 1e4), (1000, 1, 1.0)])
def test_codes(spark, entries, rounds, scale):
    data = rows(scale)
    codes, books = vector_codes.compress(spark.createDataFrame(data, SCHEMA).repartition(5), entries=entries, rounds=rounds, group=20)
    want, digest = plain(data, entries, rounds)
    if entries > 256:
        want = [(i, lab, c, e, s) for i, lab, c, e, s in want]
        got = sorted(((r.vec_id, r.label, r.error, r.label_error) for r in codes.collect()), key=str)
        assert got == sorted(((i, lab, e, s) for i, lab, _, e, s in want), key=str)
    else:
        assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in codes.collect()), key=str) == want
    assert vector_codes.digest(books) == digest


def test_decode_and_odd_tables(spark):
    data = rows(n=40)
    codes, books = vector_codes.compress(spark.createDataFrame(data, SCHEMA), entries=8)
    by_id = {r[0]: [math.floor(1024 * x) for x in r[1]] for r in data[:40]}
    for r in vector_codes.decode(codes.filter("vec_id < 40"), books).collect():
        assert sum((a - b) ** 2 for a, b in zip(by_id[r.vec_id], r.vector)) == r.error
    none, books = vector_codes.compress(spark.createDataFrame(data[300:], SCHEMA).limit(0))
    assert none.count() == 0 and books == [] and none.columns == ["vec_id", "label", "code", "error", "label_error"]
    with pytest.raises(Exception, match="dimension"):
        vector_codes.compress(spark.createDataFrame([data[0], (7, [1.0] * 12, 1, *data[0][3:])], SCHEMA))[0].collect()
