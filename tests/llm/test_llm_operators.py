"""Each training-data operator against brute force, on rows with every odd case."""

import collections
import hashlib
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrygraph.llm import components, differencing, hmm, mixing, ogg, packing, queries, sharding, simhash, substring_dedup, toxicity, vector_search, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, block_ string, n_words string, shard string, bucket string, part string"


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    passage = line(60)
    out = [None, "", "   \n\t", "one", "one two", "Ünï cödé — ok", "\x1c sep \x1f", line(12000), passage]
    out += [line(rng.randint(1, 200)) for _ in range(50)]
    out += [f"{line(20)} {passage} {line(20)}" for _ in range(6)]
    base = line(150)
    out += [base] * 5 + [base.replace(base.split()[i], "zz", 1) for i in (3, 70, 120)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or ""), *"xxxxxxx") for i, t in enumerate(texts())]
    return out + [out[20], out[20], (None, "no id here", "en", "a", 1, *"xxxxxxx")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_hmm(docs, rows, none):
    got = hmm.score(docs, rounds=1).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = collections.Counter()
    for r in rows:
        if not held(r[0]):
            c.update((r[1] or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in rows:
        w = (r[1] or "").encode().lower().split() + [None]
        base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(base, 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(none).count() == 0


def test_hmm_learns_from_long_documents_alone(spark, monkeypatch):
    rng = random.Random(6)
    table = spark.createDataFrame([(i, " ".join(rng.choices("a b c d".split() if i % 2 else "e f g h".split(), k=2500))) for i in range(12)], "doc_id long, text string")
    encoded, of_class = hmm.encode(table)
    start = hmm.Model.random((of_class + 0.5) / (of_class + 0.5).sum())
    model = hmm.train(encoded, of_class)
    assert not np.allclose(model.emit, start.emit)
    # converged: another round over all documents gains less than GAIN a token
    blobs = [bytes(r.classes) for r in encoded.filter("not held_out").collect()]
    prior = (of_class + 0.5) / (of_class + 0.5).sum()
    batch = hmm._batch_of(blobs)
    now = batch.forward(model, False).sum()
    then = batch.forward(hmm.Model.of_counts(*batch.expected(model), prior), False).sum()
    assert then - now < hmm.GAIN * of_class.sum()
    monkeypatch.setattr(hmm, "START_ROUNDS", 0)
    far = hmm.train(encoded, of_class, rounds=1)
    near = hmm.train(encoded, of_class)
    assert batch.forward(near, False).sum() > batch.forward(far, False).sum()


def test_hmm_recursions_equal_sums_over_paths():
    rng = np.random.default_rng(0)
    s, m = hmm.STATES, 6
    unit = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm.Model(unit(rng.random(s)), unit(rng.random((s, s))), unit(rng.random((s, m))).T)
    seqs = [np.array(x, "<u2") for x in ([1, 2, 0], [3], [5, 5, 1, 0], [2, 0])]
    batch = hmm._batch_of([x.tobytes() for x in seqs])
    got = batch.forward(model, False)
    starts, steps, emits = np.zeros(s), np.zeros((s, s)), np.zeros((s, m))
    for x, g in zip(seqs, got):
        total = 0.0
        paths = [(p,) for p in range(s)]
        for _ in x[1:]:
            paths = [(*p, q) for p in paths for q in range(s)]
        each = []
        for p in paths:
            w = model.start[p[0]] * model.emit[x[0], p[0]]
            for a, b, o in zip(p, p[1:], x[1:]):
                w *= model.step[a, b] * model.emit[o, b]
            total += w
            each.append(w)
        assert np.isclose(np.log(total), g)
        for p, w in zip(paths, each):
            starts[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                steps[a, b] += w / total
            for o, q in zip(x, p):
                emits[q, o] += w / total
    for mine, theirs in zip(batch.expected(model), (starts, steps, emits)):
        assert np.allclose(mine, theirs)


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()

    def slow(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [slow(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = collections.Counter((r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows))
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_bit_sliced_distances_and_chunks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 9, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for b in base]))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3

    def classes(pairs, n):
        f = simhash.Forest(n)
        f.link(*pairs)
        return f.roots().tolist()

    want = classes(np.nonzero(near), len(fps))
    assert simhash.bucket_links(fps[:, None], np.array([len(fps)]), 3).tolist() == want
    kinds = spark.createDataFrame([(int(x.view(np.int64)), bytearray(x.tobytes()), [1]) for x in fps], "node long, fp binary, keys array<long>")
    at = {int(x.view(np.int64)): i for i, x in enumerate(fps)}
    # one hot key, and the masks of the bands made finer until groups are small
    groups = simhash.band_groups(kinds.select("node", "fp"), 3, chunk=6)
    assert groups.groupBy("group").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0] <= 6
    for edges in (simhash.linked(kinds.select("node", F.lit(1).cast("long").alias("key")), lambda g: simhash.near_links(g.join(kinds, "node"), 3), chunk=50, pivots=2), simhash.near_links(groups, 3)):
        edges = [(at[r.a], at[r.b]) for r in edges.collect()]
        assert classes(tuple(np.array(edges).T), len(fps)) == want
    assert simhash.finer((1 << 62) - 1, 3) == [(1 << 62) - 1 | 1 << 62, (1 << 62) - 1 | 1 << 63]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_similar_groups(docs, rows):
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    first = [r[1] for r in rows].index(rows[65][1])
    assert all(got[i] == first for i in range(65, 73)) and got[10] == 10


def test_similar_groups_are_exact(spark):
    """Pairs just below and above 0.8, short texts and repeated lines, against brute force."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    out = []
    for _ in range(40):
        short = line(9)
        out += [short, short.rsplit(" ", 1)[0]]  # 4 of 5 shingles
        for left in (76, 77, 79, 80, 81, 84):  # of 100 shingles, the others lost at the end
            full = line(104)
            out += [full, " ".join(full.split()[: left + 4])]
        passage = line(40)
        other = line(6)
        out += [f"{passage} {passage} {other}", " ".join([passage] * 60 + [other])]
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in out]
    want = {i: i - (i % 2 and 5 * len(sets[i] & sets[i - 1]) >= 4 * len(sets[i] | sets[i - 1])) for i in range(len(out))}
    assert 0 < sum(want[i] != i for i in want) < len(out) / 2
    table = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(table).collect()} == want


def test_chunks_of_candidates_are_exact(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(60)]
    out = [" ".join(words[i:]) for i in range(30)]
    table = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for chunk in (4, 512) for r in simhash.similar_groups(table, chunk=chunk).collect()}
    assert set(got.values()) == {0}
    # a large group of copies of one text, some far from each other, and a second group beside it
    base = [rng.choices(words, k=1)[0] + str(i) for i in range(100)]
    copies = []
    for g in range(2):
        body = base[: 60 + 20 * g] + [f"g{g}x{i}" for i in range(40 - 20 * g)]
        for i in range(60):
            mine = list(body)
            for at in rng.sample(range(100), 2):
                mine[at] = f"edit{rng.random()}"
            copies.append(" ".join(mine))
    sets = [simhash.np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in copies]
    parent = list(range(len(copies)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(copies)):
        for j in range(i):
            both = len(np.union1d(sets[i], sets[j]))
            if (len(sets[i]) + len(sets[j]) - both) / both >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(copies))}
    table = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(table, chunk=10).collect()} == want


def test_near_copies_without_and_with_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(4)
    a, b, c, d, e = (" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(80)) for _ in range(5))
    given = [(None, a), (None, b), (None, b), (1, b), (2, c), (2, c), (3, d), (3, e), (4, e), (None, None)]
    table = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table, "").collect())
    assert got == collections.Counter([(None, a), (1, b), (2, c), (3, d), (3, e), (None, None)])


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, with_ids=True).collect()
    want = collections.Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), 4096):
            p = ids[a : a + 4096]
            want[r[0], a, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for p in by.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(none, path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    enc = packing.Encoder(queries.tokenizer_path())
    rng = random.Random(2)
    for _ in range(5000):
        w = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCÄöüßéç'.,!?1-", k=rng.randint(1, 12)))
        assert enc.ids(w) == enc.whole(w)


def test_word_encoder_knows_every_token_of_the_vocabulary():
    """Each token's text, at a word's end and before further letters, gives the tokenizer's ids."""
    enc = packing.Encoder(queries.tokenizer_path())
    rng = random.Random(3)
    tokens = sorted(enc.tokenizer.get_vocab(), key=str)
    words = [w for t in tokens if packing._COMMON.fullmatch(w := enc.tokenizer.decode([enc.tokenizer.token_to_id(t)]).strip())]
    assert len(words) > 10_000
    both = [*words, *(a + b for a, b in zip(words, rng.sample(words, len(words))) if packing._COMMON.fullmatch(a + b))]
    wrong = [w for w, e in zip(both, enc.tokenizer.encode_batch(both, add_special_tokens=False)) if enc.ids(w) != array("I", e.ids).tobytes()]
    assert wrong == []


def test_differencing():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1000, 500)
    part, sums = differencing.spread_numbers(x, 8)
    assert (np.bincount(part, x, 8) == sums).all() and sums.max() - sums.min() <= 2
    total, where = differencing.difference([np.array([v, 0, 0]) for v in x[:50]])
    check = np.zeros(3)
    for v, w in zip(x, where):
        check[w[0]] += v
    assert sorted(check) == sorted(total)


def test_ogg(docs, rows, none):
    got = ogg.from_media(ogg.to_media(docs)).collect()
    want = collections.Counter()
    for r in rows:
        t = (r[1] or "").encode()
        p = t + bytes(-len(t) % 64 if t else 64)
        want[r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    media = ogg.encode(b"x" * 200_000, 7)
    back = ogg.decode(media)
    assert back["payload"] == b"x" * 200_000 and back["n_bytes"] == 7 and back["streams"] == 2 and back["times"][-1] == 25.0
    for broken in (media[:-1], media[:500] + b"y" + media[501:], media[100:]):
        with pytest.raises(ogg.OggError):
            ogg.decode(broken)
    odd = [(b"h", 0), (b"a" * 255, 1), (b"", 2), (b"b" * 70_000, 3)]
    assert [p for p, _ in ogg.demultiplex(b"".join(ogg.pages_of(odd, 1)))[0][1]] == [p for p, _ in odd]

    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    assert ogg.checksum(media[:300]) == slow(media[:300])
    assert ogg.from_media(ogg.to_media(none)).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and left * weight[s] / open_ > 2 * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * sizes[s] if s in full else left * weight[s] / open_ for s in names}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = {s: max(len(words(r[1])) for r in rows if r[3] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], 0.5 * largest[s]) for s in names)
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(none).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ren", "ta", "su"], k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["vilebad", "grotsk"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "lo v1lebad ta"), (1001, "ka v i l e b a d mi"), (1002, "su viiiilebad"), (1003, None), (1004, ""), (1005, "lo gr0tsk"), (None, "ka lo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert [got[i].predicted for i in range(1000, 1006)] == [1, 1, 1, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = toxicity.fit(none, lab.limit(0))
    assert toxicity.scores(none, empty).count() == 0


def test_repeated_passages_keep_one_of_equal_rows(spark):
    import corpus_pipeline

    rng = random.Random(7)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    whole, passage = line(80), line(50)
    out = [(1, whole), (1, whole), (None, whole), (2, None), (3, ""), (4, f"{line(10)} {passage}"), (5, f"{passage} {line(10)}"), (None, line(40))]
    rows = [(i, t, "en", "a", len(t or ""), "x") for i, t in out]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    got = sorted(((r.doc_id, r.text, r.n_chars, r.n_words) for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()), key=str)
    parts = [out[5][1].split()[:10], out[6][1].split()[50:]]
    want = [(1, whole), (2, None), (3, ""), (4, " ".join(parts[0])), (5, " ".join(parts[1])), out[7]]
    assert got == sorted(((i, t, len(t or ""), "x") for i, t in want), key=str)
    assert corpus_pipeline.drop_repeated_passages(spark, docs.limit(0), "").count() == 0


def test_shards_are_balanced_at_every_depth(spark):
    """Against greedy placing, the largest group and an exact search; lumps of lumps too."""
    import itertools

    rng = random.Random(2)
    sizes = [int(rng.paretovariate(1.2) * 20) for _ in range(3000)]
    rows = spark.createDataFrame([(bytearray(f"{i}".encode()), n) for i, n in enumerate(sizes)], "group binary, size long")
    greedy = [0] * 8
    for n in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += n
    for how in ({}, {"per_bucket": 60, "most": 700}):
        placed = {bytes(r.group): r.shard for r in sharding.groups_to_shards(rows, **how).collect()}
        assert len(placed) == 3000
        total = collections.Counter()
        for i, n in enumerate(sizes):
            total[placed[f"{i}".encode()]] += n
        assert len(total) == 8 and max(total.values()) - min(total.values()) <= max(2 * (max(greedy) - min(greedy)), 8)
    few = [31, 27, 22, 18, 13, 11, 7, 5]
    _, sums = differencing.spread_numbers(np.array(few), 2)
    best = min(max(x, sum(few) - x) for c in itertools.product((0, 1), repeat=8) for x in [sum(n for n, b in zip(few, c) if b)])
    assert max(sums) <= best + 3


def test_viterbi_takes_the_best_of_all_paths():
    rng = np.random.default_rng(8)
    counts = rng.gamma(0.3, 20, (29, 29, 29))
    d = toxicity.Decoder(counts)
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27

    def cost(path):
        word = [0, 0] + [code(c) for c, _ in path if c] + [0]
        return sum(q for _, q in path) + sum(d.log[a][b][c] for a, b, c in zip(word, word[1:], word[2:]))

    letters = list("abcé01!@.- ") + ["aa", "bb", "ccc", "..", "00"]
    for _ in range(300):
        token = "".join(rng.choice(letters, rng.integers(1, 6)).tolist()).strip()
        paths = [[]]
        for options in d.readings(token):
            paths = [p + [o] for p in paths for o in options]
        best = max(map(cost, paths), default=0.0)
        words = {"".join(c for c, _ in p) for p in paths if cost(p) > best - 1e-9}
        assert d.viterbi(token) in words and d.decode(token) in words


def test_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:1000] = x[700]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (5080, [1.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "q", "list", "ids")})
    got = collections.defaultdict(list)
    for r in vector_search.search(v, v.filter("vec_id % 20 = 0"), per_list=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = (x @ x[q]).round(9)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        hit += len({i for i, _ in got[q]} & set(want.tolist()))
        assert len(got[q]) == 20 and all(abs(s[i] - y) < 1e-8 for i, y in got[q])
    assert hit / (20 * 75) >= 0.9 and set(got) == set(range(0, 1500, 20))
    # the hot vector's ids are each other's answers, the smallest ones first
    assert [i for i, _ in got[980]][:5] == [700, 701, 702, 703, 704] and 980 not in [i for i, _ in got[980]]
    assert [i for i, _ in got[700]][:2] == [701, 702]
    few = v.filter("vec_id < 8")
    assert vector_search.search(few, few.filter("vec_id % 20 = 0")).count() == 7
    assert vector_search.search(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 401, 1500])
def test_walk(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12))
    c = vector_search.linked(spark.createDataFrame([(r.tolist(),) for r in x], "point array<double>").repartition(3))
    assert sorted(map(tuple, c.points)) == sorted(map(tuple, x))
    # links of the nearest blocks are mostly the nearest ones of all
    true = np.argsort(vector_search._distances(c.points, c.points), axis=1)[:, 1:11]
    if n > 24:
        assert np.mean([len(set(t) & set(g)) / 10 for t, g in zip(true.tolist(), c.graph[:, :24].tolist())]) >= 0.7
    q = rng.normal(size=(40, 12))
    exact = np.sort(np.sqrt(vector_search._distances(q, c.points)), axis=1)
    ids, dist = c.walk(q, vector_search.BEAM)
    assert all(len(set(r.tolist())) == len(r) for r in ids) and (ids >= 0).all()
    assert (np.abs(dist[:, : min(n, 10)] - exact[:, :10]) < 1e-9).mean() >= 0.95
    every, d = c.walk(q, 2 * n)
    assert np.allclose(d, exact) and all(sorted(r) == list(range(n)) for r in every.tolist())
    c.size[:] = 100
    a, lists = c.lists_for(q, 1.1, 500, vector_search.BEAM)
    kept = 0
    for i in range(len(q)):
        d = np.sqrt(vector_search._distances(q[i : i + 1], c.points))[0]
        want = set(np.flatnonzero(d <= 1.1 * d.min()).tolist()) | set(np.argsort(d)[:5].tolist())
        have = set(lists[a == i].tolist())
        assert len(have) == (a == i).sum()
        kept += len(have & want) / len(want)
    assert kept >= 0.95 * len(q)


def test_search_walks_to_a_few_lists_of_many(spark, monkeypatch):
    """40,000 clustered vectors, about 640 lists: recall 0.9 from less than 0.3 of the rows, no more bytes than allowed."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(500, 16))
    x = (middle[np.arange(40_000) % 500] + 0.15 * rng.normal(size=(40_000, 16))).astype(np.float32)
    v = spark.createDataFrame(pa.table({"vec_id": np.arange(40_000), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    fits = []
    plain = vector_search.fit
    monkeypatch.setattr(vector_search, "fit", lambda *a, **k: fits.append(plain(*a, **k)) or fits[-1])
    ratios = []
    needed = vector_search.needed_ratio
    monkeypatch.setattr(vector_search, "needed_ratio", lambda *a, **k: ratios.append(needed(*a, **k)) or ratios[-1])
    asked = np.arange(0, 40_000, 200)
    rows = vector_search.search(v, v.filter("vec_id % 200 = 0")).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
    x = x.astype(float)
    hit = 0
    for q in asked.tolist():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hit / (20 * len(asked)) >= 0.9
    c, top = fits[0]
    assert len(c.points) > 4 * vector_search.BEAM and c.size.sum() == 40_000
    a, lists = c.lists_for(np.hstack((x[asked], np.zeros((len(asked), 1)))), ratios[0], 21, vector_search.BEAM)
    read = c.size[lists].sum() / len(asked) / 40_000
    print("recall", hit / (20 * len(asked)), "read", read, "ratio", ratios[0])
    assert read < 0.3
    small, _ = plain(vector_search.kinds_of(vector_search.usable(v), 21), most_bytes=100_000)
    assert 20 < len(small.points) and len(small.points) * 8 * 52 <= 100_000


def test_search_in_cells_of_lists(spark):
    """Two-level centroids, small segments, clustered vectors: most of the lists stay unread."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(120, 16))
    x = np.concatenate([middle[i % 120] + 0.15 * rng.normal(size=16) for i in range(6000)]).reshape(-1, 16)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    seen = []
    plain = vector_search.needed_ratio
    vector_search.needed_ratio = lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1]
    try:
        rows = vector_search.search(v, v.filter("vec_id % 20 = 0"), per_list=20, coarse=8, segment=100).collect()
    finally:
        vector_search.needed_ratio = plain
    got = collections.defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / 6000 >= 0.9 and 1 <= seen[0] < 1.6
    fitted, top = vector_search.fit(vector_search.kinds_of(vector_search.usable(v), 21), per_list=20, coarse=8)
    assert 150 < len(fitted.points) < 900
    fitted.size[:] = np.bincount(vector_search._nearest(vector_search._lifted(x, top), fitted.points), minlength=len(fitted.points))
    a, lists = fitted.lists_for(np.hstack((x[::20], np.zeros((300, 1)))), seen[0], 21, 128)
    assert fitted.size[lists].sum() / 300 < 0.3 * 6000


def test_search_ids_with_several_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 5.0]), (2, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vector_search.search(v, v.filter("vec_id = 20")).collect()]
    assert sorted(got) == [(20, 1, 1, 5.0), (20, 2, 2, 0.5)]


def test_substring_dedup(docs, rows, none):
    got = substring_dedup.remove_repeats(docs).collect()
    count = collections.Counter(b" ".join(words(r[1])[s : s + 35]) for r in rows for s in range(len(words(r[1])) - 34))
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        gone = set()
        for s in range(len(w) - 34):
            if count[b" ".join(w[s : s + 35])] > 1:
                gone.update(range(s, s + 35))
        want[r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_sharding(docs, rows, none):
    got = sharding.shard(docs).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    of_text = collections.defaultdict(set)
    for r in got:
        of_text[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in of_text.values())
    assert sharding.shard(none).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/x", "<p>one</p>", 1), (2, "http://b/ y\n", "<p>one</p>", 1), (9, None, "<p>one</p>", 1), (3, "http://c", None, 1), (4, "", "", 1), (5, "u", "a\r\n\r\nb\nWARC/1.1", 1), (None, "n", "<p>one</p>", 1), (7, "v", "é" * 9000, 1), (7, "v", "é" * 9000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, key int")
    got = sorted((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(warc.archive(df)).collect())
    want = []
    top = {"<p>one</p>": 9, "": 4, "a\r\n\r\nb\nWARC/1.1": 5, "é" * 9000: 7}
    for i, _, h, _ in pages:
        h = h or ""
        own = i == top[h]
        want.append((str(i), len(h.encode()), warc.digest_of(h.encode()), "response" if own else "revisit", None if own else top[h]))
    assert got == sorted(want)
    named = [("", "x"), (None, "x"), ("a%+b é", "y"), ("", "y"), ("", "z"), ("", "z"), (None, "z"), ("%", "w"), (None, "v")]
    df_named = spark.createDataFrame([(k, "u", h) for k, h in named], "page_id string, url string, html string")
    of = {warc.digest_of(h.encode()): h for _, h in named}
    got = sorted((str(r.key), of[r.payload_digest], r.record_type, r.refers_to) for r in warc.read_warc(warc.archive(df_named), "string").collect())
    best = {"x": "", "y": "a%+b é", "z": "", "w": "%", "v": None}
    assert got == sorted((str(k), h, "response" if k == best[h] else "revisit", None if k == best[h] else best[h]) for k, h in named)
    for version in (1, 2):
        body = warc.arc_head(version, "n.arc") + warc.arc_record(version, "n.arc", 0, "1", "u", b"x")
        assert next(warc.parse_arc(body))["payload"] == b"x"
        with pytest.raises(ValueError):
            list(warc.parse_arc(body[:-3]))
    assert warc.read_warc(warc.archive(df.limit(0))).count() == 0


def insults():
    raw = b"you are a stupid ass i am a idiot shit the stupid idiot ass shit " * 50
    c = toxicity._CODE[np.frombuffer(raw, np.uint8)].astype(int)
    counts = np.zeros((toxicity._A,) * 3)
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    return toxicity.Decoder(counts)


def test_words_of_spaced_runs():
    decoder = insults()
    forms = {"you are a s t u p i d": {"stupid"}, "s t u p i d i d i o t": {"stupid", "idiot"}, "s t u   p i d": {"stupid"}, "st up id": {"stupid"}, "s. t. u. p. i. d.": {"stupid"}, "I s \t t\n\nu p 1 d": {"stupid"}, "\u00e9 t \u00e9": {"\u00e9t\u00e9"}}
    assert {f: got for f, w in forms.items() if not w & (got := toxicity.spaced(f.encode(), decoder.decode))} == {}
    assert {"stupid", "idiot"} <= toxicity.spaced(b"s t u p i d i d i o t", decoder.decode)


def test_every_odd_token_is_decoded():
    decoder = insults()
    forms = {"a$$": "ass", "a55": "ass", "5h17": "shit", "1d107": "idiot", "!d!07": "idiot", "iddiioott": "idiot", "s=t=u=p=i=d": "stupid", "s?t?u?p?i?d": "stupid", "s·t·u·p·i·d": "stupid", "s%t&u=p\"i?d": "stupid"}
    assert {f: w for f, w in forms.items() if w not in toxicity.restored(f, decoder)} == {}


@pytest.mark.parametrize("empty", [["", None, " \n"], ["", None, " \n"] * 3])
def test_mixing_of_sources_without_words(spark, empty):
    import corpus_pipeline

    whole = [(i, "a b c " * (i % 7 + 1), "b") for i in range(20)] if len(empty) == 3 else []
    docs = spark.createDataFrame(whole + [(100 + i, t, ["a", None, "z"][i % 3]) for i, t in enumerate(empty)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken == r.copies == r.target == r.source_size == 0 for r in got if r.source != "b")
    sizes = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "/nowhere").collect()
    taken = sum(r.taken for r in got)
    assert sum(sizes[r.doc_id] for r in mixed) == taken and abs(taken - 1.5 * sum(sizes.values())) <= 0.5 * max(sizes.values())
    assert all(sizes[r.doc_id] for r in mixed)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    n = docs.count()
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    kept = corpus_pipeline.drop_toxic(spark, docs, d)
    assert kept.columns == docs.columns and 0 < kept.count() < n


def test_hot_keys_of_unlike_texts_stay_linear(spark):
    """Unlike documents under one licence text: few rows are compared, and no link is lost."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    licence = [word() for _ in range(90)]
    texts = []
    for i in range(1200):
        own = [word() for _ in range(40)]
        texts.append(" ".join(licence + own))
        if i % 100 == 0:  # a near copy of it, one word apart
            texts.append(" ".join(licence + own[:-1] + [word()]))
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(4)
    keys = simhash.prefix_keys(table, 0.8, 5)
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    pairs = {(i, i + 1) for i in range(len(texts) - 1) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert len(pairs) == 12
    compared = []

    def compare(groups):
        compared.append(groups.count())
        exact = groups.join(table.withColumn("fp", F.unhex(F.lit("00" * 8))), "node")
        return simhash.exact_links(exact, 64, 0.8, 5)

    hot = table.select("node", F.lit(1).cast("long").alias("key"))
    edges = simhash.linked(hot, compare, chunk=20, pivots=2, finer=lambda nodes: keys.join(nodes, "node", "left_semi"))
    assert {tuple(sorted((r.a, r.b))) for r in edges.collect()} == pairs
    assert sum(compared) < 2 * len(texts)
