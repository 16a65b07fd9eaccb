"""Hidden Markov language model over all documents.

Emission: state s emits the class C of a word, and the class its word,
p(w|s) = p(C(w)|s) * p(w|C(w)).  Words that make up at least a ``FREQUENT``-th of the training
tokens are classes of their own (so there are at most ``FREQUENT`` of them, whatever the corpus);
other words share a class by their spelling, and within it p(w|C) = (c + 0.5) / (N_C + 0.5 (V_C + 1)),
whose spare half is the class's one unknown word.  The end is a class too, so the score of a text is
the probability of exactly that text.

Counts c, N, V are exact over all training documents; they travel in packed rows between blocks and
buckets (see ``shared``).  Training: start values from a bounded sample, then Baum-Welch rounds over
every training document until a round gains less than ``GAIN`` nats a token; expected counts are
summed across partitions as rows (class, counts by state).  Scoring: the scaled forward recursion over the whole text.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

STATES = 8
FREQUENT = 8192
SPELLINGS = 2048
#: Training ends when a round over all documents raises their log likelihood by less, in nats a token.
GAIN = 1e-3
#: Only for the start values: documents of any length, consecutive words taken of each, and rounds.
START_DOCS, START_WORDS, START_ROUNDS = 1500, 2048, 25
_BATCH = 1_000_000
_SMOOTH_CLASS, _SMOOTH_STEP = 0.02, 0.5


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def spelling(word: bytes) -> int:
    """Class of a rare word: by its last letters and the kinds of characters that it holds."""
    kind = (len(word) > 12) + 2 * (word[:1].isalpha() or word[:1] >= b"\x80") + 4 * any(48 <= c < 58 for c in word)
    return xxhash.xxh3_64_intdigest(word[-3:].strip(b".,;:!?") + bytes([kind])) % SPELLINGS


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word hashes end to end, the texts' numbers of words, and the words."""
    hashes, words, count, memo = [], [], [], shared.WordHash()
    for t in texts:
        w = (t or b"").lower().split()
        hashes.append(memo.of(w))
        count.append(len(w))
        words += w
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words
    return np.concatenate(hashes), np.array(count, np.int64), words


_ENTRY = np.dtype([("n", "<i8"), ("kind", "<u2")])


def _squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte of their places, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4")[:, 0]


def _vocabulary(n: int):
    """Per block a row for each bucket: the block's distinct words, how often training documents hold
    them, and their spelling; and a row with bucket -1: the documents as positions among these words,
    so that texts are shuffled and cut into words once."""

    def run(t: pa.Table) -> pa.Table:
        h, count, words = _tokens(shared.column_bytes(t["text"]))
        train = np.repeat(~np.array(t["held_out"].to_pylist(), bool), count)
        keys, first, where = np.unique(h, return_index=True, return_inverse=True)
        entry = np.empty(len(keys), _ENTRY)
        entry["n"] = np.bincount(where, weights=train, minlength=len(keys)) if len(keys) else 0
        entry["kind"] = [spelling(words[i]) for i in first.tolist()]
        bucket = (shared.mix64(keys, 5) % np.uint64(n)).astype(np.int64)
        out = shared.pack_by_bucket(t["block"][0].as_py(), bucket, keys, entry)
        held = [int(np.frombuffer(v, _ENTRY)["n"].sum()) for v in out["vals"].to_pylist()]
        out = out.set_column(4, "n", pa.array(held, pa.int64()))
        whole = lambda col: pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col)
        docs = {"bucket": pa.array([-1], pa.int32()), "block": t["block"][:1], "vals": pa.array([_squeezed(where)], pa.binary()), "n": pa.array([0], pa.int64())}
        docs |= {"ids": whole(t["id"].combine_chunks()), "held": whole(t["held_out"].combine_chunks()), "counts": whole(pa.array(count, pa.int64()))}
        return pa.concat_tables([out.cast(out.schema), pa.table(docs)], promote_options="permissive")

    return run


def _bucket(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their totals and spellings; for each entry its key's position, and its row."""
    keys, entry, row = shared.unpack_bucket(t, _ENTRY)
    names, first, where = np.unique(keys, return_index=True, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, where, entry["n"])
    return names, total, entry["kind"][first], where, row


def _statistics(frequent_from: int):
    """Rows (kind, a, b): frequent words (0, key, count); spellings (1, class, words, tokens)."""

    def run(t: pa.Table) -> pa.Table:
        names, total, kind, _, _ = _bucket(t)
        often = total >= frequent_from
        rare = ~often & (total > 0)
        words, tokens = np.bincount(kind[rare], minlength=SPELLINGS), np.bincount(kind[rare], weights=total[rare], minlength=SPELLINGS).astype(np.int64)
        used = np.flatnonzero(words)
        return pa.table({
            "frequent": pa.array(np.append(np.ones(often.sum(), bool), np.zeros(len(used), bool))),
            "key": pa.array(np.append(names[often].view(np.int64), used)),
            "words": pa.array(np.append(np.ones(often.sum(), np.int64), words[used])),
            "tokens": pa.array(np.append(total[often], tokens[used])),
        })

    return run


def _counts(t: pa.Table) -> pa.Table:
    names, total, kind, where, row = _bucket(t)
    entry = np.empty(len(where), _ENTRY)
    entry["n"], entry["kind"] = total[where], kind[where]
    return shared.answer_blocks(t, row, names[where], entry)


class Batch:
    """Class sequences in time order: position t of all sequences longer than t stands together."""

    def __init__(self, classes: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        self.order, n = order, length[order]
        start = np.concatenate(([0], np.cumsum(length)))[:-1][order]
        self.steps = int(n[0])
        self.active = np.searchsorted(-n, -np.arange(self.steps), side="left")
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        t = np.repeat(np.arange(self.steps), self.active)
        d = np.arange(len(t)) - self.at[t]
        self.classes = classes[start[d] + t]
        self.t, self.d = t, d

    def forward(self, model: Model, keep: bool) -> np.ndarray:
        """Natural log likelihood of each sequence, in the order given; alpha and scale are kept."""
        e = model.emit[self.classes]
        step, active, at = model.step, self.active, self.at
        scale = np.empty(len(e), e.dtype)
        alpha = e[: active[0]] * model.start
        for t in range(self.steps):
            a, b = at[t], at[t + 1]
            if t:
                alpha = alpha[: b - a] @ step
                alpha *= e[a:b]
            s = alpha.sum(axis=1)
            alpha /= s[:, None]
            scale[a:b] = s
            if keep:
                e[a:b] = alpha
        self.scale, self.alpha = scale, e if keep else None
        self.likelihood = float(np.log(scale.astype(np.float64)).sum())
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.d, weights=np.log(scale.astype(np.float64)), minlength=len(self.order))
        return out

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, steps and emissions (states x classes)."""
        self.forward(model, True)
        active, at, alpha = self.active, self.at, self.alpha
        back = model.emit[self.classes] / self.scale[:, None]  # becomes emission * beta / scale
        turned = np.ascontiguousarray(model.step.T)
        for t in range(self.steps - 1, -1, -1):
            a, b = at[t], at[t + 1]
            n = active[t + 1] if t + 1 < self.steps else 0
            if n:
                beta = back[b : b + n] @ turned
                alpha_t = alpha[a : a + n]
                back[a : a + n] *= beta
                # gamma takes alpha's place only after the steps below are summed
        later = np.flatnonzero(self.t > 0)
        before = at[self.t[later] - 1] + self.d[later]
        steps = model.step * (alpha[before].T.astype(np.float64) @ back[later].astype(np.float64))
        # alpha * beta: back holds emission * beta / scale, so beta is it times scale over emission
        beta = back * self.scale[:, None] / model.emit[self.classes]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        emissions = np.stack([np.bincount(self.classes, weights=gamma[:, s], minlength=len(model.emit)) for s in range(gamma.shape[1])])
        return gamma[: active[0]].sum(axis=0, dtype=np.float64), steps, emissions


class Model:
    """start (S), step (S x S), emit (classes x S); training uses single precision."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = (np.ascontiguousarray(x) for x in (start, step, emit))

    def single(self) -> Model:
        return Model(*(x.astype(np.float32) for x in (self.start, self.step, self.emit)))

    @classmethod
    def of_counts(cls, start: np.ndarray, step: np.ndarray, emissions: np.ndarray, prior: np.ndarray) -> Model:
        """Maximisation; a little of the classes' own frequencies (``prior``) is in every state."""
        start, step = start + _SMOOTH_STEP, step + _SMOOTH_STEP
        mass = emissions.sum(axis=1, keepdims=True)
        weight = 50.0 + _SMOOTH_CLASS * mass
        emit = (emissions + weight * prior) / (mass + weight)
        return cls(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit.T)

    @classmethod
    def random(cls, prior: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = prior * rng.gamma(2.0, 0.5, (STATES, len(prior)))
        step = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), step / step.sum(axis=1, keepdims=True), (emit / emit.sum(axis=1, keepdims=True)).T)


def _batches(rows, most: int = _BATCH):
    """Group encoded rows until they hold ``most`` tokens."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[-1]) // 2
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _batch_of(blobs: list[bytes]) -> Batch:
    return Batch(np.frombuffer(b"".join(blobs), "<u2"), np.array([len(b) // 2 for b in blobs], np.int64))


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Documents with exact counts and class sequences, and the classes' training tokens.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, inner (log10 probability of
    the words within their classes), classes (16-bit numbers, the end included).
    """
    n = shared.block_count(docs, text)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), (fold(id_col) == 1).alias("held_out"))
    rows = rows.select(shared.block_of(n, "id", "text").alias("block"), "id", "text", "held_out")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{shared.PACKED}, ids array<{kind}>, held array<boolean>, counts array<long>"
    stored = shared.materialise(rows.groupBy("block").applyInArrow(_vocabulary(n), schema), "vocabulary")
    vocabulary = stored.filter("bucket >= 0").drop("ids", "held", "counts")
    ends = rows.filter(~F.col("held_out")).count()
    tokens = (vocabulary.agg(F.sum("n")).first()[0] or 0) + ends
    frequent_from = max(1, -(-tokens // FREQUENT))
    found = vocabulary.groupBy("bucket").applyInArrow(_statistics(frequent_from), "frequent boolean, key long, words long, tokens long")
    found = found.groupBy("frequent", "key").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
    found = found.orderBy("frequent", "key").collect()  # at most FREQUENT + SPELLINGS rows
    of_class = np.zeros(1 + SPELLINGS + sum(r.frequent for r in found), np.int64)
    words_of = np.zeros(SPELLINGS, np.int64)
    frequent = np.array([r.key for r in found if r.frequent], np.int64).view(np.uint64)
    of_class[0] = ends
    for r in found:
        if not r.frequent:
            of_class[1 + r.key], words_of[r.key] = r.tokens, r.words
    of_class[1 + SPELLINGS :] = [r.tokens for r in found if r.frequent]
    sort = np.argsort(frequent)
    frequent, number = frequent[sort], (1 + SPELLINGS + sort).astype(np.uint16)
    # the end counts as a token of the vocabulary too, if any text has been learnt from
    distinct = int(words_of.sum()) + len(frequent) + (ends > 0)
    below = tokens + 0.5 * (distinct + 1)
    inside = of_class[1 : 1 + SPELLINGS] + 0.5 * (words_of + 1)
    end_log = np.log10((ends + 0.5) / below)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "inner", "classes"]

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        # a block is one row; its words and their answers are both in ascending order of hashes
        ids, held = (t[c].combine_chunks().flatten() for c in ("ids", "held"))
        count = t["counts"].combine_chunks().flatten().to_numpy()
        at = _unsqueezed(t["vals"][0].as_py(), int(count.sum()))
        # all that a word needs is worked out once per distinct word of the block
        keys, entry = shared.joined_answers(answers, _ENTRY)
        c, spell = entry["n"], entry["kind"].astype(np.int64)
        place = shared.look_up(frequent, keys)
        rare = place < 0
        class_of = np.where(rare, 1 + spell, number[place] if len(number) else 0).astype("<u2")
        inner_of = np.where(rare, np.log10((c + 0.5) / inside[spell]), 0.0)
        base_of = np.log10((c + 0.5) / below)
        classes, inner, base, c = class_of[at], inner_of[at], base_of[at], c[at]
        doc = np.repeat(np.arange(len(count)), count)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(count)).astype(float)
        cut = np.cumsum(count)[:-1]
        blobs = [np.append(x, np.uint16(0)).astype("<u2").tobytes() for x in np.split(classes, cut)] if len(count) else []
        cols = [ids, held, pa.array(count + 1), pa.array(total(c > 0).astype(np.int64) + (ends > 0)), pa.array(np.full(len(count), tokens)), pa.array(total(base) + end_log), pa.array(total(inner)), pa.array(blobs, pa.binary())]
        return pa.table(dict(zip(names, cols)))

    answers = vocabulary.groupBy("bucket").applyInArrow(_counts, shared.ANSWER)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, inner double, classes binary"
    encoded = stored.filter("bucket < 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
    encoded = shared.materialise(encoded, "encoded")
    shared.drop_table(stored)
    return encoded, of_class


def train(encoded: DataFrame, of_class: np.ndarray, rounds: int | None = None) -> Model:
    """Baum-Welch over all training documents to convergence, or for ``rounds`` rounds if given.

    ``trace`` of the result has the log likelihood a token before each round, in nats.  The start values
    come from a share of the documents by hash, about ``START_DOCS``; a document longer than ``START_WORDS`` gives it a stretch
    from a place that depends on its hash.  Without any the rounds start from random states.
    """
    prior = (of_class + 0.5) / (of_class + 0.5).sum()
    learn = encoded.filter(~F.col("held_out"))
    mark = F.xxhash64("id", "classes")
    since = F.pmod(mark, F.greatest(F.col("n_tokens") - START_WORDS, F.lit(0)) + 1).cast("int")
    some = shared.share(F.struct("id", "classes"), START_DOCS / max(1, int(of_class[0])))
    start = learn.filter(some).withColumn("since", since)
    start = start.select(F.expr(f"substring(classes, 2 * since + 1, {2 * START_WORDS})").alias("classes"))
    model = Model.random(prior)
    model.trace = []
    if not of_class[0]:
        return model  # no training document at all
    blobs = [bytes(r.classes) for r in start.collect()]  # about START_DOCS times START_WORDS
    if blobs:
        sample = _batch_of(blobs)
        for _ in range(START_ROUNDS):
            model = Model.of_counts(*sample.expected(model.single()), prior)
    trace = []
    tokens, before = max(1, int(of_class.sum())), -np.inf
    for done in count():
        if done == rounds:
            break
        now = encoded.sparkSession.sparkContext.broadcast(model.single())

        def run(batches, now=now):
            m = now.value
            total = None
            for held in _batches(((x,) for b in batches for x in b.column(0).to_pylist())):
                batch = _batch_of([x for (x,) in held])
                got = (*batch.expected(m), batch.likelihood)
                total = got if total is None else tuple(a + b for a, b in zip(total, got))
            if total is None:
                return
            begin, step, emissions, likelihood = total
            used = np.flatnonzero(emissions.sum(axis=0))
            rows = np.concatenate((np.full((1, STATES), likelihood), begin[None], step, emissions.T[used]))
            slot = np.concatenate((np.arange(-2 - STATES, 0), used))
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64())] + [pa.array(rows[:, s]) for s in range(STATES)], names=["slot", *(f"s{s}" for s in range(STATES))])

        sums = learn.select("classes").mapInArrow(run, "slot long, " + ", ".join(f"s{s} double" for s in range(STATES)))
        sums = sums.groupBy("slot").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)]).collect()
        begin, step, emissions = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, len(of_class)))
        for r in sums:
            v = np.array(r[1:])
            if r.slot >= 0:
                emissions[:, r.slot] = v
            elif r.slot == -2 - STATES:
                now_at = v[0] / tokens
            elif r.slot == -1 - STATES:
                begin = v
            else:
                step[r.slot + STATES] = v
        model = Model.of_counts(begin, step, emissions, prior)
        trace.append(now_at)
        if rounds is None and now_at - before < GAIN:
            break
        before = now_at
    model.trace = trace
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null, empty and blank texts are the end token alone.  A null id counts as the empty string where
    folds are told apart.  Repeated rows count as often as they occur.  Other columns are not read.
    An empty table gives an empty one; if no row is learnt from, N and V are 0.
    """
    encoded, of_class = encode(docs, id_col, text)
    now = docs.sparkSession.sparkContext.broadcast(train(encoded, of_class, rounds))
    rest = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]

    def run(batches):
        model = now.value
        for b in batches:
            blobs = b.column("classes").to_pylist()
            score = np.empty(len(blobs))
            for held in _batches((i, x) for i, x in enumerate(blobs)):
                score[[i for i, _ in held]] = _batch_of([x for _, x in held]).forward(model, False) / np.log(10)
            total = pa.array(score + b.column("inner").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [total], names=[*rest, "score"])

    schema = encoded.select(*rest).schema.add("score", "double")
    return encoded.select(*rest, "inner", "classes").mapInArrow(run, schema).withColumnRenamed("id", id_col)
