"""Toxicity with a noisy channel: obfuscated words are decoded before they are scored.

Channel: a writer may replace letters by look-alikes (``LOOKS_LIKE``), part them by white space or
marks, and repeat them.  The decoder builds a lattice of the readings of each suspicious token (a
character may be a letter it stands for, a separator to be dropped, or a repetition of the letter
before) and takes the Viterbi path under a character trigram model.  The trigrams are counted over
all documents; words, their prefixes and the decoded words are then looked up in one table.

The classifier is fitted on at most ``SAMPLE`` labelled documents or so (a share of them by a hash of
the id).  They give each word and prefix its smoothed log odds, and a logistic curve over the strongest
odds of a document; for the curve each of three parts is judged by the odds of the other two.  No label, language, source or id is an input of a score.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SAMPLE = 20_000
#: Evidence: toxic documents that hold a feature, and its log odds, at least.
LEAST_DOCS, LEAST_ODDS = 2, 0.5
PARTS = 3
PREFIXES = (3, 4, 5, 6)
#: Characters and the letters that they are written for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = ".-_*~'`,:;/\\#^"
_EDGES = (SEPARATORS + "\"?)[]{}<>").encode()

_A = 29  # boundary, a to z, any other letter, anything else
_CODE = np.full(256, 28, np.uint8)
_CODE[list(b" \t\n\r\x0b\x0c")] = 0
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"((.)\2*)", re.S)
_CHOICE = re.compile("[ " + re.escape("".join(LOOKS_LIKE)) + "]")
_TWICE = re.compile(r"([^\W\d_])\1")
#: Three or more groups of one or two characters, with marks or without, over gaps of any length.
_MARK = rb"[^\s0-9A-Za-z@$!|+(\x80-\xff]*"
_GROUP = _MARK + rb"(?:(?:[0-9A-Za-z@$!|+(]|[\xc2-\xf4][\x80-\xbf]+)" + _MARK + rb"){1,2}"
_SPACED = re.compile(rb"(?<!\S)(?:" + _GROUP + rb"\s+){2,}" + _GROUP + rb"(?!\S)")


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Character trigrams of all texts: (29, 29, 29) counts."""

    def run(batches):
        total = np.zeros(_A**3, np.int64)
        for b in batches:
            raw = b" ".join(t or b"" for t in b.column(0).to_pylist())
            for i in range(0, len(raw), 1 << 22):
                c = _CODE[np.frombuffer(raw[max(0, i - 2) : i + (1 << 22)], np.uint8)].astype(np.int32)
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _A + c[1:-1]) * _A + c[2:], minlength=_A**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    grams = docs.select(F.col(text).cast("string").cast("binary")).mapInArrow(run, "gram long, n long")
    out = np.zeros(_A**3)
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    return out.reshape(_A, _A, _A)


class Decoder:
    """Viterbi decoding of character lattices under trigrams."""

    KEEP, SWAP, DROP, REPEAT, LOSE = -0.1, -1.0, -1.5, -1.2, -7.0

    def __init__(self, counts: np.ndarray):
        two = counts.sum(axis=2, keepdims=True)
        back = counts.sum(axis=0, keepdims=True) + 1.0
        back = back / back.sum(axis=2, keepdims=True)
        self.log = np.log((counts + 5.0 * back) / (two + 5.0)).tolist()

    def readings(self, token: str) -> list[list[tuple[str, float]]]:
        """For each character its letters with their costs; an empty string drops it."""
        out = []
        for run, ch in _RUN.findall(token):
            for i in range(len(run)):
                if ch == " ":
                    options, drop = [(ch, self.KEEP)], self.KEEP  # a boundary or none, as the trigrams say
                elif ch.isalpha():
                    options = [(ch, self.KEEP)]
                    drop = self.REPEAT if i else None
                elif ch in LOOKS_LIKE:
                    options = [(c, self.SWAP) for c in LOOKS_LIKE[ch]]
                    drop = self.REPEAT if i else self.DROP if ch in "!|" else self.LOSE
                else:
                    options, drop = [], self.DROP
                if drop is not None:
                    options.append(("", drop))
                out.append(options)
        return out

    def decode(self, token: str) -> str:
        """The best path's letters; spaces in it part words."""
        if _CHOICE.search(token):
            return self.viterbi(token)
        return self.collapsed([(ch, len(run)) for run, ch in _RUN.findall(token) if ch.isalpha()])

    def collapsed(self, runs: list[tuple[str, int]]) -> str:
        """The best path where only repetitions leave a choice.

        Trigrams reach two letters back, and a run always keeps its first letter, so the choice of one
        run never touches that of another: each is settled by its neighbours alone.
        """
        log = self.log
        code = [ord(ch) - 96 if "a" <= ch <= "z" else 27 for ch, _ in runs] + [0, 0]
        out = []
        for i, (ch, n) in enumerate(runs):
            if n > 1:
                b, c, d = code[i - 1], code[i], code[i + 1]
                more = log[c][c][c] + self.KEEP - self.REPEAT  # for each letter kept beyond two
                two = self.KEEP + log[b][c][c] + log[c][c][d] + max(0.0, (n - 2) * more)
                n = 1 if self.REPEAT + log[b][c][d] >= two else n if more > 0 else 2
            out.append(ch * n)
        return "".join(out)

    def viterbi(self, token: str) -> str:
        """The best path through the lattice of ``readings``."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.readings(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, path) in states.items():
                for c, q in options:
                    if c:
                        code = ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
                        s, v, way = (b, code), p + q + log[a][b][code], (path, c)
                    else:
                        s, v, way = (a, b), p + q, path
                    if s not in new or v > new[s][0]:
                        new[s] = (v, way)
            states = new
        _, path = max(((p + log[a][b][0], way) for (a, b), (p, way) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, c = path
            out.append(c)
        return "".join(reversed(out))


def restored(token: str, decoder: Decoder) -> list[str]:
    """The letter runs of a lower-case token, and its decoded form unless it can only be read as it is.

    Any character other than a letter and any repeated letter makes for other readings.
    """
    if token.isalpha() and not _TWICE.search(token):
        return [token]
    words = _LETTERS.findall(token)
    core = token.strip(SEPARATORS + "\"?)[]{}<>«»“”")
    for form in {core, core.rstrip("!|")}:
        if form and not (form.isalpha() and not _TWICE.search(form)):
            words.append(decoder.decode(form))
    return words


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def spaced(raw: bytes, decode: Callable[[str], str]) -> set[str]:
    """The decoded words of runs of three or more short groups of characters."""
    runs = {b" ".join(m.split()).decode("utf-8", "replace").lower() for m in _SPACED.findall(raw)}
    return {w for r in runs for w in decode(r).split()}


class Scorer:
    """Strongest log odds of a text's words.  Words are scored once and remembered."""

    def __init__(self, odds: dict[str, float], decoder: Decoder):
        self.odds, self.decoder = odds, decoder
        self.begins = {f[:3] for f in odds}  # no other word has a feature among them
        self.memo = shared.Memo(lambda token: self.of_token(token.decode("utf-8", "replace").lower()), 2 * shared.MEMO)
        self.runs = shared.Memo(decoder.decode, shared.MEMO // 4)

    def of_word(self, word: str) -> float:
        if word[:3] not in self.begins:
            return 0.0
        get = self.odds.get
        return max(get(f, 0.0) for f in features(word))

    def of_token(self, token: str) -> float:
        return max(map(self.of_word, restored(token, self.decoder)), default=0.0)

    def of_text(self, raw: bytes | None) -> tuple[float, float, float]:
        """The largest and third largest log odds among distinct tokens, and the share of strong ones."""
        raw = raw or b""
        tokens = {t.strip(_EDGES) for t in raw.split()}
        found = np.fromiter(map(self.memo.__getitem__, tokens), np.float64, len(tokens))
        more = [self.of_word(w) for w in spaced(raw, self.runs.__getitem__)]
        if more:
            found = np.concatenate((found, more))
        if not len(found):
            return 0.0, 0.0, 0.0
        top = np.partition(found, -3)[-3:] if len(found) >= 3 else np.concatenate((np.zeros(3 - len(found)), found))
        return float(top.max()), float(np.sort(top)[0]), float(np.log1p(np.count_nonzero(found > 3.0)) - 0.25 * np.log1p(len(found)))


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def held_out(id_col: str) -> Column:
    return fold(id_col) == 0


class Model:
    """All that scoring needs; plain data, bounded by ``SAMPLE`` and the alphabet."""

    def __init__(self, counts: np.ndarray, odds: dict[str, float], curve: list[float]):
        self.counts, self.odds, self.curve = counts, odds, curve

    def scorer(self) -> Scorer:
        return Scorer(self.odds, Decoder(self.counts))

    def probability(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> list[float]:
    """Newton's method with a ridge on all but the constant; a step is halved until it is a gain."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        w, now = w + step, min(now, then)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows outside of fold 0.  Without labels every score is 0."""
    counts = trigram_counts(docs, text)
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    known = known.filter(shared.share(F.col(id_col), sample / max(1, known.count())))  # the documented bound
    rows = docs.join(F.broadcast(known), id_col).select(F.col(id_col).alias("id"), F.col(text).cast("string").cast("binary").alias("raw"), (F.col("y") > 0).cast("int").alias("y"))
    rows = shared.materialise(rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(PARTS)).cast("int")), "labelled")

    def words(batches):
        decoder = Decoder(counts)
        found: Counter = Counter()
        memo = shared.Memo(lambda t: [f for w in restored(t.decode("utf-8", "replace").lower(), decoder) for f in features(w)], shared.MEMO // 4)

        def emit():
            f, p, y = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(p, pa.int32()), pa.array(y, pa.int32()), pa.array(list(found.values()), pa.int64())], names=["f", "part", "y", "n"])
            found.clear()

        for b in batches:
            for raw, y, p in zip(b.column("raw").to_pylist(), b.column("y").to_pylist(), b.column("part").to_pylist()):
                raw = raw or b""
                seen: set[str] = set()
                for t in {t.strip(_EDGES) for t in raw.split()}:
                    seen.update(memo[t])
                for w in spaced(raw, decoder.decode):
                    seen.update(features(w))
                found.update((f, p, y) for f in seen)
            if len(found) > 500_000:
                yield from emit()
        yield from emit()

    size = np.zeros((PARTS, 2))
    for r in rows.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r.part, r.y] = r.n
    cells = [(p, y) for p in range(PARTS) for y in (0, 1)]
    of_cell = [F.sum(F.when((F.col("part") == p) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}") for p, y in cells]
    grams = rows.select("raw", "y", "part").mapInArrow(words, "f string, part int, y int, n long").groupBy("f").agg(*of_cell)
    toxic, clean = (sum((F.col(f"n{p}{y}") for p in range(1, PARTS)), F.col(f"n0{y}")) for y in (1, 0))
    grams = grams.withColumn("v", F.log((toxic + 0.5) / (size[:, 1].sum() + 1)) - F.log((clean + 0.5) / (size[:, 0].sum() + 1)))
    best = grams.filter((toxic >= LEAST_DOCS) & (F.col("v") > LEAST_ODDS)).orderBy("f").toArrow()  # bounded by the sample
    names = best["f"].to_pylist()
    n = np.array([best[f"n{p}{y}"].to_numpy() for p, y in cells], float).reshape(PARTS, 2, -1)

    def odds_without(part: int | None) -> dict[str, float]:
        use = [p for p in range(PARTS) if p != part]
        c, s = n[use].sum(axis=0), size[use].sum(axis=0)
        v = np.log((c[1] + 0.5) / (s[1] + 1)) - np.log((c[0] + 0.5) / (s[0] + 1))
        good = np.flatnonzero((v > LEAST_ODDS) & (c[1] >= LEAST_DOCS))
        return {names[i]: float(v[i]) for i in good}

    model = Model(counts, odds_without(None), [-30.0, 0.0, 0.0, 0.0])
    if not model.odds:
        return model
    others = [odds_without(p) for p in range(PARTS)]

    def strength(batches):
        decoder = Decoder(counts)
        scorers = [Scorer(o, decoder) for o in others]
        for b in batches:
            x = [scorers[p].of_text(t) for t, p in zip(b.column("raw").to_pylist(), b.column("part").to_pylist())]
            cols = list(zip(*x)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols] + [b.column("y")], names=["a", "b", "c", "y"])

    judged = rows.mapInArrow(strength, "a double, b double, c double, y int").toArrow()
    x, y = np.stack([judged[c].to_numpy() for c in "abc"], axis=1), judged["y"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        model.curve = logistic(x, y)
    else:
        model.curve = [-4.0, 1.0, 0.0, 0.0]
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """Id, held_out, score, predicted for each row; with ``keep`` all of its columns, and ``name``.

    Null, empty and wordless texts get the score of a text without evidence.  Repeated rows get the
    same score.  A null id counts as the empty string where folds are told apart.  Other columns are
    not read; with ``keep`` one that is called ``name`` is replaced.  An empty table gives an empty one.
    A text of any length is scored whole, by its distinct tokens.
    """
    plain = docs.drop(name) if keep else docs.select(id_col, F.col(text).cast("string").alias(text))
    shared_model = docs.sparkSession.sparkContext.broadcast(json.dumps([model.counts.ravel().tolist(), model.odds, model.curve]))
    out = [c for c in plain.columns if keep or c != text]

    def run(batches):
        counts, odds, curve = json.loads(shared_model.value)
        m = Model(np.array(counts).reshape(_A, _A, _A), odds, curve)
        scorer = m.scorer()
        for b in batches:
            x = np.array([scorer.of_text(t) for t in shared.column_bytes(b.column(text))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in out] + [pa.array(m.probability(x))], names=[*out, name])

    scored = plain.mapInArrow(run, plain.select(*out).schema.add(name, "double"))
    if keep:
        return scored
    return scored.select(id_col, held_out(id_col).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
