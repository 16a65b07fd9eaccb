"""Language identification by bit-sliced Bloom filters over character n-grams.

Every language is a Bloom filter of the n-grams that are at home in it; all filters share their hash
functions and are stored slot by slot, so that a slot is a bit mask of languages and the masks of an n-gram's
slots, and-ed, name every language that holds it.  A text's count for a language is the number of its n-grams
with that bit.  A filter of which a share f of the n-grams asked would pass by chance counts too many:
hits = true + f * (n - true) is solved for the true ones.  The language with the largest share of a text's n-grams wins.

An n-gram is at home in a language if it has at least ``RATE`` of the language's n-grams of its length
and at least ``HOME`` of the rate in the language where it is most frequent.  The first bound limits the filter's size
whatever the corpus (no more than 1 / RATE n-grams of a length and language), so that it may be
sent to every task; the second keeps what all languages share from counting for the best documented one.

Counts cover all learning documents.  N-grams lie within words (with a mark at both ends), and a task counts
each distinct word once with its number.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LENGTHS = (1, 2, 3, 4)
RATE = 2e-5
HOME = 0.2
HASHES = 3
SLOTS_PER_NGRAM = 16
#: With more languages than these fitting fails: filters and their totals are sent to every task.
MOST_LANGUAGES = 1 << 10
#: Texts that are looked up at once.
TEXTS = 256
#: Distinct words that a task holds before it hands on their n-grams' counts.
WORDS = 1 << 18
#: Texts are cut into pieces of about so many characters at word ends, so that no text needs more memory.
PIECE = 1 << 20

_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = 0x20


def words_of(text: str) -> Counter:
    """Runs of letters (other signs of number beside one stay in it), in lower case, with their numbers."""
    found = Counter(_LETTERS.findall(text.lower()))
    return Counter({w: n for w, n in found.items() if w.isalpha() or any(map(str.isalpha, w))})


def ngrams(words: list[str], lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all n-grams of the words with a mark before and after each, and the word of each.

    A key is a hash of the length and the characters; the mark alone is none.
    """
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mark = flat == _EDGE
    word = np.cumsum(mark) - 1
    keys, whose = [], []
    for n in lengths:
        size = max(0, len(flat) - n + 1)
        key, inner = np.full(size, n, np.uint64), np.zeros(size, bool)
        for i in range(n):
            key = shared.mix64(key ^ flat[i : i + size], 0x9E3779B97F4A7C15 + i)
            if 0 < i < n - 1:
                inner |= mark[i : i + size]
        # a mark may stand first or last, not between; it counts as the beginning of the word after it
        fit = ~inner if n > 1 else ~mark
        keys.append(key[fit])
        whose.append(word[:size][fit])
    return np.concatenate(keys), np.concatenate(whose)


@dataclass
class Filter:
    """``masks``: languages by slot, 64 to a column; ``chance``: how often a strange n-gram passes, by language."""

    langs: list[str]
    masks: np.ndarray
    chance: np.ndarray
    common: str | None

    def holders(self, keys: np.ndarray) -> np.ndarray:
        """A row of masks for each key."""
        slots = np.uint64(len(self.masks) - 1)
        out = None
        for i in range(HASHES):
            got = self.masks[(shared.mix64(keys, 0xA5A5 + i) & slots).astype(np.int64)]
            out = got if out is None else out & got
        return out

    def counts(self, words: list[str], lengths: tuple[int, ...] = LENGTHS) -> np.ndarray:
        """For each word the number of its n-grams, then of those that each language holds."""
        keys, whose = ngrams(words, lengths)
        held = self.holders(keys)
        out = np.zeros((len(words), 1 + len(self.langs)), np.int64)
        out[:, 0] = np.bincount(whose, minlength=len(words))
        for i in range(len(self.langs)):
            bit = (held[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)
            out[:, 1 + i] = np.bincount(whose, weights=bit, minlength=len(words))
        return out

    def decide(self, counts: np.ndarray) -> tuple[str, float]:
        """The language of a text's counts and its share of all languages' corrected counts."""
        n, hits = counts[0], counts[1:]
        true = np.maximum(hits - self.chance * n, 0) / (1 - self.chance)
        total = true.sum()
        if not total:
            return self.common, 0.0
        at = int(np.argmax(true))  # ties: the first language by code point
        return self.langs[at], float(true[at] / total)


def _pieces(text: str):
    """Parts of a text that end between words."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, size, key, n`` of all n-grams of documents with a text and a language."""

    def run(batches):
        held: dict[str, Counter] = {}

        def counted():
            for name, words in held.items():
                names = list(words)
                times = np.fromiter(words.values(), np.int64, len(words))
                for size in LENGTHS:
                    keys, whose = ngrams(names, (size,))
                    if not len(keys):
                        continue
                    distinct, at = np.unique(keys, return_inverse=True)
                    n = np.bincount(at, weights=times[whose]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(np.full(len(n), size, np.int32)), pa.array(distinct.view(np.int64)), pa.array(n)], names=["lang", "size", "key", "n"])

        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                of = held.setdefault(name, Counter())
                for piece in _pieces(t):
                    of.update(words_of(piece))
            if sum(map(len, held.values())) > WORDS:
                yield from counted()
                held = {}
        yield from counted()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rate: float = RATE, home: float = HOME) -> Filter:
    """The filters of all languages of ``docs``; rows without a language or a text teach nothing."""
    spark = docs.sparkSession
    counts = shared.materialise(ngram_counts(docs, text, lang), "ngrams")
    names = shared.materialise(counts.groupBy("lang", "size").agg(F.sum("n").alias("all")), "languages")
    if names.count() > len(LENGTHS) * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = counts.join(F.broadcast(names), ["lang", "size"]).withColumn("rate", F.col("n") / F.col("all")).filter(F.col("rate") >= rate)
    share = share.withColumn("top", F.max("rate").over(Window.partitionBy("size", "key"))).filter(F.col("rate") >= home * F.col("top"))
    kept = shared.materialise(share.select("lang", "key"), "home")
    most = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    langs = sorted(r.lang for r in most)
    if not langs:
        return Filter([], np.zeros((1, 1), np.uint64), np.zeros(0), None)
    n_docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    common = max(((r.n, [-ord(c) for c in r.lang]), r.lang) for r in n_docs if r.lang in langs)[1]
    slots = 1 << (SLOTS_PER_NGRAM * max(r.n for r in most) - 1).bit_length()
    number = {name: i for i, name in enumerate(langs)}
    columns = (len(langs) + 63) // 64

    def run(batches):
        for b in batches:
            keys = b.column("key").to_numpy().view(np.uint64)
            at = np.fromiter((number[x] for x in b.column("lang").to_pylist()), np.int64, len(keys))
            for i in range(HASHES):
                slot = shared.mix64(keys, 0xA5A5 + i) & np.uint64(slots - 1)
                bit = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array((at >> 6).astype(np.int32)), pa.array(bit.view(np.int64))], names=["slot", "part", "bit"])

    bits = kept.mapInArrow(run, "slot long, part int, bit long").groupBy("slot", "part").agg(F.bit_or("bit").alias("mask"))
    masks = np.zeros((slots, columns), np.uint64)
    # at most HASHES / rate slots of a length and language, whatever the corpus
    got = bits.toArrow()
    masks[got["slot"].to_numpy(), got["part"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / slots for i in range(len(langs))])
    return Filter(langs, masks, fill**HASHES, common)


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """id, ``extra``, ``lang_pred``, ``score``: the language of every text.

    Null texts and texts without a letter are ``und`` with a score of 0, as is everything if nothing was learnt.  A text
    whose n-grams no language holds is of the language with the most documents, with a score of 0.  The score is the
    winner's share of all languages' counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), *(extra or []), F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        now = sent.value
        most, known = max(1, 8 * WORDS // (8 + len(now.langs))), {}
        for b in batches:
            out = []
            for first in range(0, b.num_rows, TEXTS):
                found = []
                for t in b.column("_text").slice(first, TEXTS).to_pylist():
                    words = Counter()
                    for piece in _pieces(t or ""):
                        words.update(words_of(piece))
                    found.append(words)
                if len(known) > most:
                    known = {}
                new = list({w for words in found for w in words if w not in known})
                if new:
                    known.update(zip(new, now.counts(new)))
                for words in found:
                    if not words or not now.langs:
                        out.append(("und", 0.0))
                        continue
                    times = np.fromiter(words.values(), np.int64, len(words))
                    out.append(now.decide(times @ np.stack([known[w] for w in words])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """id, held_out, lang_pred, score: learns from all rows but those whose crc32(id) mod ``folds`` is ``fold``.

    A null id counts as the empty string where folds are told apart.  Repeated rows teach as often as they occur and
    are each answered.  Other columns are not read.  An empty table gives an empty result.
    """
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    held = F.pmod(crc, F.lit(folds)) == fold
    model = fit(docs.filter(~held), text, lang)
    return identify(docs, model, id_col, text, [held.alias("held_out")])
