"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at every ``capacity``; full pieces are sequences by themselves.  Rests are
dealt into bins of about ``BIN_TOKENS`` by a hash, and within a bin differencing spreads them over
as few windows as could hold them.  Whenever the fullest window exceeds the capacity the window
count rises and the bin is spread anew, so no window overflows and none of its pieces is cut again.
Bins are independent tasks; their number grows with the input.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .differencing import spread_numbers

CAPACITY = 4096
END = 2
BIN_TOKENS = 1 << 19
END_BYTE = b"\xff"
#: Latin letters without ones that lower-case to two characters, then marks.
_COMMON = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,;:!?]*)")


def _rank_encoder(path: str):
    """A rank-based encoder of single words for a vocabulary that allows one, or None.

    It does if ids follow the merges and words end in a suffix: the suffix becomes a byte that UTF-8
    never uses, the last character's union with it comes before any merge, and the order of ids is
    the order of merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not suffix or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 512 + len(merges):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {}
    for token, i in vocab.items():
        body = token.removesuffix(suffix)
        ranks[bytes(byte_of[c] for c in body) + END_BYTE * (body != token)] = i
    if len(ranks) != len(vocab):
        return None
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class Encoder:
    """Ids of a text as little-endian 32-bit words, remembered by white-space-free chunk.

    The tokenizer must drop white space and treat what stands between as if it stood alone, as word
    BPE with pre-splitting at white space does; ``exact`` encodes whole texts for any other one.
    Chunks of common letters with marks after them are encoded word by word by ranks, which is
    several times faster and gives the tokenizer's ids; all else goes to the tokenizer itself.
    ``memo`` is begun anew for each task.
    """

    def __init__(self, path: str, exact: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.exact = exact
        self.ranked = None if exact else _rank_encoder(path)
        self.forget()

    def forget(self) -> None:
        self.memo = shared.Memo(self.chunk, 2 * shared.MEMO)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, chunk: str) -> bytes:
        parts = _COMMON.fullmatch(chunk) if self.ranked else None
        if parts is None:
            ids = self.whole(chunk)
        else:
            word, marks = parts.groups()
            ids = array("I", self.ranked(word.lower().encode() + END_BYTE)).tobytes()
            if marks:
                ids += self.memo[marks]
        return ids

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        # split() also parts at the separators 1C to 1F, which are not white space to a tokenizer
        if self.exact or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, text.split()))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, exact: bool = False) -> Encoder:
    if (path, exact) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, exact] = Encoder(path, exact)
    return _encoders[path, exact]


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, tail boolean"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False, exact: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, tail (shorter than capacity), ids.

    Each document ends in ``end``; a null or empty text is that id alone.  ``ids`` (binary, 32-bit
    little-endian) are there only if asked for.  Repeated rows are cut as often as they occur.
    """
    docs = docs.select(F.col(id_col), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer, exact)
        enc.forget()
        for b in batches:
            out = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "tail", "ids")}
            for row, ids in enumerate(map(enc.ids, b.column("text").to_pylist())):
                ids += last
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    piece = ids[4 * a : 4 * (a + capacity)]
                    for k, v in (("row", row), ("start", a), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", n), ("tail", len(piece) < 4 * capacity), ("ids", piece if with_ids else None)):
                        out[k].append(v)
            cols = [b.column(id_col).take(pa.array(out["row"], pa.int32()))]
            cols += [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens")] + [pa.array(out["tail"], pa.bool_())]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "tail"]
            if with_ids:
                cols.append(pa.array(out["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        enc.forget()

    return docs.mapInArrow(run, f"`{id_col}` {kind}, {PIECES}" + ", ids binary" * with_ids)


def spread_over_windows(length: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Window of each piece and the number of windows, none above ``capacity``."""
    total = int(length.sum())
    k = max(1, -(-total // capacity))
    while True:
        part, sums = spread_numbers(length, k)
        if sums.max() <= capacity:
            return part, k
        k += max(1, int(((sums - capacity).clip(0)).sum() // (4 * capacity)))


def assign(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; both gapless from 0 within what they number.

    ``sequence_id`` is unique, though not gapless over all bins: bin number times 2^32 plus window.
    """
    total = cut.agg(F.sum("length").alias("n")).first()["n"] or 0
    bins = max(1, -(-total // bin_tokens))
    order = [c for c in (id_col, "start", "length", "ids_crc32", "doc_tokens")]
    dealt = cut.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int"))
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")

    def run(t: pa.Table) -> pa.Table:
        number = t["_bin"][0].as_py()
        t = t.drop_columns(["_bin"]).sort_by([(c, "ascending") for c in order])
        length = t["length"].to_numpy()
        tail = length < capacity
        window = np.empty(len(length), np.int64)
        n = 0
        if tail.any():
            window[tail], n = spread_over_windows(length[tail], capacity)
        window[~tail] = n + np.arange(int((~tail).sum()))
        by = np.argsort(window, kind="stable")
        run_sum = np.cumsum(length[by]) - length[by]
        first = np.append(True, np.diff(window[by]) > 0)
        offset = np.empty(len(length), np.int64)
        offset[by] = run_sum - np.repeat(run_sum[first], np.diff(np.append(np.flatnonzero(first), len(by))))
        # empty windows take no number
        _, window = np.unique(window, return_inverse=True)
        return t.append_column("sequence_id", pa.array((number << 32) + window, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("_bin").applyInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False, exact: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset that each has been given.

    Ties and repeated rows are ordered by all their digests; equal pieces are interchangeable.  An
    empty table packs into nothing.  Columns besides id and text are not read.  The pieces' digests
    are stored once in the shared folder, since bins need their total first.
    """
    cut = shared.materialise(pieces(docs, tokenizer, id_col, text, capacity, end, with_ids, exact), "pieces")
    return assign(cut, id_col, capacity).drop("tail")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """Token arrays of a pack made ``with_ids``: sequence_id, ids array<int>, padded to capacity.

    A sequence whose length is a power of two stays as long as it is.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        ids = np.frombuffer(b"".join(t["ids"].to_pylist()), "<u4").astype(np.int64)
        if len(ids) & (len(ids) - 1):
            ids = np.concatenate((ids, np.full(capacity - len(ids), pad)))
        return pa.table({"sequence_id": t["sequence_id"][:1], "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>")
