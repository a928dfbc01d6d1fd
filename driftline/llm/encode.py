"""Encoding of texts with a byte-level BPE vocabulary, in numpy.

Texts are split by the vocabulary's pattern. The distinct pieces of a batch become rows of padded matrices, one for each
class of lengths. In every round each row merges its leftmost pair of minimum rank: ranks come from a hash table
over pairs, merged rows are compacted by one place, finished rows leave the matrix. Pieces of more than ``LONG`` bytes
(scripts without spaces, rules) are handled one by one and merge in one round all places of their minimum pair from
left to right. That gives the same ids as long as no merge makes a pair of lower rank, which is checked when the vocabulary is
loaded; with a vocabulary that breaks this, long pieces are rows like all others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import shipped

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# fixed value: the split pattern of the public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
LONG = 256
CACHE, CACHE_LETTERS = 200_000, 8_000_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def load_table(path: str = VOCABULARY) -> dict[str, np.ndarray]:
    """Arrays of a vocabulary file: ids of the bytes and an open-addressing hash table from pairs to rank and merged id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    key, merged = left << 32 | right, np.array([vocab[a + b] for a, b in pairs], np.int32)
    size = 1 << int(np.ceil(np.log2(4 * len(key) + 4)))
    keys, rank, out = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
    todo, at = np.arange(len(key)), _slot(key, size)
    probes = 0
    while len(todo):
        free = keys[at] < 0
        _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
        win = np.zeros(len(at), bool)
        win[first] = True
        win &= free
        keys[at[win]], rank[at[win]], out[at[win]] = key[todo[win]], todo[win], merged[todo[win]]
        todo, at = todo[~win], (at[~win] + 1) & (size - 1)
        probes += 1
    made = np.full(int(max(vocab.values())) + 1, -1, np.int64)
    np.maximum.at(made, merged, np.arange(len(key)))  # the last merge that makes each token
    ordered = bool((made[left] < np.arange(len(key))).all() and (made[right] < np.arange(len(key))).all())
    return {"ordered": np.array(ordered), "bytes": np.array([vocab[c] for c in _byte_letters()], np.int32), "keys": keys, "rank": rank, "out": out, "probes": np.array(probes)}


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(size).bit_length() + 1)).astype(np.int64)


def _look(t: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged id of the pairs (a, b); rank NONE where there is no merge. Negative ids are padding."""
    key = a.astype(np.int64) << 32 | b.astype(np.int64)
    key[(a < 0) | (b < 0)] = -2
    keys, size = t["keys"], len(t["keys"])
    at = _slot(key, size)
    rank, out = np.full(key.shape, NONE, np.int32), np.zeros(key.shape, np.int32)
    flat, r, o = key.ravel(), rank.ravel(), out.ravel()
    todo, at = np.flatnonzero(flat >= 0), at.ravel()[flat >= 0]
    for _ in range(int(t["probes"])):
        if not len(todo):
            break
        k = keys[at]
        hit = k == flat[todo]
        r[todo[hit]], o[todo[hit]] = t["rank"][at[hit]], t["out"][at[hit]]
        on = ~hit & (k >= 0)
        todo, at = todo[on], (at[on] + 1) & (size - 1)
    return r.reshape(key.shape), o.reshape(key.shape)


def _merge_rows(t: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids padded with -1, merged as far as it goes; and their lengths."""
    n, wide = ids.shape
    result, length = np.full((n, wide), -1, np.int32), np.zeros(n, np.int64)
    row = np.arange(n)
    rank, out = _look(t, ids[:, :-1], ids[:, 1:])
    while len(row):
        j = rank.argmin(1)
        i = np.arange(len(row))
        over = rank[i, j] == NONE
        if over.any():
            done = ids[over]
            result[row[over], : done.shape[1]] = done
            length[row[over]] = (done >= 0).sum(1)
            ids, rank, out, row, j = ids[~over], rank[~over], out[~over], row[~over], j[~over]
            if not len(row):
                break
            i = np.arange(len(row))
        ids[i, j] = out[i, j]
        cols = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, cols[None, :] + (cols[None, :] > j[:, None]), 1)
        if ids.shape[1] == 1:
            result[row, :1] = ids
            length[row] = 1
            break
        cols = np.arange(rank.shape[1] - 1)
        shift = cols[None, :] + (cols[None, :] > j[:, None])  # the pair at j is replaced below, the one at j + 1 goes
        rank, out = np.take_along_axis(rank, shift, 1), np.take_along_axis(out, shift, 1)
        for at in (j - 1, j):
            ok = (at >= 0) & (at < rank.shape[1])
            k, c = i[ok], at[ok]
            rank[k, c], out[k, c] = _look(t, ids[k, c], ids[k, c + 1])
    return result, length


def _merge_long(t: dict, ids: np.ndarray) -> np.ndarray:
    """One long piece: every round merges all places of the minimum pair."""
    while len(ids) > 1:
        rank, out = _look(t, ids[:-1], ids[1:])
        best = rank.min()
        if best == NONE:
            break
        at = np.flatnonzero(rank == best)
        run = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # in a run of overlapping places every second one merges
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        ids = ids.copy()
        ids[at] = out[at]
        ids = np.delete(ids, at + 1)
    return ids


def encode_pieces(t: dict, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and the offsets of each."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    parts: list = [None] * len(pieces)
    most = LONG if t["ordered"] else max(int(length.max(initial=0)), LONG)
    for i in np.flatnonzero(length > most):
        parts[i] = _merge_long(t, t["bytes"][np.frombuffer(pieces[i], np.uint8)])
    short = np.flatnonzero(length <= most)
    bucket = np.ceil(np.log2(np.maximum(length[short], 1)) * 2).astype(int)
    for b in np.unique(bucket):
        own = short[bucket == b]
        wide = int(length[own].max())
        step = max(1, 2_000_000 // max(wide, 1))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            inside = np.arange(wide)[None, :] < length[some][:, None]
            m = np.full(inside.shape, -1, np.int32)
            m[inside] = t["bytes"][np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
            got, n = _merge_rows(t, m) if wide > 1 else (m, length[some])
            for i, r, c in zip(some, got, n):
                parts[i] = r[:c]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.r_[0, np.cumsum(sizes)]


@lru_cache(1)
def _splitter():
    import regex

    return regex.compile(PATTERN).findall


class Encoder:
    """Encodes lists of texts; keeps the ids of up to ``CACHE`` short pieces between batches."""

    def __init__(self, table: dict[str, np.ndarray]):
        self.t, self.known, self.ids, self.off, self.letters = table, {}, np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each; none for a null or empty text."""
        split = _splitter()
        if len(self.known) > CACHE or self.letters > CACHE_LETTERS:
            self.__init__(self.t)
        known, new, index, count = self.known, [], [], []
        for text in texts:
            words = split(text) if text else ()
            count.append(len(words))
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(known)
                    new.append(w)
                index.append(i)
        if new:
            self.letters += sum(map(len, new))
            ids, off = encode_pieces(self.t, [w.encode() for w in new])
            self.ids, self.off = np.concatenate([self.ids, ids]), np.concatenate([self.off, off[1:] + self.off[-1]])
        at = np.array(index, np.int64)
        size = self.off[at + 1] - self.off[at]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.off[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.r_[0, ends][np.r_[0, np.cumsum(count)].astype(np.int64)]
        return flat, upto


def _slices(texts: list, most: int) -> Iterator[list]:
    part, chars = [], 0
    for x in texts:
        part.append(x)
        chars += len(x or "")
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _run(batches: Iterator[pa.RecordBatch], table, names: list[str], counts: bool, most: int) -> Iterator[pa.RecordBatch]:
    encode = Encoder(table.value)
    for b in batches:
        text = b.column(b.num_columns - 1)
        at = 0
        for part in _slices(text.to_pylist(), most):
            ids, off = encode(part)
            values = pa.array(np.diff(off)) if counts else pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[c.slice(at, len(part)) for c in b.columns[:-1]], values], names=names)
            at += len(part)


def _encoded(df: DataFrame, text: str, result: str, path: str, counts: bool, most: int = 4_000_000) -> DataFrame:
    shipped(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(load_table(path))  # of the vocabulary's size, whatever the data
    keep = [c for c in df.columns if c not in (text, result)]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{result}` {'bigint' if counts else 'array<int>'}"])
    names = [*keep, result]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string")).mapInArrow(lambda it: _run(it, table, names, counts, most), schema)


def encode_corpus(df: DataFrame, text: str = "text", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """The other columns of ``df`` and the token ids of ``text``, without special tokens, in place of the text.

    A null or empty text gets an empty list. Strings that spell special tokens are ordinary text. Texts may have any length;
    a column that already has the name of ``ids`` is replaced. Rows aren't moved and repeated rows stay; empty gives empty.
    """
    return _encoded(df, text, ids, path, False)


def count_tokens(df: DataFrame, text: str = "text", n: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """As ``encode_corpus`` with the number of ids (0 for a null or empty text)."""
    return _encoded(df, text, n, path, True)
