"""Texts that were decoded with the wrong character encoding.

A swap (read, written) is a substitution cipher: text written in one code page and decoded by another has each letter, or
each letter's bytes, replaced by fixed other characters. Which swaps a source suffers is unknown. They are learnt by
expectation-maximization against the bigrams of the corpus: given bigrams and the weights of the swaps per source,
every stretch of a document gets the swap that explains it best (E); given these, the weights are counted anew, the
bigrams are counted again with garbled stretches replaced by what they stand for, and so is the mapping of letters: how often
a letter (or the letters of a UTF-8 sequence) stood for another one, against how often it stood for itself (M). The rounds
end when the weights have settled. A token then is garbled if a swap explains its stretch, or if its odd letters
stand for others by the mapping learnt and it reads better with those.

The first bigrams leave out tokens that read as UTF-8 of more usual letters in some page, else common damage would pass for
usual text. Swaps of one-byte pages are applied with translate(), the others through their bytes; a page's undefined bytes stand
for themselves. Pages that aren't listed are learnt as a free table per source (``solve``): letters that one source has far more
often than the others are the cipher's, and EM over the matrix of their bigrams finds what each stands for. Letters that
decoding has lost (U+FFFD) take the letter that the bigrams on both sides make likeliest.

What a token may stand for is worked out once for the most frequent tokens of the corpus, which all tasks share, and
by the task for the others.
"""

from __future__ import annotations

import math
import pickle
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.joins import bounded
from driftline.session import checkpointed, shipped

# fixed values: names of public code pages
ONE_BYTE = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp1253", "iso8859-7", "cp1254", "iso8859-9", "cp1257", "cp437", "cp850", "cp852", "mac_roman", "iso8859-15"]
MANY_BYTES = ["utf-8", "cp932", "euc_jp", "gbk"]
MARK, LOST = "\ufeff", "�"
BUCKETS, LETTERS = 1 << 20, 1 << 16
NEITHER, KEPT = -1, 200  # no swap; tokens of up to so many letters are remembered
LEARNT = (len(ONE_BYTE) + len(MANY_BYTES) - 1) ** 2 + 1  # number of a source's own table, after the swaps and lost letters
SHARED, SHORT = 20_000, 200  # so many tokens, of up to so many letters, are worked out for all tasks
SOURCES = 10_000  # with more sources their weights and tables are joined to the documents instead of broadcast
SEEN = 5  # a letter stands for another by the mapping if it did so often and at least four times in five
LETTER, PAIRS = -1_000_000, -3_000_000  # places of letters and of the mapping among the counts
SINGLE = 6  # passes over a text that mend its best stretch alone
PAIR = re.compile("[^\x00-\x7f]{2}")
OTHER = re.compile("[^\x00-\x7f]")
UNSURE = re.compile("[\x80-\x9f\ue000-\uf8ff\ufffd]")  # what decoders of several bytes leave where bytes fit nowhere
MULTI = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


@lru_cache(1)
def _pages() -> dict[str, str]:
    """The 256 characters of each one-byte page; undefined bytes stand for themselves."""
    return {p: "".join(c if (c := bytes([b]).decode(p, "replace")) != LOST else chr(b) for b in range(256)) for p in ONE_BYTE}


@lru_cache(1)
def swaps() -> list[tuple[str, str]]:
    """(read, written) of every swap. Text that was read as UTF-8 shows as lost letters only."""
    every = ONE_BYTE + MANY_BYTES
    return [(r, w) for r in every for w in every if r != w and r != "utf-8"]


@lru_cache(1)
def _tables() -> tuple[dict, dict]:
    pages = _pages()
    to_byte = {p: {ord(c): b for b, c in reversed(list(enumerate(t)))} for p, t in pages.items()}
    to_letter = {(r, w): {c: pages[w][b] for c, b in to_byte[r].items()} for r in ONE_BYTE for w in ONE_BYTE if r != w}
    return to_byte, to_letter


@lru_cache(1)
def _one_byte_pairs() -> np.ndarray:
    """Numbers of the swaps between one-byte pages."""
    return np.array([i for i, (r, w) in enumerate(swaps()) if r in ONE_BYTE and w in ONE_BYTE])


@lru_cache(1)
def _other_swaps() -> list[tuple[int, str, str]]:
    """(number, read, written) of the swaps in which a page of several bytes has part."""
    return [(i, r, w) for i, (r, w) in enumerate(swaps()) if r not in ONE_BYTE or w not in ONE_BYTE]


@lru_cache(1 << 16)
def _letters_of(c: int) -> np.ndarray:
    """What character c stands for by each swap between one-byte pages; -1 where the page read doesn't have it."""
    to_byte, to_letter = _tables()
    return np.array([ord(to_letter[swaps()[i]].get(c, "\0")) if c in to_byte[swaps()[i][0]] else NEITHER for i in _one_byte_pairs()])


@lru_cache(1)
def _letters_by_byte() -> dict[str, dict[int, str]]:
    return {p: dict(enumerate(t)) for p, t in _pages().items()}


@lru_cache(1 << 14)
def _columns(own: tuple[int, ...]) -> list[tuple[dict[int, int], list[int]]]:
    """The different substitutions of a set of characters by swaps between one-byte pages, and the numbers of the swaps that make them."""
    table = np.stack([_letters_of(c) for c in own])
    fits = (table >= 0).all(0)
    out: dict[bytes, list[int]] = {}
    for i, col in zip(_one_byte_pairs()[fits], np.ascontiguousarray(table[:, fits].T)):
        out.setdefault(col.tobytes(), []).append(int(i))
    got = [(dict(zip(own, np.frombuffer(k, table.dtype).tolist())), n) for k, n in out.items()]
    return [(m, n) for m, n in got if any(a != b for a, b in m.items())]


def readings(token: str) -> dict[str, list[int]]:
    """What a token may stand for: text to the numbers of the swaps that give it, without the token itself."""
    to_byte, to_letter = _tables()
    out: dict[str, list[int]] = {}
    chars = {ord(c) for c in token if ord(c) > 127}
    raw: dict[str, bytes | None] = {}
    for p in ONE_BYTE:
        raw[p] = token.translate(to_byte[p]).encode("latin-1") if all(c in to_byte[p] for c in chars) else None
    sure = UNSURE.sub("", token)
    for p in MANY_BYTES[1:]:
        try:
            raw[p] = sure.encode(p) if OTHER.search(sure) else None
        except UnicodeEncodeError:
            raw[p] = None
    if chars:
        own = sorted(chars)
        for letters, numbers in _columns(tuple(own)):
            got = token.translate(letters)
            if got != token and ("\xa0" not in got or "\xa0" in token):  # letters that turn into blanks explain nothing
                out.setdefault(got, []).extend(numbers)
    pairs = PAIR.search(token) is not None
    done: dict[tuple, str | None] = {}  # many pages have the same bytes for a token
    for i, r, w in _other_swaps():
        b = raw[r]
        if w == "utf-8" and r in to_byte:
            if not pairs:
                continue
            bytes_ = token.translate(to_byte[r])
            if (bytes_, w) not in done:
                done[bytes_, w] = _sequences(token, to_byte[r])
            got = done[bytes_, w]
        elif b is None:
            continue
        else:
            if (b, w) not in done:
                if w in to_byte:
                    t = b.decode("latin-1").translate(_letters_by_byte()[w])
                else:
                    t = b.decode(w, "replace")
                    t = None if t.count(LOST) * 3 > len(t) else t
                done[b, w] = t if t and t.strip() else None
            got = done[b, w]
            if got is None:
                continue
        if got != token:
            out.setdefault(got, []).append(i)
            while w == "utf-8":  # garbled more than once; every turn leaves fewer letters
                again = next((x for p in dict.fromkeys((r, "cp1252", "latin-1")) if p in to_byte and (x := _sequences(got, to_byte[p])) != got), got)
                if again == got:
                    break
                got = again
                if got != token:
                    out.setdefault(got, []).append(i)
    return out


def _sequences(token: str, to_byte: dict[int, int]) -> str:
    """The token with each whole UTF-8 sequence among its bytes decoded; other characters stay."""
    spans, last = [], 0
    for m in MULTI.finditer(token.translate(to_byte)):
        spans += [token[last : m.start()], m.group().encode("latin-1").decode("utf-8")]
        last = m.end()
    return "".join(spans) + token[last:]


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a.astype(np.uint64) * np.uint64(1_000_003) + b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def bigram_counts(texts: list[str], weights: list[int] | None = None) -> np.ndarray:
    """Counts of hashed bigrams, then of letters; ASCII digits count as one digit and white space as a blank."""
    points, weight = [], []
    for i, t in enumerate(texts):
        p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        points.append(np.concatenate([[32], p, [32]]))
        weight.append(weights[i] if weights else 1)
    size = [len(p) for p in points]
    flat = _fold(np.concatenate(points))
    w = np.repeat(weight, size)
    ends = np.cumsum(size)
    pair = np.ones(len(flat), bool)
    pair[ends - 1] = False
    i = np.flatnonzero(pair)
    two = np.bincount(_bucket(flat[i], flat[i + 1]), w[i], BUCKETS)
    one = np.bincount(flat % LETTERS, w, LETTERS)
    return np.concatenate([two, one])


def _fold(p: np.ndarray) -> np.ndarray:
    p = p.astype(np.int64)
    p[(p >= 48) & (p <= 57)] = 48
    p[(p >= 9) & (p <= 13) | (p == 0xA0)] = 32
    return p


class Bigrams:
    """Log probabilities of texts by the counts of ``bigram_counts``."""

    def __init__(self, counts: np.ndarray, smooth: float = 2.0):
        self.two, self.one = np.maximum(counts[:BUCKETS], 0), np.maximum(counts[BUCKETS:], 0)
        self.total, self.smooth = self.one.sum() + 1, smooth

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Of each text, taken as a word between blanks."""
        return self.of_letters(np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) + 2 for t in texts]))

    def of_letters(self, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of texts of ``size`` letters each, which follow each other."""
        flat = _fold(letters)
        a, b = flat[:-1], flat[1:]
        p1 = (self.one[b % LETTERS] + 0.05) / (self.total + 0.05 * LETTERS)
        p = (self.two[_bucket(a, b)] + self.smooth * p1) / (self.one[a % LETTERS] + self.smooth)
        lp = np.log(p)
        lp[b == ord(LOST)] = -14.0
        ends = np.cumsum(size)
        lp[ends[:-1] - 1] = 0.0  # from one text to the next
        return np.add.reduceat(lp, np.r_[0, ends[:-1]])

    def letter_between(self, a: str, b: str, letters: np.ndarray) -> str:
        x, y, z = np.full(len(letters), ord(a)), letters, np.full(len(letters), ord(b))
        z = _fold(z)
        p1, after = (self.one[y % LETTERS] + 0.05) / self.total, (self.one[z % LETTERS] + 0.05) / self.total
        s = np.log(self.two[_bucket(_fold(x), y)] + self.smooth * p1) + np.log((self.two[_bucket(y, z)] + self.smooth * after) / (self.one[y % LETTERS] + self.smooth))
        return chr(int(letters[int(s.argmax())]))


def substituted(token: str, reading: str, swap: int) -> list[tuple[str, str]]:
    """What stood for what, where a token became a reading by the swap: letters, or UTF-8 sequences and their letters."""
    if swap < len(swaps()):
        r, w = swaps()[swap]
        if w == "utf-8":
            to_byte = _tables()[0].get(r)
            found = [(token[m.start() : m.end()], m.group().encode("latin-1").decode("utf-8")) for m in MULTI.finditer(token.translate(to_byte))] if to_byte else []
            return found
        if r not in ONE_BYTE or w not in ONE_BYTE:
            return []
    return [(a, b) for a, b in zip(token, reading) if a != b] if len(token) == len(reading) else []


class Model:
    """What a round has learnt: bigrams, weights of swaps over all sources and per source, the mapping of letters, the readings of frequent tokens, and tables of sources."""

    def __init__(self, counts: np.ndarray, share: dict[int, float] | None = None, own: dict | None = None, odds: dict | None = None, shared: dict | None = None, tables: dict | None = None):
        self.counts, self.share, self.own, self.odds, self.shared, self.tables = counts, share, own or {}, odds or {}, shared or {}, tables or {}


class Reader:
    """Finds and restores garbled stretches; keeps what it found out about tokens."""

    def __init__(self, model: Model):
        self.m, self.lm, self.known, self.weights, self.tables = model, Bigrams(model.counts), {}, {}, model.tables
        if model.share is None:  # before anything is known: most text is written in UTF-8
            self.base = {i: -5.0 if w == "utf-8" else -8.0 for i, (_, w) in enumerate(swaps())}
        else:
            self.base = {z: max(math.log(v), -12.0) for z, v in model.share.items()}
        self.base[LEARNT] = -4.0  # a table is only there where its letters are
        self.hint = re.compile("|".join(re.escape(a) for a, _ in model.odds))
        seen = np.flatnonzero(self.lm.one)
        self.letters = np.array([c for c in seen if c > 0x7F and (chr(c).isalpha() or c in (0x2019, 0x201C, 0x201D, 0x2013, 0x20AC, 0xA3, 0xB0, 0xD7, 0x2026))] or [0xE9], np.int64)

    def weigh(self, source: str, own: tuple[float, dict[int, float]] | None) -> dict[int, float]:
        """Log weights of the swaps in a source, which lean on those of all sources as on ten documents."""
        got = self.weights.get(source)
        if got is None:
            if len(self.weights) > 1000:
                self.weights.clear()
            got = self.base
            if own and self.m.share is not None:
                docs, n = own
                got = {z: max(math.log((n.get(z, 0.0) + 10 * v) / (docs + 10)), -12.0) for z, v in self.m.share.items()} | {LEARNT: self.base[LEARNT]}
            self.weights[source] = got
        return got

    def gains(self, token: str, source: str = "") -> tuple[dict[int, tuple[float, str]], list[tuple[int, float]]]:
        """What each swap gains for the token, with the reading; and those that gain anything."""
        table = self.tables.get(source)
        kept = self.known.get((token, source) if table else token)
        if kept is None:
            packed = self.m.shared.get(token)
            got = unpacked(packed) if packed else best_readings(self.lm, [token], [readings(token)])[0]
            if table and (t := token.translate(table)) != token:
                x = self.lm([token, t])
                got = {**got, LEARNT: (float(x[1] - x[0]), t)}
            kept = got, [(i, x) for i, (x, _) in got.items() if x > 0]
            if len(token) <= KEPT:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[(token, source) if table else token] = kept
        return kept

    def _gained(self, tokens: list[str], source: str) -> tuple[list[int], list[dict], dict[int, float]]:
        """Places of the tokens that aren't ASCII, what each gains by swap, and the most that each swap can gain."""
        at = [i for i, t in enumerate(tokens) if not t.isascii()]
        seen: set[str] = set()
        all_ = []
        most_of: dict[int, float] = {}
        for i in at:  # a token that comes again tells nothing new
            if tokens[i] in seen:
                all_.append({})
                continue
            seen.add(tokens[i])
            got, up = self.gains(tokens[i], source)
            all_.append(got)
            for z, x in up:
                most_of[z] = most_of.get(z, 0.0) + x
        return at, all_, most_of

    def best(self, tokens: list[str], source: str, weights: dict[int, float], least: float) -> tuple[float, int, int, int]:
        """(log odds, swap, first, past the last token) of the stretch and swap that gain most, if that is at least ``least``."""
        at, all_, most_of = self._gained(tokens, source)
        top = (-math.inf, NEITHER, 0, 0)
        for z in sorted(most_of):
            known = weights.get(z, -12.0)
            if most_of[z] + known < max(least, top[0]):
                continue
            run, begin, most, span = 0.0, 0, 0.0, (0, 0)
            for k, g in enumerate(all_):
                if run <= 0:
                    run, begin = 0.0, k
                run += g[z][0] if z in g else 0.0
                if run > most:
                    most, span = run, (begin, k)
            odds = most + known
            if odds > top[0]:
                top = (odds, z, at[span[0]], at[span[1]] + 1)
        return top

    def stretches(self, tokens: list[str], source: str, weights: dict[int, float], least: float) -> list[tuple[float, int, int, int]]:
        """As ``best``, all stretches that reach ``least``, best first; none shares a token with a better one."""
        at, all_, most_of = self._gained(tokens, source)
        found = []
        for z in sorted(most_of):
            known = weights.get(z, -12.0)
            if most_of[z] + known < least:
                continue
            run, begin, most, last = 0.0, 0, 0.0, 0
            for k, g in enumerate([*all_, None]):
                if run <= 0 or g is None:
                    if most > 0 and most + known >= least:
                        found.append((most + known, z, begin, last))
                    run, begin, most = 0.0, k, 0.0
                if g:
                    run += g[z][0] if z in g else 0.0
                if run > most:
                    most, last = run, k
        free, out = np.ones(len(at), bool), []
        for odds, z, a, b in sorted(found, key=lambda x: -x[0]):
            if free[a : b + 1].all():
                free[a : b + 1] = False
                out.append((odds, z, at[a], at[b] + 1))
        return out

    def mapped(self, tokens: list[str], source: str) -> list[tuple[float, int, int, int]]:
        """As ``stretches``, single tokens all of whose replaced letters stand for others by the mapping learnt, and that read better so."""
        out = []
        for i, t in enumerate(tokens):
            if t.isascii() or not self.hint.search(t):
                continue
            got, up = self.gains(t, source)
            best = (0.0, NEITHER)
            for z, _ in up:
                odds = [self.m.odds.get(p, -math.inf) for p in substituted(t, got[z][1], z)]
                if odds and min(odds) > best[0]:
                    best = (min(odds), z)
            if best[1] != NEITHER:
                out.append((*best, i, i + 1))
        return out

    def restore(self, text: str, source: str, least: float, own: tuple | None = None, pairs: Counter | None = None) -> tuple[float, list[int], str]:
        """Log odds of the best stretch, the swaps applied, and the text they leave, in which no swap reaches ``least``.

        After ``SINGLE`` passes each pass mends all stretches, so long texts don't need as many passes as they have stretches; of
        those, each swap is named once. A mended token is always likelier than before, so the passes end. ``pairs`` counts what stood for what.
        """
        weights = self.weigh(source, own)
        parts = re.split("([ \t\r\n]+)", text)
        used: list[int] = []
        first, passes = -math.inf, 0
        while True:
            tokens = parts[::2]
            alone = passes < SINGLE
            found = [self.best(tokens, source, weights, least)] if alone else self.stretches(tokens, source, weights, least)
            if not passes:
                first = found[0][0]
            passes += 1
            found = [x for x in found if x[0] >= least]
            if not found and self.m.odds:
                found = self.mapped(tokens, source)
                first = max([first, *[x[0] for x in found]])
            swap_of: dict[str, int] = {}
            for _, z, a, b in found:
                if alone or z not in used:
                    used.append(z)
                for t in tokens[a:b]:
                    swap_of.setdefault(t, z)
            changed = False
            for i, t in enumerate(tokens if swap_of else ()):
                z = swap_of.get(t)
                g = self.gains(t, source)[0] if z is not None and not t.isascii() else {}
                if z in g and g[z][0] > 0:
                    parts[2 * i] = g[z][1]
                    changed = True
                    if pairs is not None:
                        pairs.update(substituted(t, g[z][1], z))
            if not changed:
                break
        now = "".join(parts)
        if LOST in now:
            used.append(len(swaps()))
            padded = list(" " + now + " ")
            for i, c in enumerate(padded):
                if c == LOST:
                    padded[i] = self.lm.letter_between(padded[i - 1], padded[i + 1] if padded[i + 1] != LOST else " ", self.letters)
            now = "".join(padded[1:-1])
            first = max(first, 50.0) if LOST in text else first
        return first, used, now


def best_readings(lm: Bigrams, tokens: list[str], every: list[dict[str, list[int]]]) -> list[dict[int, tuple[float, str]]]:
    """For each token what each swap gains, with the reading, of the readings as from ``readings``."""
    lp = lm([x for t, e in zip(tokens, every) for x in (t, *e)])
    out, k = [], 0
    for e in every:
        got: dict[int, tuple[float, str]] = {}
        for (t, own), x in zip(e.items(), (lp[k + 1 : k + 1 + len(e)] - lp[k]).tolist()):
            for i in own:
                if i not in got or x > got[i][0]:
                    got[i] = (x, t)
        out.append(got)
        k += 1 + len(e)
    return out


def spelled(token: str, every: dict[str, list[int]]) -> bytes:
    """The token and its readings ready to be scored: letters between blanks, lengths, readings, and the swaps of each as (reading, swap)."""
    texts = [token, *every]
    letters = np.frombuffer(("".join(f" {t} " for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 2 for t in texts], np.int32)
    at = np.repeat(np.arange(len(every), dtype=np.int16), [len(z) for z in every.values()])
    swap = np.array([z for own in every.values() for z in own], np.int16)
    return pickle.dumps((letters, size, list(every), at, swap), 5)


def packed(gain: np.ndarray, texts: list[str], at: np.ndarray, swap: np.ndarray) -> bytes:
    """Of each swap the best gain, with the reading where it gains anything; in few bytes, for it goes to every task."""
    x = gain[at]
    o = np.lexsort((at, -x, swap))
    o = o[np.r_[True, swap[o][1:] != swap[o][:-1]]] if len(o) else o
    used = np.unique(at[o][x[o] > 0])
    place = np.full(len(texts) + 1, -1, np.int16)
    place[used] = np.arange(len(used))
    words = "\0".join(texts[i] for i in used).encode("utf-8", "surrogatepass")
    return struct.pack("<hh", len(o), len(used)) + swap[o].astype("<i2").tobytes() + x[o].astype("<f4").tobytes() + place[at[o]].astype("<i2").tobytes() + words


def unpacked(data: bytes) -> dict[int, tuple[float, str]]:
    n, words = struct.unpack_from("<hh", data)
    swap, gain, at = (np.frombuffer(data, t, n, 4 + k * n).tolist() for t, k in (("<i2", 0), ("<f4", 2), ("<i2", 6)))
    texts = data[4 + 8 * n :].decode("utf-8", "surrogatepass").split("\0") if words else []
    return {z: (x, texts[i] if i >= 0 else "") for z, x, i in zip(swap, gain, at)}


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bigrams and letters (k), and of the tokens that aren't ASCII."""
    total, tokens = np.zeros(BUCKETS + LETTERS), Counter()

    def rows(k: np.ndarray) -> pa.RecordBatch:
        words = list(tokens)
        n = [*total[k].tolist(), *map(float, tokens.values())]
        tokens.clear()
        return pa.RecordBatch.from_arrays([pa.array([*k.tolist(), *[NEITHER] * len(words)], pa.int64()), pa.array([None] * len(k) + words, pa.string()), pa.array(n, pa.float64())], names=["k", "token", "n"])

    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        for k in range(0, len(texts), 2000):
            total += bigram_counts(texts[k : k + 2000])
            for t in texts[k : k + 2000]:
                if not t.isascii():
                    tokens.update(w for w in re.split("[ \t\r\n]+", t) if not w.isascii())
            if len(tokens) > 500_000:
                yield rows(np.zeros(0, np.int64))
    yield rows(np.flatnonzero(total))


def reads_as_usual(token: str, usual: dict[int, float]) -> bool:
    """Whether the token's bytes in some one-byte page are UTF-8 from end to end, all of it letters more usual than the token's rarest one.

    ``usual`` has the counts of the letters. A file mark among the UTF-8 sequences is enough by itself.
    """
    to_byte, _ = _tables()
    if not PAIR.search(token):
        return False
    least = min(usual.get(ord(c), 0.0) for c in token if ord(c) > 127)
    for t in to_byte.values():
        raw = token.translate(t)
        found = "".join(m.encode("latin-1").decode("utf-8") for m in MULTI.findall(raw))
        if MARK in found or found and not OTHER.search(MULTI.sub("", raw)) and all(usual.get(ord(c), 0.0) > least for c in found):
            return True
    return False


def _doubt_map(batches: Iterator[pa.RecordBatch], usual) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens (first column, with their numbers) for which ``reads_as_usual`` holds."""
    total = np.zeros(BUCKETS + LETTERS)
    for b in batches:
        hit = [(t, n) for t, n in zip(*(c.to_pylist() for c in b.columns)) if reads_as_usual(t, usual.value)]
        if hit:
            total += bigram_counts([t for t, _ in hit], [n for _, n in hit])
    i = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["k", "n"])


def _readings_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spelled(t, readings(t)) for t in b.column(0).to_pylist()], pa.binary())], names=["token", "every"])


def _score_map(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    lm = Bigrams(model.value.counts)
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            part = b.slice(k, 1000)
            every = [pickle.loads(x) for x in part.column(1).to_pylist()]
            lp = lm.of_letters(np.concatenate([e[0] for e in every]), np.concatenate([e[1] for e in every]))
            out, i = [], 0
            for _, size, texts, at, swap in every:
                out.append(packed(lp[i + 1 : i + len(size)] - lp[i], texts, at, swap))
                i += len(size)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["token", "gains"])


def _rows(b: pa.RecordBatch, model: Model) -> Iterator[tuple[str, str, tuple | None]]:
    """(source, text, what the source has of its own) of each row: from the columns or, if there are but two more, from the model."""
    own = [(n, dict(w)) if n is not None else None for n, w in zip(b.column("_docs").to_pylist(), b.column("_own").to_pylist())] if "_own" in b.schema.names else None
    for i, (s, t) in enumerate(zip(b.column("_source").to_pylist(), b.column("_text").to_pylist())):
        yield s, t, own[i] if own else model.own.get(s)


def _expect_map(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    """What the M step needs: changes of bigram counts (k >= 0), weights of swaps (source, -2 - swap), letters that stay (source, LETTER - letter), what stood for what (pair)."""
    reader, change, seen, pairs = Reader(model.value), np.zeros(BUCKETS + LETTERS), Counter(), Counter()
    for b in batches:
        old, new, left = [], [], {}
        for source, text, own in _rows(b, model.value):
            _, used, now = reader.restore(text, source, least, own, pairs)
            seen[source, NEITHER] += 1
            for z in used:
                seen[source, -2 - z] += 1
            left.setdefault(source, []).append(now)
            if used:
                old.append(text)
                new.append(now)
        if old:
            change += bigram_counts(old + new, [-1] * len(old) + [1] * len(new))
        for source, texts in left.items():
            c, n = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            seen.update({(source, LETTER - k): v for k, v in zip(c.tolist(), n.tolist()) if k > 127})
    i = np.flatnonzero(change)
    rows = [*zip([""] * len(i), i.tolist(), [None] * len(i), change[i].tolist()), *[(s, k, None, float(n)) for (s, k), n in seen.items()], *[("", PAIRS, f"{a}\0{b}", float(n)) for (a, b), n in pairs.items()]]
    kinds = {"source": pa.string(), "k": pa.int64(), "pair": pa.string(), "n": pa.float64()}
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds.values())], names=list(kinds))


def _find_map(batches: Iterator[pa.RecordBatch], model, least: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    reader = Reader(model.value)
    label = [f"{w} read as {r}" for r, w in swaps()] + ["letters lost", "learnt table"]
    for b in batches:
        rows = []
        tables = b.column("_table").to_pylist() if "_table" in b.schema.names else None
        for i, (source, text, own) in enumerate(_rows(b, model.value)):
            if tables:
                reader.tables = {source: dict(tables[i] or [])}
            odds, used, now = reader.restore(text, source, least, own)
            if used:
                rows.append((i, odds, [label[z] for z in used], now))
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())], names=names)


# tables of pages that aren't listed


def solve(pairs: dict[tuple[int, int], float], cipher: set[int], counts: np.ndarray, rounds: int = 500) -> dict[int, int]:
    """What each letter of ``cipher`` stands for, by EM against the bigrams of the corpus.

    ``pairs``: counts of the bigrams of the garbled text, with ASCII letters that stand for themselves. Their matrix is modelled as T' P T, where
    P has the bigrams of the corpus and T the chances that a letter is written as a cipher letter. The rounds end when the likelihood no longer grows.
    EM starts from an even table and from the table of each one-byte swap; the likeliest end counts. A letter whose best reading has less than half
    of its weight has no entry. There is no table at all if it leaves a fifth of the letters open, or if the text it makes reads worse than the corpus:
    then the letters are more likely those of a language that only this source has.
    """
    lm = Bigrams(counts)
    plain = sorted({a for p in pairs for a in p} - cipher)
    seen = [int(c) for c in np.flatnonzero(lm.one) if c > 127 and chr(c).isalpha() and c not in cipher]
    seen = sorted(seen, key=lambda c: -lm.one[c])[:512]  # rarer letters than these have no bigrams to tell them by
    letters, signs = np.array(plain + seen), np.array(plain + sorted(cipher))
    where = {c: i for i, c in enumerate(signs)}
    obs = np.zeros((len(signs), len(signs)))
    for (a, b), n in pairs.items():
        obs[where[a], where[b]] += n
    p = lm.two[_bucket(letters[:, None], letters[None, :])] + lm.smooth * np.outer(lm.one[letters], lm.one[letters]) / lm.total / 50
    p /= p.sum()
    fixed, own = len(plain), sorted(cipher)

    def fit(free: np.ndarray) -> tuple[float, np.ndarray]:
        t = np.zeros((len(letters), len(signs)))
        t[np.arange(fixed), np.arange(fixed)] = 1.0
        t[fixed:, fixed:] = free / free.sum(1, keepdims=True)
        last = -np.inf
        for i in range(rounds):
            r = obs / np.maximum(t.T @ p @ t, 1e-300)
            like = float((obs * np.log(np.maximum(t.T @ p @ t, 1e-300))).sum())
            if i and like - last < 1e-7 * abs(last):
                break
            last = like
            e = t * (p @ t @ r.T + p.T @ t @ r)  # expected counts of letters written as signs
            n = e[fixed:, fixed:]
            t[fixed:, fixed:] = (n + 1e-9) / (n + 1e-9).sum(1, keepdims=True)
        weight = e[fixed:, fixed:]
        return last, weight / np.maximum(weight.sum(0, keepdims=True), 1e-300)

    rng = np.random.default_rng(0)
    starts = [np.ones((len(seen), len(own))) + rng.random((len(seen), len(own))) * f for f in (0.05, 0.5, 1.0, 2.0, 4.0)]
    place = {c: i for i, c in enumerate(seen)}
    for table in _tables()[1].values():
        known = [(place.get(ord(table.get(c, "\0"))), j) for j, c in enumerate(own)]
        known = [(i, j) for i, j in known if i is not None]
        if 2 * len(known) >= len(own):
            start = np.full((len(seen), len(own)), 0.02)
            for i, j in known:
                start[i, j] = 1.0
            starts.append(start)
    _, weight = max((fit(x) for x in starts), key=lambda x: x[0])
    best = weight.argmax(0)
    table = {c: seen[best[j]] for j, c in enumerate(own) if weight[best[j], j] >= 0.5}
    known = obs[:, [where[c] for c in table]].sum() if table else 0.0
    if known < 0.8 * obs[:, fixed:].sum():
        return {}
    # the text must read about as well as the corpus does
    given = np.log(p / p.sum(1, keepdims=True))
    to = {c: i for i, c in enumerate(letters)}
    at = np.array([to.get(table.get(c, c), -1) for c in signs])
    own_pairs = obs * ((at >= 0)[:, None] & (at >= 0)[None, :])
    reads = (own_pairs * given[at][:, at]).sum() / own_pairs.sum()
    usual = p[fixed:].copy()
    return table if reads >= (usual * given[fixed:]).sum() / usual.sum() - 1.0 else {}


def _odd_letters(kept: DataFrame, ratio: float, least: int, letters: int) -> DataFrame:
    """(source, odd): letters that a source has ``ratio`` times as often as the others do and at least ``least`` times, of sources that have ``letters`` such."""
    total = kept.groupBy("source").agg(F.sum("n").alias("in_source"))
    by_letter = kept.groupBy("c").agg(F.sum("n").alias("of_letter"))
    whole = kept.agg(F.sum("n").alias("whole"))
    small = lambda d: bounded(d)[0]
    rows = kept.join(small(total), "source").join(F.broadcast(by_letter), "c").join(F.broadcast(whole))  # at most one row for each letter there is; one row
    odd = (F.col("n") >= least) & (F.col("n") / F.col("in_source") > ratio * (F.col("of_letter") - F.col("n") + 1) / (F.col("whole") - F.col("in_source") + 1)) & (F.col("whole") > F.col("in_source"))
    return rows.where(odd).groupBy("source").agg(F.collect_set("c").alias("odd")).where(F.size("odd") >= letters)


def _pair_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams (source, a, b, n) of the tokens that hold one of the odd letters of their source."""
    seen: Counter = Counter()
    kinds = {"source": pa.string(), "a": pa.int64(), "b": pa.int64(), "n": pa.float64()}

    def counted() -> pa.RecordBatch:
        rows = [(*k, float(n)) for k, n in seen.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds.values())], names=list(kinds))

    for b in batches:
        for source, text, odd in zip(*(c.to_pylist() for c in b.columns)):
            odd = set(odd)
            for w in re.split("[ \t\r\n]+", text):
                c = [32, *map(ord, w), 32]
                if odd.intersection(c):
                    c = [48 if 48 <= x <= 57 else x for x in c]  # a blank such as U+00A0 may be a cipher letter
                    seen.update((source, x, y) for x, y in zip(c[:-1], c[1:]))
            if len(seen) > 500_000:
                yield counted()
    yield counted()


def learnt_tables(foreign: DataFrame, kept: DataFrame, model, ratio: float = 50.0, least: int = 30, letters: int = 6) -> tuple[dict[str, dict[int, int]], DataFrame | None, np.ndarray]:
    """Tables of the sources that hold letters of an unlisted page, and what bigram counts change by when the tables are applied.

    ``kept``: (source, c, n), the letters that stay once listed pages are undone. The cipher's are all letters that occur ``least`` times in tokens with odd ones.
    If more than ``SOURCES`` sources have odd letters, their tables don't come to the driver but are rows (_source, _table).
    """
    change = np.zeros(BUCKETS + LETTERS)
    odd, few = bounded(checkpointed(_odd_letters(kept, ratio, least, letters)), SOURCES)
    if not odd.head(1):
        return {}, None, change
    docs = foreign.select("_source", "_text").join(odd, F.col("_source") == F.col("source"))
    pairs = docs.select("source", "_text", "odd").mapInArrow(_pair_map, "source string, a long, b long, n double").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))

    def one(pdf):
        import pandas as pd

        counts = model.value.counts.copy()
        often = pdf.groupby("b").n.sum()
        cipher = {int(c) for c in often.index[often >= least] if c > 127}
        for c in ("a", "b"):  # other letters end a word
            pdf[c] = pdf[c].where((pdf[c] < 128) | pdf[c].isin(cipher), 32)
        a, b, n = (pdf.groupby(["a", "b"], as_index=False).n.sum()[c].to_numpy() for c in ("a", "b", "n"))
        at = _bucket(_fold(a), _fold(b))
        np.add.at(counts, at, -n)  # the corpus without this text
        np.add.at(counts, BUCKETS + _fold(b) % LETTERS, np.where(b == 32, 0, -n))
        table = solve(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())), cipher, counts)
        read = lambda x: np.array([table.get(c, c) for c in x.tolist()], np.int64)
        k = np.concatenate([at, BUCKETS + _fold(b) % LETTERS, _bucket(_fold(read(a)), _fold(read(b))), BUCKETS + _fold(read(b)) % LETTERS])
        n = np.concatenate([-n, np.where(b == 32, 0, -n), n, np.where(b == 32, 0, n)])
        rows = [(pdf.source.iloc[0], c, to, 0.0) for c, to in table.items()] + ([("", int(i), -1, float(x)) for i, x in zip(k, n)] if table else [])
        return pd.DataFrame(rows, columns=["source", "c", "to", "n"])

    got = pairs.groupBy("source").applyInPandas(one, "source string, c long, to long, n double")  # a group has at most the square of its letters
    got = checkpointed(got.groupBy("source", "c", "to").agg(F.sum("n").alias("n")))
    moved = got.where("to < 0").toPandas()
    change[moved.c.to_numpy(np.int64)] += moved.n.to_numpy()
    tables = got.where("to >= 0").groupBy(F.col("source").alias("_source")).agg(F.map_from_entries(F.collect_list(F.struct("c", "to"))).alias("_table"))
    return ({r["_source"]: r["_table"] for r in tables.collect()}, None, change) if few else ({}, tables, change)


def find_garbled(df: DataFrame, doc_id: str, text: str, source: Column | None = None, least: float = 0.0, learn: float = 4.0, settle: float = 0.01, rounds: int = 20) -> DataFrame:
    """``doc_id``, log_odds, swaps and restored text of the documents with a garbled stretch.

    The bigrams, weights and mappings come from all texts. Null and empty texts, and texts of ASCII alone, are never garbled. Texts may have any
    length; rows that repeat an id are judged one by one. ``source`` may be null (a source of its own). A swap is applied where its log odds over
    the text as it is reach ``least`` (``learn`` while learning). EM ends once the documents of the swaps change by less than ``settle`` of all
    garbled ones (the model that has settled is the one applied), or after ``rounds``. What comes to the driver is of fixed size: counts in 2**20 buckets, weights of swaps, what letters stood for, the
    readings of ``SHARED`` tokens; and the weights and learnt tables of at most ``SOURCES`` sources, those of more are joined to the documents. Empty gives empty.
    """
    spark = shipped(df.sparkSession)
    sc = spark.sparkContext
    t = F.col(text)
    src = F.lit("0") if source is None else F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))
    every = checkpointed(df.where(t.isNotNull()).select(t).mapInArrow(_count_map, "k long, token string, n double").groupBy("k", "token").agg(F.sum("n").alias("n")))
    got = every.where("token is null").select("k", "n").toPandas()
    counts = np.zeros(BUCKETS + LETTERS)
    counts[got["k"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    tokens = every.where("token is not null").select("token", "n")
    usual = sc.broadcast({int(c): float(counts[BUCKETS + c]) for c in np.flatnonzero(counts[BUCKETS:])})
    got = tokens.mapInArrow(lambda it: _doubt_map(it, usual), "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    every_text, counts = counts, counts.copy()
    counts[got["k"].to_numpy(dtype=np.int64)] -= got["n"].to_numpy()
    common = tokens.where(F.length("token") <= SHORT).orderBy(F.desc("n"), "token").limit(SHARED).select("token")
    common = checkpointed(common.repartition(max(sc.defaultParallelism, 8), "token").mapInArrow(_readings_map, "token string, every binary"))
    foreign = df.where(t.rlike("[^\\x00-\\x7F]")).select(F.col(doc_id), src.alias("_source"), t.alias("_text"))

    held: list = []

    def scored(model: Model):
        for old in held:
            old.unpersist()  # Spark sends it again should a lost task need it
        plain = sc.broadcast(model)
        got = common.mapInArrow(lambda it: _score_map(it, plain), "token string, gains binary").toPandas()
        model.shared = dict(zip(got["token"], got["gains"]))
        held[:] = [plain, sc.broadcast(model)]
        return held[1]

    model, docs, before, now = Model(counts), foreign, None, None
    n_swaps = len(swaps()) + 1
    for _ in range(rounds):
        now = scored(model)
        step = checkpointed(docs.mapInArrow(lambda it, m=now: _expect_map(it, m, learn), "source string, k long, pair string, n double").groupBy("source", "k", "pair").agg(F.sum("n").alias("n")))
        got = step.where("k >= 0").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        counts = every_text.copy()
        counts[got["k"].to_numpy(dtype=np.int64)] += got["n"].to_numpy()
        weights = step.where(f"k < 0 and k > {LETTER}").select("source", (-2 - F.col("k")).alias("z"), "n")
        total = {int(r["z"]): r["n"] for r in weights.groupBy("z").agg(F.sum("n").alias("n")).collect()}
        n_docs = total.pop(NEITHER, 0.0)
        share = {z: (total.get(z, 0.0) + 0.02) / (n_docs + 1.0 + 0.02 * n_swaps) for z in range(n_swaps)}
        own = weights.groupBy("source").agg(F.sum(F.when(F.col("z") == NEITHER, F.col("n"))).alias("_docs"), F.map_from_entries(F.collect_list(F.when(F.col("z") != NEITHER, F.struct(F.col("z").cast("int"), "n")))).alias("_own"))
        own, few = bounded(own, SOURCES)
        of_source = {r["source"]: (r["_docs"], r["_own"]) for r in own.collect()} if few else {}
        docs = foreign if few else foreign.join(own.withColumnRenamed("source", "_source"), "_source", "left").select(F.col(doc_id), "_source", "_text", "_docs", "_own")
        odds = {}
        for r in step.where(f"k = {PAIRS}").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            a, b = r["pair"].split("\0", 1)
            code = _fold(np.array([ord(c) for c in a]))
            stay = counts[BUCKETS + code[0] % LETTERS] if len(a) == 1 else counts[_bucket(code[:-1], code[1:])].min()
            if r["n"] >= SEEN and r["n"] >= 4 * stay:
                odds[a, b] = math.log((r["n"] + 1) / (max(stay, 0.0) + 1))
        last, model = model, Model(counts, share, of_source, odds)
        moved = sum(abs(total.get(z, 0.0) - (before or {}).get(z, 0.0)) for z in {*total, *(before or {})})
        if before is not None and moved <= settle * sum(total.values()):
            break
        before = total
    else:
        last, now = model, scored(model)
    kept = step.where(f"k <= {LETTER} and k > {PAIRS}").select("source", (LETTER - F.col("k")).alias("c"), "n")
    last.tables, tables, change = learnt_tables(foreign, kept, now)
    if tables is not None:
        docs = docs.join(tables, "_source", "left").select(*docs.columns, "_table")
    if last.tables or change.any():
        last.counts = last.counts + change
        now = scored(last)
    kind = dict(df.dtypes)[doc_id]
    return docs.mapInArrow(lambda it: _find_map(it, now, least, [doc_id, "log_odds", "swaps", "restored"]), f"`{doc_id}` {kind}, log_odds double, swaps array<string>, restored string")
