"""Benchmark decontamination by random-walk embeddings, bit-sampling LSH and exact edit distance.

Texts and items are sequences of lower-cased words (letters and digits; the rest separates);
in scripts without blanks between words each character is a word.
A document holds an item if a stretch of its words is within ``percent`` / 100 of the item's
words in edit distance (insertions, deletions, replacements). It is found in three steps:

1. A window within k edits of an item of n words keeps at least n - q + 1 - q * k of its word
   q-grams. Only stretches that keep so many of some item are windows worth embedding: none
   that matches is lost, and what is embedded is a small part of a text.
2. Item-sized windows from every start in such a stretch go through the CGK random walk, as the
   items did: step t emits the word under the pointer, and a random bit for (t, word) says
   whether the pointer moves on. Edit distance becomes Hamming distance. Of each of several
   walks, several samples of places are band keys: (words of the item, walk, band, what stands
   at the places). Items are indexed by their band keys, and windows meet them there: LSH by
   bit sampling, repeated as often as the target recall asks for (``tests`` measure it).
3. Items that a window meets are verified by the exact edit distance of the item to the best
   stretch of words around.

Items are taken in blocks of at most ``WORDS_AT_ONCE`` words. One block is usual. Of more, each
has a pass over the documents of its own, whose few matches are written before the next, so
one block at a time is held; documents are never shuffled but for the rows that match.

Defined results: a null or empty text holds nothing; items that are null or have no
word take no part; items of under five words match exactly; of an item's matches in a text the
nearest, and of equals the first, is given; equal items each match; equal rows each get their result;
texts of any length are read whole; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import map_columns, prepared, staged

PERCENT, WORDS_AT_ONCE = 20, 1_000_000
#: Walks, bands a walk, places a band, steps a word of the item.
WALKS, BANDS, PLACES, STEPS = 6, 16, 3, 2
#: Tokens that a worker remembers, and windows embedded at a time.
KNOWN, WINDOWS = 150_000, 16_384
#: Fixed value: letters of scripts without blanks between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003fffd"
_WORD = re.compile(rf"[^\W_{UNSPACED}]+|(?![\W_])[{UNSPACED}]")
_NONE = -1

SPAN = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "begin", "end", "distance", "words")])
)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def coins(steps: np.ndarray, symbols: np.ndarray, walk: int) -> np.ndarray:
    """A fair bit for each step of a walk (rows) and symbol (columns)."""
    with np.errstate(over="ignore"):
        h = symbols.astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + (steps.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(walk * 7_919 + 1))[:, None]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def embedded(rows: np.ndarray, walk: int) -> np.ndarray:
    """CGK outputs (windows x steps) of equally long windows of word codes; past the end the output is padding."""
    m, n = rows.shape
    symbols, at_symbol = np.unique(np.concatenate([rows, np.full((m, 1), _NONE, rows.dtype)], 1), return_inverse=True)
    flat, width = at_symbol.reshape(-1), n + 1
    bits = coins(np.arange(STEPS * n), symbols, walk)
    out = np.empty((STEPS * n, m), np.int64)
    at, first = np.zeros(m, np.int64), np.arange(m) * width
    for t in range(STEPS * n):
        s = flat[first + at]
        out[t] = s
        at = np.minimum(at + bits[t, s], n)
    return symbols[out.T]


def places(n: int) -> np.ndarray:
    """Sampled steps for items of n words: walks x bands x places, the same for items and windows."""
    return np.random.default_rng(1_000 + n).integers(0, STEPS * n, (WALKS, BANDS, PLACES))


def band_keys(rows: np.ndarray, walk: int) -> np.ndarray:
    """Keys of a walk's bands (windows x bands) of equally long windows of word codes."""
    n = rows.shape[1]
    out = embedded(rows, walk)
    with np.errstate(over="ignore"):
        key = np.tile((np.uint64(n * 64 + walk) * np.uint64(1 << 10) + np.arange(BANDS, dtype=np.uint64)), (len(rows), 1))
        for at in places(n)[walk].T:
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + out[:, at].astype(np.uint64)
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return key


def nearest(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(distance, begin, end) of the stretch of ``doc`` with the least edit distance to ``item``; the first of equals."""
    j = np.arange(len(doc) + 1)
    d, start = np.zeros(len(doc) + 1, np.int64), j.copy()
    for i, s in enumerate(item):
        swap = d[:-1] + (doc != s)
        drop = d[1:] + 1
        up = np.where(swap <= drop, swap, drop)
        frm = np.where(swap <= drop, start[:-1], start[1:])
        up, frm = np.concatenate([[i + 1], up]), np.concatenate([[0], frm])
        low = np.minimum.accumulate(up - j)
        best = np.maximum.accumulate(np.where(up - j == low, j, 0))
        d, start = low + j, frm[best]
    end = int(d.argmin())
    return int(d[end]), int(start[end]), end


class Items:
    """A block of items, ready for search: word codes, seeds (word q-grams) and where items have them."""

    def __init__(self, items: list[tuple[int, str]], percent: int = PERCENT):
        self.code: dict[str, int] = {}
        self.ids, self.words, self.edits, self.q, self.need = [], [], [], [], []
        for i, text in items:
            w = [x.lower() for x in words(text)]
            if not w:
                continue
            n, k = len(w), len(w) * percent // 100
            q = next((q for q in (3, 2, 1) if n - q + 1 - q * k >= 1), 1)
            self.ids.append(i)
            self.words.append(np.array([self.code.setdefault(x, len(self.code) + 1) for x in w], np.int64))
            self.edits.append(k)
            self.q.append(q)
            self.need.append(max(1, n - q + 1 - q * k))
        self.base = len(self.code) + 1
        self.known: dict[str, int] = {}
        self.seeds = {}
        for q in set(self.q):
            keys, own = [], []
            for i, w in enumerate(self.words):
                if self.q[i] == q:
                    g = np.unique(self.grams(w, q))
                    keys.append(g)
                    own.append(np.full(len(g), i))
            keys, own = np.concatenate(keys), np.concatenate(own)
            order = np.argsort(keys, kind="stable")
            self.seeds[q] = (keys[order], own[order])
        self.n, self.k, self.r = (np.array(x, np.int64) for x in ([len(w) for w in self.words], self.edits, self.need))
        self.qs = np.array(self.q, np.int64)
        self.bands = [self.indexed(walk) for walk in range(WALKS)]

    def indexed(self, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted band keys of a walk, the items that have them)."""
        keys, own = [], []
        for n in np.unique(self.n) if len(self.n) else ():
            at = np.flatnonzero(self.n == n)
            for i in range(0, len(at), 1_024):
                k = band_keys(np.stack([self.words[j] for j in at[i : i + 1_024]]), walk)
                keys.append(k.ravel())
                own.append(np.repeat(at[i : i + 1_024], BANDS))
        keys, own = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, own))
        order = np.argsort(keys, kind="stable")
        return keys[order], own[order]

    def met(self, rows: np.ndarray, walk: int) -> list[tuple[int, int]]:
        """Distinct (item, window) that have a band key of a walk in common."""
        keys, own = self.bands[walk]
        k = band_keys(rows, walk)
        lo, hi = np.searchsorted(keys, k.ravel(), "left"), np.searchsorted(keys, k.ravel(), "right")
        size = hi - lo
        if not size.any():
            return []
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pairs = np.stack([own[at], np.repeat(np.repeat(np.arange(len(rows)), BANDS), size)], 1)
        return [(int(i), int(j)) for i, j in np.unique(pairs, axis=0)]

    def grams(self, codes: np.ndarray, q: int) -> np.ndarray:
        """q-grams as integers; -1 where a word is in no item."""
        if len(codes) < q:
            return np.empty(0, np.int64)
        m = len(codes) - q + 1
        key, known = np.zeros(m, np.int64), np.ones(m, bool)
        for i in range(q):
            c = codes[i : m + i]
            key = key * self.base + c
            known &= c > 0
        return np.where(known, key, -1)

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first start, last start) of windows that keep enough seeds of an item."""
        own, pos = [], []
        for q, (keys, items) in self.seeds.items():
            g = self.grams(codes, q)
            at = np.flatnonzero(g >= 0)
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            n = hi - lo
            if not n.sum():
                continue
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            own.append(items[flat])
            pos.append(np.repeat(at, n))
        if not own:
            return []
        own, pos = np.concatenate(own), np.concatenate(pos)
        order = np.lexsort((pos, own))
        own, pos = own[order], pos[order]
        to = np.arange(len(own)) + self.r[own] - 1
        ok = to < len(own)
        last = np.minimum(to, len(own) - 1)
        ok &= (own[last] == own) & (pos[last] - pos <= self.n[own] + self.k[own] - self.qs[own])
        out: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(ok):
            it = int(own[i])
            first, end = max(0, int(pos[last[i]] + self.qs[it] - self.n[it] - self.k[it])), int(pos[i])
            if out and out[-1][0] == it and first <= out[-1][2] + 1:
                out[-1] = (it, out[-1][1], max(end, out[-1][2]))
            else:
                out.append((it, first, max(first, end)))
        return out

    def codes(self, text: str) -> np.ndarray:
        """Codes of all words, 0 for those in no item. Blank-separated tokens of one word each are looked up whole."""
        tokens, known = text.split(), self.known
        got = list(map(known.get, tokens))
        if None in got:
            if len(known) > KNOWN:
                known.clear()
            for i, c in enumerate(got):
                if c is None:
                    w = _WORD.findall(tokens[i])
                    got[i] = known[tokens[i]] = self.code.get(w[0].lower(), 0) if len(w) == 1 else -1
        if -1 in got:
            got = [self.code.get(x.lower(), 0) for x in _WORD.findall(text)]
        return np.array(got, np.int64)

    def search(self, codes: np.ndarray, n: int, at: np.ndarray, spans_of: dict, best: dict) -> None:
        """Put into ``best`` the nearest match of each item of n words that a window from a place of ``at`` meets."""
        padded = np.concatenate([codes, np.full(n, _NONE, np.int64)])
        tried: set[tuple[int, int]] = set()
        for walk in range(WALKS):
            if walk:  # windows of which every stretch has been verified need no further walk
                rest = [np.arange(x[0], x[1] + 1) for it, spans in spans_of.items() if self.n[it] == n for x in spans if (it, x[0]) not in tried]
                at = np.unique(np.concatenate(rest)) if rest else at[:0]
            for i in range(0, len(at), WINDOWS):
                some = at[i : i + WINDOWS]
                for it, j in self.met(padded[some[:, None] + np.arange(n)], walk):
                    place, k = int(some[j]), int(self.k[it])
                    # the whole stretch that has the window: the nearest match in it is wanted
                    first, last = next((x for x in spans_of.get(it, ()) if x[0] <= place <= x[1]), (place, place))
                    if (it, first) in tried or it in best and not best[it][0] and best[it][1] <= first:
                        continue
                    tried.add((it, first))
                    lo, hi = max(0, first - k), min(len(codes), last + n + k)
                    d, b, e = nearest(self.words[it], codes[lo:hi])
                    if d <= k and (it not in best or (d, lo + b) < best[it][:2]):
                        best[it] = (d, lo + b, lo + e)

    def found(self, text: str | None) -> list[dict]:
        """The items that ``text`` holds, each with its nearest stretch (places are characters of the text)."""
        if not text or not self.ids:
            return []
        codes = self.codes(text)
        best: dict[int, tuple[int, int, int]] = {}
        spans_of: dict[int, list[tuple[int, int]]] = {}
        starts: dict[int, list[np.ndarray]] = {}
        for it, first, last in self.stretches(codes):
            n = int(self.n[it])
            if not self.k[it] and n == self.q[it]:  # the seed is the whole item
                best.setdefault(it, (0, first, first + n))
                continue
            spans_of.setdefault(it, []).append((first, last))
            starts.setdefault(n, []).append(np.arange(first, last + 1))
        for n, lists in starts.items():
            self.search(codes, n, np.unique(np.concatenate(lists)), spans_of, best)
        if not best:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        rows = [{"item_id": int(self.ids[it]), "begin": spans[b][0], "end": spans[e - 1][1], "distance": d, "words": int(self.n[it])} for it, (d, b, e) in best.items()]
        return sorted(rows, key=lambda r: (r["item_id"], r["begin"]))


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of a bounded number of words each."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // WORDS_AT_ONCE)) if total > WORDS_AT_ONCE else 1
    if n == 1:
        return [items]
    items = staged(items, "items")
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def matched(docs: DataFrame, benchmark: DataFrame, out: str = "held", percent: int = PERCENT) -> DataFrame:
    """Append ``out``: the benchmark items that each text holds, as an array of (item_id, begin, end, distance, words)."""
    parts = blocks(benchmark)
    if len(parts) == 1:
        return _held(docs, parts[0], out, percent)
    docs = staged(docs.withColumn("matched row", F.monotonically_increasing_id()), "documents")
    found = None
    for block in parts:
        rows = _held(docs.select("matched row", "text"), block, "h", percent).where(F.size("h") > 0).select("matched row", "h")
        rows = staged(rows, "matched")
        found = rows if found is None else found.unionByName(rows)
    found = found.groupBy("matched row").agg(F.array_sort(F.flatten(F.collect_list("h"))).alias(out))
    rest = docs.drop(out).join(found, "matched row", "left")
    return rest.withColumn(out, F.coalesce(out, F.array().cast(SPAN))).drop("matched row")


def _held(docs: DataFrame, block: DataFrame, out: str, percent: int) -> DataFrame:
    rows = sorted((r["item_id"], r["text"]) for r in block.collect())  # bounded by WORDS_AT_ONCE
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def make() -> Callable:
        items = Items(shared.value, percent)
        return lambda texts: [[items.found(t) for t in texts]]

    return map_columns(docs, ["text"], [(out, SPAN)], make)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns."""
    return matched(docs, benchmark, "benchmark items held").where(F.size("benchmark items held") == 0).drop("benchmark items held")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = prepared(spark).read.parquet
    docs = read(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = matched(docs, read(f"{sf_dir}/benchmark.parquet"))
    return held.select("doc_id", F.explode("held").alias("h")).select("doc_id", "h.*")
