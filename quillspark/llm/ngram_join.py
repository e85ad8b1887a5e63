"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct word shingles. Two documents link when their sets have a
Jaccard similarity of at least ``percent`` / 100. The join finds the classes that links make:

1. Equal sets are one class from the start; everything below sees one node per class.
2. Shingles that are frequent in the corpus sort last, by frequency, all others first, by
   hash. Linked sets share at least k of their first ``n - ceil(s * n) + k`` shingles.
3. With k = 2: shingles that few prefixes hold are indexed singly. Of those that many hold,
   combinations of two are. A linked pair has two common shingles there: two rare ones, a rare
   and a frequent one, or a combination of two frequent ones. In the first case the single
   index has it twice, in the second once and both have frequent shingles, in the third the
   index of combinations has it; other pairs are dropped. A shingle counts for a pair only where
   it may be one of the first two common ones: with c common shingles needed, at most n - c + 1
   of a set's n come before it, in both sets. ``n`` and so c differ by pair, and most chance meetings end here.
4. Candidates pass a size test and a parity bitmap test, both of which only drop pairs that
   cannot link, and then an exact count of the intersection.
5. Combinations that many classes still hold are bundles of near copies. Their classes are
   compared with one leader first; what that joins needs no further comparison.
6. What leaders leave open of a bundle is compared in blocks of bounded size, each pair of
   blocks in a task of its own; a task returns no more links than it has members. If that is
   over ``BLOCKS`` blocks, it is indexed by parts instead, and so are sets with over ``WIDE`` frequent shingles in their prefix (they
   would make too many combinations) with all that may link with them: linked sets of a size
   class differ in at most h shingles, so of more than h parts, into which a hash deals all
   shingles, one agrees. A set has as many parts as a fixed share of its size. Parts are of
   shingles that are not frequent first, and of all for sets that have too few such.
7. Parts that many classes hold get leaders as well, and the rest of these goes into blocks.

No step holds an unbounded group in one task, and nothing is dropped: every linked pair is
compared or already joined through others.

Shingles take more room than texts, so no table holds all of them: one pass over the texts
counts them, one indexes prefixes, and those of compared sets are made again from their texts.
``docs`` is read several times and has to hold the same rows each time.

Defined results: a null text, or one without words, has the empty set and links with nothing;
fewer words than a shingle needs make one shingle of all of them; equal rows are one class;
an empty table gives an empty table; a null doc_id never names a component unless all of its
documents have none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.common import components, joined_split, map_columns, prepared, staged

#: A token is indexed singly up to this many prefixes, a combination pairwise up to this many classes.
FEW = 64
#: Frequent tokens sort last: at least FREQUENT sightings, and a share of all tokens that at most 2**TOP_BITS tokens can have.
FREQUENT, TOP_BITS = 24, 22
#: A token seen more than OFTEN * FEW times in the corpus is known to be too frequent for the single index.
OFTEN = 16
#: A part is paired up to this many classes; open bundles of up to so many blocks are compared without parts.
FEW_PARTS, BLOCKS = 8, 8
#: Tokens that a task counts at a time, those whose counts it keeps, and members of a block.
COUNT_AT_ONCE, COUNTS_KEPT, BLOCK = 1_000_000, 2_500_000, 512
#: Frequent shingles of a prefix that are combined; sets with more are indexed by parts, and so is what may link with them.
WIDE = 256
#: Rows whose pairs a task makes at a time; a row is in less than FEW pairs.
PAIR_AT_ONCE = 50_000
#: Steps in which a prefix row tells its token's place; the last value marks common tokens.
STEPS = 63
#: Rows of a batch that a task returns.
ROWS_OUT = 50_000
#: Rows (of two numbers or so) up to which a side is broadcast; beyond, both sides are shuffled.
SMALL = 500_000
#: Pairs of a class that one task joins, and parts in which bundles too many for a broadcast are joined.
SPLIT, SALTS = 512, 32

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingler(width: int) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its sorted distinct shingle hashes; words are lower-cased in A-Z only."""

    def work(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(width, len(w))
        with np.errstate(over="ignore"):
            h = np.full(len(w) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h + w[i : len(w) - n + 1 + i]) * _ODD[i % len(_ODD)]
                h ^= h >> np.uint64(29)
            h = mixed(h)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]

    return work


def parity(hashes: np.ndarray) -> bytes:
    """Parity bitmap of a set, of at least as many bits as the set has members.

    Two sets differ in at least as many members as their bitmaps in bits.
    """
    bits = max(64, 1 << max(0, int(len(hashes)) - 1).bit_length())
    count = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def folded(a: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(a, dtype=np.uint64)
    while len(x) * 8 > size:  # the upper half of the places falls on the lower
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    size = min(len(x), len(y))
    far = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return far * (100 + percent) <= (100 - percent) * (n + m)


def link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


#: What is known of a set besides its shingles: size, digest (null if empty), the digest's first 64 bits, bitmap.
SET = [("n_shingles", T.LongType()), ("sig", T.BinaryType()), ("node", T.LongType()), ("bitmap", T.BinaryType())]


def _columns(sets: list[np.ndarray]) -> list[list]:
    sig = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
    return [[len(h) for h in sets], sig, [node_of(x) if x else None for x in sig], [parity(h) if len(h) else None for h in sets]]


def shingled(texts: DataFrame, width: int) -> DataFrame:
    """n_shingles, sig, node, bitmap, hashes (sorted, 8 bytes each) of each text."""

    def make() -> Callable:
        of = shingler(width)

        def work(texts: list) -> list:
            sets = [of(t) for t in texts]
            return [*_columns(sets), [h.tobytes() for h in sets]]

        return work

    return map_columns(texts.select("text"), ["text"], [*SET, ("hashes", T.BinaryType())], make).drop("text")


class Once:
    """Tells a task's sets that it has not seen yet, as far as its memory goes."""

    def __init__(self, limit: int = 500_000) -> None:
        self.seen, self.limit = set(), limit

    def __call__(self, sig: bytes | None) -> bool:
        if sig is None or sig in self.seen:
            return False
        if len(self.seen) < self.limit:
            self.seen.add(sig)
        return True


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(sig, hashes) of a task's rows, equal sets once."""
    once = Once()
    for batch in batches:
        for sig, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if once(sig):
                yield sig, np.frombuffer(raw, dtype=np.uint64)


class Counts:
    """Counts tokens, COUNT_AT_ONCE at a time, and keeps the COUNTS_KEPT most frequent counts."""

    def __init__(self) -> None:
        self.t, self.c = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.parts, self.n = [], 0

    def add(self, h: np.ndarray) -> None:
        for i in range(0, len(h), COUNT_AT_ONCE):
            self.parts.append(h[i : i + COUNT_AT_ONCE])
            self.n += len(self.parts[-1])
            if self.n >= COUNT_AT_ONCE:
                self._merge()

    def _merge(self) -> None:
        t, c = self.t, self.c
        new = np.concatenate(self.parts)
        self.parts, self.n = [], 0
        new.sort()
        start = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
        seen, times = new[start], np.diff(start, append=len(new)).astype(np.int32)
        at = np.minimum(np.searchsorted(t, seen), max(0, len(t) - 1))
        old = t[at] == seen if len(t) else np.zeros(len(seen), bool)
        np.add.at(c, at[old], times[old])
        seen, times = np.concatenate([t, seen[~old]]), np.concatenate([c, times[~old]])
        if len(seen) > COUNTS_KEPT:
            keep = np.argpartition(-times, COUNTS_KEPT)[:COUNTS_KEPT]
            seen, times = seen[keep], times[keep]
        order = np.argsort(seen)
        self.t, self.c = seen[order], times[order]

    def repeated(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tokens, counts) of what was counted twice or more, ROWS_OUT at a time."""
        if self.parts:
            self._merge()
        keep = self.c >= 2
        t, c = self.t[keep].view(np.int64), self.c[keep].astype(np.int64)
        for i in range(0, len(t), ROWS_OUT):
            yield t[i : i + ROWS_OUT], c[i : i + ROWS_OUT]


class Sets:
    """The sets of ``docs`` (doc_id, text). ``rows`` is a staged table: doc_id, text_hash and SET of each document."""

    def __init__(self, docs: DataFrame, width: int) -> None:
        self.texts, self.width = docs.select(F.xxhash64("text").alias("text_hash"), "text"), width
        own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        schema = T.StructType([*own.drop("text").schema, *[T.StructField(n, t) for n, t in SET], T.StructField("token", T.LongType()), T.StructField("c", T.LongType())])
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, once, counts = shingler(width), Once(), Counts()
            for batch in batches:
                sets = [of(t) for t in batch.column(2).to_pylist()]
                cols = _columns(sets)
                for sig, h in zip(cols[1], sets, strict=True):
                    if once(sig):
                        counts.add(h)
                cols = [batch.column(0), batch.column(1), *cols, None, None]
                yield pa.RecordBatch.from_arrays([_as(x, f.type, batch.num_rows) for x, f in zip(cols, arrow, strict=True)], schema=arrow)
            for t, c in counts.repeated():
                cols = [*[None] * (len(arrow) - 2), t, c]
                yield pa.RecordBatch.from_arrays([_as(x, f.type, len(t)) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

        found = staged(own.mapInArrow(run, schema), "sets")
        self.counted = found.where("token is not null").select("token", "c")
        self.rows = found.where("token is null").drop("token", "c")

    def of_each(self, wanted: DataFrame, *cols: str) -> DataFrame:
        """sig, node and ``cols``, one row for each sig whose node is in ``wanted`` (distinct)."""
        few = wanted.limit(SMALL + 1).count() <= SMALL
        some = self.rows.where("sig is not null").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
        if "hashes" in cols:  # of one text of each
            texts = some.groupBy("sig").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct()
            some = shingled(self.texts.join(F.broadcast(texts) if few else texts, "text_hash", "left_semi"), self.width)
        return some.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("node", *cols)])


def _as(column: object, kind: pa.DataType, n: int) -> pa.Array:
    if column is None:
        return pa.nulls(n, kind)
    if isinstance(column, pa.Array):
        return column if column.type == kind else column.cast(kind)
    return pa.array(column, type=kind)


def frequent_tokens(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that sort last, and their counts; at most 2**TOP_BITS of them, whatever the corpus.

    The counts only set an order, the same for all sets, so a missed sighting loses no link.
    """
    total = sets.rows.agg(F.sum("n_shingles")).first()[0] or 0
    least = max(FREQUENT, total >> TOP_BITS)
    table = sets.counted.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= least).toArrow()
    t = table.column("token").to_numpy().view(np.uint64)
    c = table.column("c").to_numpy()
    order = np.argsort(t)
    return t[order], c[order]


def prefixes(sets: Sets, tokens: np.ndarray, counts: np.ndarray, percent: int, k: int = 2) -> DataFrame:
    """(token, node, at): the extended prefix of each set, rare tokens first.

    ``node`` is a 64-bit digest of sig. ``at`` is n * (STEPS + 1) + the token's place in the set's order, in
    steps of a STEPS-th of the prefix, or STEPS where the token is known to be too frequent for the single index.
    """
    shared = sets.texts.sparkSession.sparkContext.broadcast((tokens, counts))
    often, width = OFTEN * FEW, sets.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cnt = shared.value
        of, once = shingler(width), Once()
        out: list[tuple[np.ndarray, int, int, int]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            size = np.array([len(p) for p, *_ in out])
            node, n, late, take = (np.repeat(np.array(x), size) for x in ([o[1] for o in out], [o[2] for o in out], [o[3] for o in out], size))
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            t = np.concatenate([p for p, *_ in out]).view(np.int64)
            at = n * (STEPS + 1) + np.where(place >= late, STEPS, place * STEPS // take)
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(node), pa.array(at)], names=["token", "node", "at"])

        for h in (of(t) for batch in batches for t in batch.column(0).to_pylist()):
            n = len(h)
            if n < 2 or not once(sig := xxhash.xxh3_128_digest(h.tobytes())):  # a single shingle links with nothing but its equal
                continue
            take = prefix_of(n, percent, k)
            late = take
            if len(tok):
                at = np.minimum(np.searchsorted(tok, h), len(tok) - 1)
                common = tok[at] == h
                first = h[~common][:take]
                if len(first) < take:
                    last, c = h[common], cnt[at[common]]
                    order = np.lexsort((last, c))[: take - len(first)]
                    late = len(first) + int((c[order] <= often).sum())  # in order of c
                    first = np.concatenate([first, last[order]])
            else:
                first = h[:take]
            out.append((first, node_of(sig), n, late))
            rows += len(first)
            if rows > ROWS_OUT:
                yield flush()
                out, rows = [], 0
        if out:
            yield flush()

    return sets.texts.select("text").mapInArrow(run, "token long, node long, at long")


def prefix_of(n: int, percent: int, k: int = 2) -> int:
    return min(n, n + (-percent * n) // 100 + k)


def narrow(percent: int) -> int:
    """The largest size of a set whose prefix is of at most WIDE shingles: no smaller one has more frequent ones."""
    lo, hi = 1, 100 * (WIDE + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if prefix_of(mid, percent) <= WIDE else (lo, mid)
    return lo


def node_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def size_classes(percent: int) -> tuple[Callable[[int], int], Callable[[int], int]]:
    """Functions from a size to its class and from a class to its least size. Linked sets are in one class or in neighbours."""
    least = [2]

    def start(c: int) -> int:
        while len(least) <= c:
            least.append(least[-1] * 100 // percent + 1)
        return least[c]

    def of(n: int) -> int:
        while least[-1] <= n:
            start(len(least))
        return bisect_right(least, n) - 1

    return of, start


def part_keys(h: np.ndarray, rare: np.ndarray, family: int, largest: int, percent: int) -> list[np.ndarray]:
    """Keys of a set's parts in a family of sizes up to ``largest``; two linked sets of the family have a key in common.

    Linked sets differ in at most ``far`` shingles, so of far + spare + 1 parts at least spare + 1
    agree, and one of these is not empty unless both sets have over ``spare`` empty parts.
    """
    far = (100 - percent) * 2 * largest // (100 + percent)
    spare = far // 5 + 4
    n, out = far + spare + 1, []
    with np.errstate(over="ignore"):
        for scheme, own in ((1, rare), (2, h)):
            seed = np.uint64((family * 4 + scheme) * 0x9E3779B97F4A7C15 % 2**64)
            empty = n
            if len(own):
                part = (own >> np.uint64(11)) % np.uint64(n)
                order = np.argsort(part, kind="stable")
                part, value = part[order], mixed(own[order] ^ seed)
                start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                out.append(mixed(np.add.reduceat(value, start) + (part[start] + np.uint64(1)) * _ODD[0] + seed))
                empty -= len(start)
            if empty <= spare:
                return out
        return [*out, mixed(np.array([family * 4 + 3], np.uint64) * _ODD[1])]


def parts(sets: DataFrame, tokens: np.ndarray, percent: int) -> DataFrame:
    """(key, node, n): the sets' parts."""
    shared = sets.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, (of, start) = shared.value, size_classes(percent)
        keys, nodes, sizes, rows = [], [], [], 0

        def flush() -> pa.RecordBatch:
            each = [len(k) for k in keys]
            cols = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), each), np.repeat(np.array(sizes, np.int32), each)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "n"])

        for sig, h in _each_set(batches):
            if len(h) < 2:
                continue
            rare = h
            if len(tok):
                rare = h[tok[np.minimum(np.searchsorted(tok, h), len(tok) - 1)] != h]
            c = of(len(h))
            for family in (c - 1, c):
                got = np.concatenate(part_keys(h, rare, family, start(family + 2) - 1, percent)) if family >= 0 else ()
                if len(got):
                    keys.append(got)
                    nodes.append(node_of(sig))
                    sizes.append(len(h))
                    rows += len(got)
            if rows > ROWS_OUT:
                yield flush()
                keys, nodes, sizes, rows = [], [], [], 0
        if keys:
            yield flush()

    return sets.select("sig", "hashes").mapInArrow(run, "key long, node long, n int")


def _candidates(index: DataFrame, percent: int) -> DataFrame:
    """From (token, node, at): pairs (a, b) that share rare tokens at places and with sizes that allow a link,
    with n = minus the number of these tokens, and rows (a = token, b = node, n) of frequent tokens.

    Rows are dealt by token, those of tokens known to be common by node. A task streams
    through its sorted rows and holds no more than FEW rows of a token.
    """
    few = FEW

    def prefix_of_each(n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n + (-percent * n) // 100 + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n"]

        def made(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(n.astype(np.int32))], names=names)

        def first_two(n: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether the token of rows i and j, n[i] <= n[j], may be one of the first two that linked sets have in common."""
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            return (100 * n[i] >= percent * n[j]) & (p[i] <= n[i] - need + 1) & (p[j] <= n[j] - need + 1)

        def closed(t: np.ndarray, v: np.ndarray, n: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups: equal (token, node) rows once, then pairs of small groups."""
            order = np.lexsort((v, n, t))
            t, v, n, p = t[order], v[order], n[order], p[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            t, v, n, p = t[new], v[new], n[new], p[new]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.concatenate([start, [len(t)]]))
            each = np.repeat(size, size)
            big = each > few
            if big.any():
                yield made(t[big], v[big], n[big])
            a, b = [], []
            left = np.repeat(start + size, size)
            for step in range(1, int(min(size.max(), few))):
                i = np.flatnonzero(~big & (np.arange(len(t)) + step < left))
                if not len(i):
                    break
                i = i[first_two(n, p, i, i + step)]
                a.append(np.minimum(v[i], v[i + step]))
                b.append(np.maximum(v[i], v[i + step]))
            if a and sum(map(len, a)):
                a, b = np.concatenate(a), np.concatenate(b)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                yield made(a[start], b[start], -np.diff(np.concatenate([start, [len(a)]])))

        held = [np.empty(0, np.int64) for _ in range(4)]
        large = None  # a token that is known to have too many rows
        for batch in batches:
            t, v, at = (batch.column(i).to_numpy() for i in range(3))
            n, step = np.divmod(at, STEPS + 1)
            known = step == STEPS
            p = -(-step * prefix_of_each(n) // STEPS)  # the first place of the step
            if large is not None:
                known = known | (t == large)
            if known.any():
                yield made(t[known], v[known], n[known])
                t, v, n, p = t[~known], v[~known], n[~known], p[~known]
            held = [np.concatenate(x) for x in zip(held, (t, v, n, p), strict=True)]
            if len(held[0]) < PAIR_AT_ONCE:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last token may go on
            if cut:
                yield from closed(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            elif len(np.unique(held[1])) > few:
                large = held[0][0]
                yield made(*held[:3])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from closed(*held)

    dealt = index.repartition(F.when(F.col("at") % (STEPS + 1) == STEPS, F.col("node")).otherwise(F.col("token"))).sortWithinPartitions("token")
    return dealt.mapInArrow(run, "a long, b long, n int")


def _pairs(index: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs (a, b) within each key of ``index`` (key, node, n), where sizes allow a link. Keys have at most FEW rows."""
    lists = index.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("n", "node"))).alias("m")).where(F.size("m") > 1)
    pairs = F.expr(
        f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {FEW}), y -> 100 * x.n >= {percent} * y.n),"
        " y -> struct(least(x.node, y.node) as a, greatest(x.node, y.node) as b))))"
    )
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def verified(pairs: DataFrame, sets: Sets, percent: int, led: bool = False) -> DataFrame:
    """Links (a, b), as sig, of the distinct node ``pairs``: first by bitmap, then by the exact intersection.

    With ``led``, a node may be in very many pairs, and is joined to them in several parts.
    """
    joined = (lambda rows, own, key: joined_split(rows, own, key, SPLIT)) if led else (lambda rows, own, key: rows.join(own, key))
    per = sets.of_each(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "n_shingles", "bitmap")
    near = pairs
    for side in "ab":
        own = per.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("sig", "n_shingles", "bitmap")])
        near = joined(near, own, side)

    def pre() -> Callable:
        return lambda x, y, n, m: [[may_link(*v, percent) for v in zip(x, y, n, m, strict=True)]]

    near = map_columns(near, ["bitmap_a", "bitmap_b", "n_shingles_a", "n_shingles_b"], [("ok", T.BooleanType())], pre)
    near = staged(near.where("ok").select("a", "b", "sig_a", "sig_b"), "near")
    full = near
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    per = sets.of_each(ends, "hashes")
    for side in "ab":
        full = joined(full, per.select(F.col("sig").alias(f"sig_{side}"), F.col("hashes").alias(f"hashes_{side}")), f"sig_{side}")

    def exact() -> Callable:
        view = lambda b: np.frombuffer(b, dtype=np.uint64)
        return lambda x, y: [[link(view(p), view(q), percent) for p, q in zip(x, y, strict=True)]]

    full = map_columns(full, ["hashes_a", "hashes_b"], [("ok", T.BooleanType())], exact)
    return full.where("ok").select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b"))


def _with_bundle(members: DataFrame, bundles: DataFrame) -> DataFrame:
    """``members`` joined to ``bundles`` (one row a bundle) without gathering a bundle in one task."""
    if bundles.limit(SMALL + 1).count() <= SMALL:
        return members.join(F.broadcast(bundles), "bundle")
    salt = members.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int"))
    return salt.join(bundles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["bundle", "salt"]).drop("salt")


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between classes of one bundle that are not joined yet; members: (bundle, sig, root, n_shingles, bitmap, hashes)."""
    size = members.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = _with_bundle(members, size).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        sig, root, n = table["sig"].to_pylist(), table["root"].to_pylist(), table["n_shingles"].to_numpy()
        own, x, y = table["own"].to_numpy(), table["x"][0].as_py(), table["y"][0].as_py()
        bits = table["bitmap"].to_pylist()
        sets = [np.frombuffer(b, dtype=np.uint64) for b in table["hashes"].to_pylist()]
        up = {r: r for r in root}

        def top(r: bytes) -> bytes:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        size = min(map(len, bits))
        marks = np.stack([folded(b, size) for b in bits])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = []
        for i in left:
            far = np.bitwise_count(marks[right] ^ marks[i]).sum(1).astype(np.int64)
            may = (far * (100 + percent) <= (100 - percent) * (n[right] + n[i])) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
            if x == y:
                may &= right > i
            for j in right[may]:
                if (p := top(root[i])) != (q := top(root[j])) and link(sets[i], sets[j], percent):
                    up[p] = q
                    found.append((sig[i], sig[j]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return dealt.groupBy("bundle", "x", "y").applyInArrow(run, "a binary, b binary")


def linked(sets: Sets, percent: int) -> DataFrame:
    """(node, root): every class (sig) that links with another, and the smallest sig of its component."""
    if percent <= 50:
        raise ValueError("a similarity over 0.5 is needed")
    tokens, counts = frequent_tokens(sets)
    found = staged(_candidates(prefixes(sets, tokens, counts, percent), percent), "candidates")
    common = found.where("n > 0")
    shared = staged(found.where("n < 0").groupBy("a", "b").agg(F.sum("n").alias("n")), "shared")
    holders = common.select("b").distinct()
    holders = F.broadcast(holders) if holders.limit(SMALL + 1).count() <= SMALL else holders
    rare = shared.where("n < -1")
    for_one = shared.where("n = -1")  # the second common token, if there is one, is frequent
    for side in "ab":
        for_one = for_one.join(holders.select(F.col("b").alias(side)), side, "left_semi")
    rare = rare.unionByName(for_one).select("a", "b")
    two = F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> xxhash64(x, y))))")
    lists = common.groupBy(F.col("b").alias("node"), "n").agg(F.sort_array(F.collect_set("a")).alias("t")).where(F.size("t") > 1)
    lists = staged(lists, "frequent")
    narrow_ = F.size("t") <= WIDE
    combos = staged(lists.where(narrow_).select(F.explode(two).alias("key"), "node", "n"), "combinations")
    cold, hot = _by_heat(combos)
    pairs = rare.unionByName(_pairs(cold, "key", percent)).distinct()
    links = staged(verified(staged(pairs, "pairs"), sets, percent), "links")

    by_parts = None
    if not hot.isEmpty():
        links, members = _led(hot, links, sets, percent)
        sizes = members.groupBy("bundle").agg(F.count("*").alias("open"))
        members = staged(_with_bundle(members, sizes), "open-sizes")
        some = members.where(F.col("open") <= BLOCK * BLOCKS)
        links = staged(links.unionByName(_block_links(some.drop("node", "open"), percent)), "links")
        by_parts = members.where(F.col("open") > BLOCK * BLOCKS).select("node")
    if not lists.where(~narrow_).isEmpty():
        large = lists.where(F.col("n") * 100 >= percent * (narrow(percent) + 1)).select("node")  # and whatever may link with those
        by_parts = large if by_parts is None else by_parts.unionByName(large)
    if by_parts is None or by_parts.isEmpty():
        return components(links)
    nodes = staged(by_parts.distinct(), "by-parts")
    index = staged(parts(sets.of_each(nodes, "hashes"), tokens, percent), "parts")
    cold, hot = _by_heat(index, FEW_PARTS)
    pairs = _pairs(cold, "key", percent).distinct()
    links = staged(links.unionByName(verified(staged(pairs, "pairs"), sets, percent)).distinct(), "links")
    if not hot.isEmpty():
        links, members = _led(hot, links, sets, percent)
        links = links.unionByName(staged(_block_links(members.drop("node"), percent), "block-links"))
    return components(links)


def _by_heat(index: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, n) of keys that few have, and (key, node, first) of those that many have; first is the key's least node."""
    limit = limit or FEW
    by_key = index.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    by_key = staged(by_key, "keys")
    cold = index.join(by_key.where(F.col("held") <= limit).select("key"), "key")
    hot = by_key.where(F.col("held") > limit).select("key", "first")
    few = hot.limit(SMALL + 1).count() <= SMALL
    return cold, staged(index.select("key", "node").join(F.broadcast(hot) if few else hot, "key"), "hot")


def _led(hot: DataFrame, links: DataFrame, sets: Sets, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, open members): ``links`` with those of classes to leaders, and the members (sig, node, bundle, root,
    n_shingles, bitmap, hashes) of bundles that are not yet of one component. A class has two leaders at most: that of
    its bundle, which has the most keys, and the one that is first in most of its own keys."""
    bundles = components(hot.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("root", "bundle")
    per = hot.groupBy("node", "first").agg(F.count("*").alias("keys")).groupBy("node").agg(F.sum("keys").alias("keys"), F.max_by("first", F.struct("keys", "first")).alias("own"))
    members = staged(per.join(bundles, "node"), "members")
    leaders = members.groupBy("bundle").agg(F.max_by("node", F.struct("keys", "node")).alias("leader"))
    to_leader = _with_bundle(members.withColumnRenamed("node", "sig"), leaders).withColumnRenamed("sig", "node")
    to_leader = to_leader.select("node", F.explode(F.array("leader", "own")).alias("leader")).where("node <> leader")
    to_leader = to_leader.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = staged(links.unionByName(verified(staged(to_leader, "leaders"), sets, percent, led=True)).distinct(), "links")
    joined = staged(components(links), "joined")
    full = sets.of_each(members.select("node"), "n_shingles", "bitmap", "hashes").join(members.select("node", "bundle"), "node")
    full = staged(full.join(joined.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "bundles")
    open_ = full.groupBy("bundle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bundle")
    return links, staged(_with_bundle(full, open_), "open")


def near_classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every row of ``docs``."""
    sets = Sets(docs, width)
    classes = sets.rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"))
    comps = staged(linked(sets, percent), "components")
    named = classes.join(comps, classes["sig"] == comps["node"], "left").select("sig", "first_id", "root")
    named = staged(named, "classes")
    inside = named.where("root is not null")
    least = inside.groupBy("root").agg(F.min("first_id").alias("component_id"))
    alone = named.where("root is null").select("sig", F.col("first_id").alias("component_id"))
    found = alone.unionByName(inside.join(least, "root").select("sig", "component_id"))
    own = sets.rows.select("doc_id", "text_hash", "n_shingles", "sig")
    return own.join(found, "sig", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that with the smallest doc_id. Columns stay as they are.

    Rows that agree in doc_id and text count as one row: the least by its columns in order (nested ones by their JSON).
    """
    found = staged(near_classes(docs, width, percent).select("doc_id", "text_hash", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "stays")
    own = docs.withColumn("text hash", F.xxhash64("text"))
    gone = found.where("not stays").select(F.col("doc_id").alias("gone id"), F.col("text_hash").alias("gone hash")).distinct()
    gone = F.broadcast(gone) if gone.limit(SMALL + 1).count() <= SMALL else gone
    rest = own.join(gone, own["doc_id"].eqNullSafe(F.col("gone id")) & (own["text hash"] == F.col("gone hash")), "left_anti")
    again = found.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("gone id"), F.col("text_hash").alias("gone hash"))
    again = staged(again, "repeated")
    if not again.isEmpty():
        again = F.broadcast(again) if again.limit(SMALL + 1).count() <= SMALL else again
        same = own["doc_id"].eqNullSafe(F.col("gone id")) & own["text hash"].eqNullSafe(F.col("gone hash"))
        plain = [F.to_json(f"`{f.name}`") if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f"`{f.name}`") for f in docs.schema]
        one = rest.join(again, same, "left_semi").groupBy("doc_id", "text hash").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*plain)).alias("row"))
        rest = rest.join(again, same, "left_anti").drop("text hash").unionByName(one.select("row.*"))
        return rest
    return rest.drop("text hash")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(docs, 3, 90).select("doc_id", "n_shingles", "component_id")
