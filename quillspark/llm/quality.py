"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Learned filters
run over each chunk, each filter's greatest response in a chunk is kept, and mean, maximum
and minimum of these over the chunks of a document make one probability by a small dense
head. The minimum shows chunks in which few filters find anything: one word again and again.

The network is fitted on the driver from a bounded sample of labelled rows (``PER_CLASS`` rows
a class and ``FIT_BYTES`` of text in all, whole texts, in hash order of doc_id); scoring reads
every byte. Scores do not depend on what is scored beside: vectors and filters are rounded to
integers so small that every sum of their products is exact, in whatever order it is taken.

Defined results: a null or empty text is one chunk of padding and gets a score like any other;
a text of any length is scored whole; equal texts get equal scores; without labels of both
classes every score is the share of label 1 (1.0 without any label); rows with a null label or
null doc_id teach nothing; of several labels of one doc_id the smallest counts, and of several
texts of one doc_id that of the least hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import zip_longest

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import map_columns, prepared, staged

#: The sample of the fit: labelled rows of each class, and bytes of their texts in all.
PER_CLASS, FIT_BYTES = 1200, 32 << 20
#: Largest integers of a symbol's vector and of a filter: WIDTH * DIM products of them add up to less than 2**24.
TOP_EMB, TOP_KER = 255, 1023
#: Bytes of a chunk and from one chunk's start to the next.
CHUNK, STEP = 512, 448
#: Size of a byte's vector, bytes under a filter, from one place of a filter to the next, filters, hidden units.
DIM, WIDTH, HOP, FILTERS, HIDDEN = 6, 8, 2, 24, 16
EPOCHS, BATCH, RATE = 24, 32, 5e-3
PAD = 256
THRESHOLD = 0.3


def chunks(data: bytes) -> np.ndarray:
    """All of ``data`` as rows of CHUNK symbols, each STEP bytes on, the last one padded."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    flat = np.full((n - 1) * STEP + CHUNK, PAD, dtype=np.int16)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (STEP * 2, 2))


@dataclass
class Network:
    emb: np.ndarray
    ker: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    shift: float = 0.0
    scale: float = 1.0

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        return Network(
            f(PAD + 1, DIM, k=0.5), f(WIDTH * DIM, FILTERS, k=(2 / (WIDTH * DIM)) ** 0.5), np.zeros(FILTERS, np.float32),
            f(3 * FILTERS, HIDDEN, k=(2 / (3 * FILTERS)) ** 0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, k=HIDDEN**-0.5), np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.emb, self.ker, self.bias, self.w1, self.b1, self.w2, self.b2]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Places under the filters: chunks x places x (WIDTH * DIM)."""
        e = np.ascontiguousarray(self.emb[x])
        places = (CHUNK - WIDTH) // HOP + 1
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), places, WIDTH * DIM), (s[0], s[1] * HOP, s[2]))
        return np.ascontiguousarray(view)

    def rounded(self) -> Network:
        """The network on integers: what its filters see and weigh is rounded, and their scale goes into the head."""
        e, k = TOP_EMB / np.abs(self.emb).max(), TOP_KER / np.abs(self.ker).max()
        net = replace(self, emb=np.round(self.emb * e).astype(np.float32), ker=np.round(self.ker * k).astype(np.float32))
        net.scale = float(e * k)
        net.bias = np.round(self.bias * net.scale).astype(np.int64)
        net.w1, net.b1, net.w2, net.b2 = (w.astype(np.float64) for w in (self.w1, self.b1, self.w2, self.b2))
        return net

    def pooled(self, x: np.ndarray, block: int = 48) -> np.ndarray:
        """Greatest response of each filter in each chunk, an integer."""
        out = np.empty((len(x), FILTERS), np.float32)
        for i in range(0, len(x), block):
            w = self.windows(x[i : i + block])
            h = w.reshape(-1, WIDTH * DIM) @ self.ker
            out[i : i + block] = h.reshape(w.shape[0], w.shape[1], FILTERS).max(1)
        return np.maximum(out.astype(np.int64) + self.bias, 0)

    def head(self, v: np.ndarray) -> np.ndarray:
        """One number a row; products are added row by row, so no other row counts."""
        hidden = np.maximum((v[:, :, None] * self.w1[None]).sum(1) + self.b1, 0)
        return (hidden * self.w2).sum(1) + self.b2[0]

    def scores(self, texts: list) -> list[float]:
        """Scores of a rounded network."""
        parts, sizes = [], []
        for t in texts:
            c = chunks((t or "").encode("utf-8", "replace"))
            parts.append(c)
            sizes.append(len(c))
        out, at = [], 0
        while at < len(parts):  # so many documents at once as make a bounded number of chunks, one at least
            to, n = at + 1, sizes[at]
            while to < len(parts) and n + sizes[to] <= 2048:
                n += sizes[to]
                to += 1
            p = np.concatenate([self.pooled(c) for c in parts[at:to]]) if n > 4096 else self.pooled(np.concatenate(parts[at:to]))
            starts = np.cumsum([0, *sizes[at : to - 1]])
            mean = np.add.reduceat(p, starts) / np.array(sizes[at:to], np.float64)[:, None]
            v = np.concatenate([mean, np.maximum.reduceat(p, starts), np.minimum.reduceat(p, starts)], 1) / self.scale
            out += (1 / (1 + np.exp(-np.clip(self.head(v) + self.shift, -30, 30)))).tolist()
            at = to
        return out


def fitted(samples: list[tuple[np.ndarray, int]], share: float, seed: int = 7) -> Network | float:
    """The network for (chunks, label) pairs; ``share`` of label 1 among all labelled rows sets the score's level."""
    y_all = np.array([y for _, y in samples], np.float32)
    if len(set(y_all.tolist())) < 2:
        return share
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    ws = net.weights()
    m1, m2, step = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
    half = {k: 0.5 / max(1e-9, float((y_all == k).mean())) for k in (0.0, 1.0)}
    total = EPOCHS * -(-len(samples) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(samples))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            sizes = np.array([len(samples[j][0]) for j in pick])
            x, y = np.concatenate([samples[j][0] for j in pick]), y_all[pick]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            w = net.windows(x)
            h = w @ net.ker
            arg = h.argmax(1)
            top = np.take_along_axis(h, arg[:, None, :], 1)[:, 0] + net.bias
            p = np.maximum(top, 0)
            mean = np.add.reduceat(p, starts) / sizes[:, None].astype(np.float32)
            most, least = np.maximum.reduceat(p, starts), np.minimum.reduceat(p, starts)
            v = np.concatenate([mean, most, least], 1)
            a = v @ net.w1 + net.b1
            g = np.maximum(a, 0)
            z = g @ net.w2 + net.b2[0]
            d = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, half[1.0], half[0.0]).astype(np.float32) / len(pick)
            dg = np.outer(d, net.w2) * (a > 0)
            dv = dg @ net.w1.T
            doc = np.repeat(np.arange(len(pick)), sizes)
            dp = (dv[:, :FILTERS] / sizes[:, None])[doc]
            for k, best in ((1, most), (2, least)):  # to all chunks that tie, in equal parts
                at = (p == best[doc]).astype(np.float32)
                dp += dv[:, k * FILTERS : (k + 1) * FILTERS][doc] * at / np.add.reduceat(at, starts)[doc]
            dp = (dp * (top > 0)).astype(np.float32)
            under = w[np.arange(len(x))[:, None], arg]  # chunks x filters x (WIDTH * DIM)
            dker = np.einsum("cf,cfk->kf", dp, under, optimize=True)
            dunder = dp[:, :, None] * net.ker.T[None]
            sym = x[np.arange(len(x))[:, None, None], arg[:, :, None] * HOP + np.arange(WIDTH)]
            demb = np.zeros_like(net.emb)
            flat, val = sym.reshape(-1), dunder.reshape(-1, DIM)
            for k in range(DIM):
                demb[:, k] = np.bincount(flat, val[:, k], PAD + 1)
            grads = [demb, dker, dp.sum(0), v.T @ dg, dg.sum(0), g.T @ d, d.sum(keepdims=True)]
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / total)
            for j, grad in enumerate(grads):
                m1[j] = 0.9 * m1[j] + 0.1 * grad
                m2[j] = 0.999 * m2[j] + 0.001 * grad**2
                ws[j] -= (rate * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    level = min(max(share, 1e-3), 1 - 1e-3)
    net.shift = float(np.log(level / (1 - level)))
    return net.rounded()


def taught(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Network | float:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``per_class`` of each class and FIT_BYTES of text."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
    )
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not count:
        return 1.0
    share = count.get(1, 0) / sum(count.values())
    some = None
    for y in sorted(count):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = own if some is None else some.unionByName(own)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = staged(texts.withColumn("size", F.octet_length("text")), "labelled")
    picked, size, left = [], 0, {y: [] for y in count}
    for r in texts.select("doc_id", "y", "size", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        left[r["y"]].append((r["doc_id"], r["size"]))
    for rows in zip_longest(*left.values()):  # classes in turn, so that the bound falls on both alike
        for r in rows:
            if r and size + r[1] <= FIT_BYTES:
                size += r[1]
                picked.append(r[0])
    got = texts.where(F.col("doc_id").isin(picked)).select("doc_id", "y", "text").collect() if picked else []
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in got)
    return fitted([(chunks(t.encode("utf-8", "replace")), y) for _, y, t in rows], share)


def score(docs: DataFrame, model: Network | float, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) to every row."""

    def make() -> Callable:
        def work(texts: list) -> list:
            return [[model] * len(texts) if isinstance(model, float) else model.scores(texts)]

        return work

    return map_columns(docs, [text], [("score", T.DoubleType())], make)


def kept(docs: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns.

    A column named ``score`` of the input comes back as it was.
    """
    name = "quality score"
    scored = map_columns(
        docs, ["text"], [(name, T.DoubleType())],
        lambda: lambda texts: [[model] * len(texts) if isinstance(model, float) else model.scores(texts)],
    )
    return scored.where(F.col(f"`{name}`") >= threshold).drop(name)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = prepared(spark).read.parquet
    docs = read(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = taught(docs, read(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
