"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations that are learned on a bounded sample (each
starts at random and is turned so that vectors lie near corners of the cube). A code is split
into substrings of about as many bits as the number of vectors has, and each substring is
indexed: the index is one relation, keyed by the substring's number and value and dealt by its leading bits. Codes within
``count * (probe + 1) - 1`` bits of each other agree in some of ``count`` substrings to within
``probe`` bits, so probing all values that near, in each substring, retrieves every code within
that radius, and others by chance. Of what is retrieved, codes farther than ``far`` in their
first ``BITS`` bits are dropped where they are met, and the rest is reranked by the exact cosine.

``fitted`` takes number, probe and ``far`` from ``ASKED`` vectors of the sample and their true
neighbours among all rows: the cheapest that retrieve a share of ``RECALL`` of these, and drop at
most ``MISS`` of them. Queries that find too few are asked again with wider probes, and what is
left after ``ROUNDS`` is compared with all rows, in blocks.

Equal vectors are one class with the few members that can be in any result, so a vector that a
third of all rows hold is indexed, probed and compared once.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in
length from most, are neither queries nor candidates; rows with a null id take no part; equal
rows are candidates of each other; ties in score go to the smaller id; fewer candidates than k
give fewer rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import joined_split, map_columns, prepared, sampled, staged

#: Bits by which retrieved codes are compared; least and most bits of a substring; most substrings and most bits probed.
BITS, LEAST_SUB, MOST_SUB, MOST_COUNT, MOST_PROBE = 512, 6, 24, 48, 4
#: Rows of the sample, of them those asked; shares of neighbours to retrieve and to drop by distance.
SAMPLE, ASKED, RECALL, MISS = 4_096, 512, 0.985, 0.005
#: Rows of a key that one task joins, and codes of a deal of buckets.
SPLIT, BLOCK_ROWS = 20_000, 16_384
#: Turns of a learned rotation, rounds of wider probes, queries compared with all rows at a time.
TURNS, ROUNDS, BLOCK_QUERIES = 30, 2, 1_024


def rotations(sample: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Learned rotations side by side: ``bits`` columns, whose products' signs are a code."""
    r, d = np.random.default_rng(seed), sample.shape[1]
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        for _ in range(TURNS if len(sample) >= d else 0):
            corners = np.where(sample @ q >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(sample.T @ corners)
            q = u @ v
        parts.append(q)
    return np.concatenate(parts, 1)[:, :bits]


def signs(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return (vectors @ rotation) >= 0


def values(bits: np.ndarray, width: int, count: int) -> np.ndarray:
    """The first ``count`` substrings of codes as numbers: rows x substrings."""
    return bits[:, : width * count].reshape(len(bits), count, width) @ (1 << np.arange(width, dtype=np.int64))


def masks(width: int, probe: int) -> list[int]:
    """What turns a substring into each one within ``probe`` bits."""
    return [sum(1 << i for i in c) for n in range(min(probe, width) + 1) for c in combinations(range(width), n)]


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with q, or with q's row at its place; equal rows give equal values to the last bit."""
    return (rows * q).sum(-1) / (np.sqrt((rows * rows).sum(-1)) * np.sqrt((q * q).sum(-1)))


@dataclass(frozen=True)
class Plan:
    """Bits of a substring, substrings, bits probed around each, distance of the first BITS bits beyond which codes are dropped."""

    width: int
    count: int
    probe: int
    far: int

    @property
    def radius(self) -> int:
        """Every code within it is retrieved."""
        return self.count * (self.probe + 1) - 1

    def visited(self) -> float:
        """Share of unrelated codes that a query meets."""
        return 1 - (1 - len(masks(self.width, self.probe)) / 2**self.width) ** self.count

    def wider(self) -> Plan:
        return replace(self, probe=self.probe + 1, far=min(BITS, self.far + BITS // 16))


def fitted(asked: np.ndarray, near: np.ndarray, rotation: np.ndarray, rows: int, queries: int, width: int) -> Plan:
    """The plan that costs least for so many rows and queries; ``near`` are true neighbours of the vectors ``asked`` at their places."""
    if not len(asked):
        return Plan(width, 1, 0, BITS)
    differ = signs(asked, rotation) != signs(near, rotation)
    far = int(np.quantile(differ[:, :BITS].sum(1), 1 - MISS, method="higher"))
    apart = differ[:, : width * MOST_COUNT].reshape(len(asked), MOST_COUNT, width).sum(2)
    plans = []
    for probe in range(min(MOST_PROBE, width) + 1):
        found = np.logical_or.accumulate(apart <= probe, 1).mean(0)
        enough = np.flatnonzero(found >= RECALL)
        if len(enough):
            plan = Plan(width, int(enough[0]) + 1, probe, far)
            cost = plan.count * (4 * rows + queries * len(masks(width, probe))) + queries * rows * plan.visited()
            plans.append((cost, plan))
    return min(plans, key=lambda x: x[0])[1] if plans else Plan(width, MOST_COUNT, min(MOST_PROBE, width), far)


def usable(table: DataFrame, id_: str, vector: str) -> DataFrame:
    """(uid, id, v, key) of the rows that take part; key is one for equal vectors."""
    v = F.transform(F.col(vector), lambda x: x + F.lit(0).cast("byte"))  # -0.0 becomes 0.0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    key = F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")))
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).select(F.monotonically_increasing_id().alias("uid"), "id", "v", key.alias("key"))


def retrieved(coded: DataFrame, asked: DataFrame, plan: Plan) -> DataFrame:
    """Distinct (query, cid) whose codes meet in a bucket and are not too far apart.

    Buckets are dealt by the substring's number and the leading bits of its value, so many that a
    deal has about BLOCK_ROWS codes; a query goes to each deal that has a bucket it visits.
    Larger deals are split, and a task probes one block of codes for one block of queries.
    """
    lead = min(plan.width, max(0, math.ceil(math.log2(max(1, coded.count()) / BLOCK_ROWS))))
    deal = lambda value: (F.shiftleft(F.col("s").cast("long"), lead) + F.shiftright(value, plan.width - lead)).alias("deal")
    subs = F.posexplode(F.slice("subs", 1, plan.count)).alias("s", "value")
    index = coded.select("cid", "code", subs).select("cid", "code", "value", deal(F.col("value")))
    flips = F.explode(F.array(*[F.lit(m << plan.width - lead).cast("long") for m in masks(lead, plan.probe)])).alias("flip")
    visits = asked.select("cid", "code", subs).select("*", flips)
    visits = visits.select(*[F.col(c).alias(f"q_{c}") for c in ("cid", "code", "value")], deal(F.col("value").bitwiseXOR(F.col("flip"))).alias("q_deal"))
    # Names of their own: where both sides of a cogroup share attributes, column pruning empties one.
    large = lambda df, deal, most, out: df.groupBy(F.col(deal).alias("big")).agg(F.ceil(F.count("*") / (2 * most)).cast("int").alias(out)).where(F.col(out) > 1)
    grid = large(index, "deal", BLOCK_ROWS, "rows").join(large(visits, "q_deal", BLOCK_ROWS, "queries"), "big", "full")
    grid = staged(grid.select("big", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("queries", F.lit(1)).alias("queries")), "deals")
    if grid.isEmpty():
        left, right = index.withColumns({"x": F.lit(0), "y": F.lit(0)}), visits.withColumns({"q_x": F.lit(0), "q_y": F.lit(0)})
    else:
        split = lambda df, deal: df.join(F.broadcast(grid), F.col(deal) == F.col("big"), "left").fillna(1, ["rows", "queries"]).drop("big")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = split(index, "deal").withColumn("x", F.pmod(F.xxhash64("cid"), F.col("rows")).cast("int")).withColumn("y", every("queries")).drop("rows", "queries")
        right = split(visits, "q_deal").withColumn("q_y", F.pmod(F.xxhash64("q_cid"), F.col("queries")).cast("int")).withColumn("q_x", every("rows")).drop("rows", "queries")

    def columns(t: pa.Table, side: str = "") -> tuple[np.ndarray, ...]:
        code = np.frombuffer(b"".join(t[f"{side}code"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
        return t[f"{side}cid"].to_numpy(), t[f"{side}value"].to_numpy(), code

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        query, cid = [], []
        if have.num_rows and ask.num_rows:
            ids, value, code = columns(have)
            order = np.argsort(value, kind="stable")
            ids, code = ids[order], code[order]
            buckets, start = np.unique(value[order], return_index=True)
            size = np.diff(start, append=len(ids))
            for q, v, c in zip(*columns(ask, "q_"), strict=True):
                hit = np.flatnonzero(np.bitwise_count(buckets ^ v) <= plan.probe)
                n = size[hit]
                rows = np.repeat(start[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hit) else hit
                rows = rows[np.bitwise_count(code[rows] ^ c).sum(1) <= plan.far]
                query.append(np.full(len(rows), q))
                cid.append(ids[rows])
        query, cid = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (query, cid))
        return pa.table({"query": query, "cid": cid})

    return left.groupBy("deal", "x", "y").cogroup(right.groupBy("q_deal", "q_x", "q_y")).applyInArrow(run, "query long, cid long").distinct()


_FOUND = "query long, score double, cid long, id long, uid long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query, best): each query's k + 1 best members of classes, itself among them perhaps; best is an array of (rank, score, cid, id, uid)."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "uid"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "cid", "id", "uid"))).alias("best"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def reranked(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``_best`` of the pairs by the exact cosine."""
    own = classes.select(F.col("cid").alias("query"), F.col("v").alias("q"))
    both = joined_split(joined_split(pairs, classes.select("cid", "v", "members"), "cid", SPLIT), own, "query", SPLIT).select("query", "q", "v", "members", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = cosines(_matrix(b.column(2)), _matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), b.column(3), b.column(4)], names=["query", "score", "members", "cid"])

    scored = both.mapInArrow(run, "query long, score double, members array<struct<id:long,uid:long>>, cid long")
    return _best(scored.select("query", "score", "cid", F.explode("members").alias("m")).select("query", "score", "cid", "m.id", "m.uid"), k)


def compared(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``_best`` of the queries ``asked`` (query) among all classes, block by block: the exact way, for queries that are left."""
    spark = classes.sparkSession
    rows = staged(classes.join(asked.select(F.col("query").alias("cid")), "cid", "left_semi").select("cid", "v").withColumn("n", F.monotonically_increasing_id()), "left")
    blocks = max(1, -(-rows.count() // BLOCK_QUERIES))
    out = None
    for i in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == i).select("cid", "v").toArrow()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((block["cid"].to_numpy(), _matrix(block["v"])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                x, members, cids = _matrix(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()
                for i, one in enumerate(q):
                    score = cosines(x, one)
                    order = np.lexsort(([m[0]["id"] for m in members], -score))[: k + 1]
                    found = [(float(score[j]), cids[j], m["id"], m["uid"]) for j in order for m in members[j]]
                    yield pa.RecordBatch.from_pydict({"query": [int(ids[i])] * len(found), **{name: [f[c] for f in found] for c, name in enumerate(("score", "cid", "id", "uid"))}})

        got = staged(_best(classes.select("v", "members", "cid").mapInArrow(run, _FOUND), k), "compared")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "query long, best array<struct<rank:int,score:double,cid:long,id:long,uid:long>>")


def grouped(rows: DataFrame, k: int) -> DataFrame:
    """(cid, key, v, members): distinct vectors, each with its k + 1 least members, all that can be among any k nearest."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("id", "uid"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    one = few.groupBy("key").agg(F.min_by("v", "place").alias("v"), F.sort_array(F.collect_list(F.struct("id", "uid"))).alias("members"))
    return staged(one.select(F.monotonically_increasing_id().alias("cid"), "key", "v", "members"), "vectors")


def planned(classes: DataFrame, queries: int, k: int) -> tuple[np.ndarray, Plan]:
    """The rotation, learned on a bounded sample, and the plan, from ASKED of its vectors and their true neighbours among all rows."""
    some = sampled(classes.select("key", "cid", "v"), "key", SAMPLE).orderBy("key").select("cid", "v").toArrow()
    sample = _matrix(some["v"]) if some.num_rows else np.ones((1, 1))
    sample = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
    n = classes.count()
    width = min(MOST_SUB, max(LEAST_SUB, round(math.log2(max(2, n)))))
    rotation = rotations(sample, max(BITS, width * MOST_COUNT))
    place = {c: i for i, c in enumerate(some["cid"].to_pylist()[:ASKED])}
    asked = classes.sparkSession.createDataFrame([(c,) for c in place], "query long")
    others = compared(classes, asked, k).select("query", F.explode("best").alias("m")).select("query", "m.cid").where("cid <> query").distinct()
    pairs = others.join(classes.select("cid", "v"), "cid").orderBy("query", "cid").select("query", "v").toArrow()
    near = _matrix(pairs["v"]) if pairs.num_rows else np.ones((0, sample.shape[1]))
    return rotation, fitted(sample[[place[q] for q in pairs["query"].to_pylist()]], near, rotation, n, queries, width)


def with_codes(classes: DataFrame, rotation: np.ndarray, plan: Plan) -> DataFrame:
    """(cid, code, subs): the first BITS bits, and the substrings as numbers."""
    shared = classes.sparkSession.sparkContext.broadcast(rotation[:, : max(BITS, plan.width * plan.count)])

    def make() -> Callable:
        def work(vectors: list) -> list:
            x = np.array(vectors, dtype=np.float64)
            bits = signs(x / np.sqrt((x * x).sum(1, keepdims=True)), shared.value)
            return [[row.tobytes() for row in np.packbits(bits[:, :BITS], axis=1)], values(bits, plan.width, plan.count).tolist()]

        return work

    return staged(map_columns(classes.select("cid", "v"), ["v"], [("code", T.BinaryType()), ("subs", T.ArrayType(T.LongType()))], make).drop("v"), "codes")


def nearest(table: DataFrame, asks: Column, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``asks`` (a condition on column id) holds."""
    rows = staged(usable(table, id_, vector), "rows")
    classes = grouped(rows, k)
    asked = joined_split(rows.where(asks).select("uid", "id", "key"), classes.select("key", "cid"), "key", SPLIT)
    asked = staged(asked.select("uid", F.col("id").alias("query_id"), F.col("cid").alias("query")), "queries")
    left = staged(asked.select("query").distinct(), "asked")
    rotation, plan = planned(classes, left.count(), k)
    coded = with_codes(classes, rotation, plan)
    done, total = None, rows.count()
    for _ in range(1 + ROUNDS):
        few = coded.join(left.select(F.col("query").alias("cid")), "cid", "left_semi")
        best = staged(reranked(staged(retrieved(coded, few, plan), "pairs"), classes, k), "nearest")
        fine = best.where(F.size("best") >= min(k + 1, total))
        done = fine if done is None else done.unionByName(fine)
        left = staged(left.join(fine.select("query"), "query", "left_anti"), "left")
        if left.isEmpty():
            break
        plan = plan.wider()
    else:
        done = done.unionByName(compared(classes, left, k))
    own = joined_split(asked, done, "query", SPLIT)
    others = F.slice(F.filter("best", lambda m: m.uid != F.col("uid")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("place", "m")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("m.id").alias("vec_id"), F.col("m.score").alias("score")
    )


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
