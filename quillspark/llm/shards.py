"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents are linked by the groups they share. Every linked document starts in a shard by
hash. In each round a join brings it its groups' counts per shard, and it asks for the shard
with the most of its neighbours that still has room; each shard grants what its quota allows,
group by group in hash order. Rounds end when nothing moves or after ``ROUNDS``. Unlinked
documents, which cut no link wherever they are, then fill the shards up to their quotas.

The law is ``rows``: counts of any two shards differ by one at most. No edge is ever made
between two members of a group, so a group of any size costs as much as its rows. Only numbers
per shard reach the driver.

Defined results: a null text counts as the empty text (size 1) and is linked with empty texts;
equal rows, and rows with equal or null doc_id, are rows of their own; fewer rows than shards
leave shards empty; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import prepared, staged

SHARDS, ROUNDS, LAW = 16, 16, "rows"
#: Parts of the order in which requests of one shard are granted: by group, then by member.
GROUP_PARTS, MEMBER_PARTS = 256, 1024
#: Rows of one window when ranks are taken, on average, and bytes up to which a side is broadcast.
RANK_ROWS, SMALL_BYTES = 20_000, 16 << 20


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def small(df: DataFrame) -> DataFrame:
    """``df``, of numbers alone, to be broadcast if its rows are few enough, else as it is."""
    rows = SMALL_BYTES // (8 * (len(df.columns) + 2))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, rows: int, id_: str, out: str, *by: str) -> DataFrame:
    """Append a gapless rank from 0 within each ``by``, in two levels: offsets of hash parts, then places in a part.

    ``id_`` is unique; no window holds more rows than one part of one ``by``. Parts are cut by a hash of
    their own for each ``out``: ``by`` may stem from ranks taken before.
    """
    parts = max(16, -(-rows // RANK_ROWS))
    dealt = df.withColumn("rank part", F.pmod(F.xxhash64(F.lit(out), id_), F.lit(parts)))
    keys = [*by, "rank part"]
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("rank part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank offset"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(id_)) - 1
    return dealt.withColumn("rank place", place).join(small(offsets), keys).withColumn(out, F.col("rank offset") + F.col("rank place")).drop("rank part", "rank place", "rank offset")


def propagated(links: DataFrame, limits: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of every node of ``links`` (node, group); a shard holds at most its limit.

    A node may be in several groups; the counts of all of them add up. Null nodes and groups
    take no part. The limits must have room for all nodes.
    """
    shards = len(limits)
    links = staged(links.where("node is not null and group is not null").distinct(), "links")
    nodes = links.groupBy("node").agg(F.min("group").alias("lead"))
    total = nodes.count()
    if total > sum(limits):
        raise ValueError("the limits have no room for all nodes")
    ranks = ranked(nodes, total, "node", "rank")
    labels = staged(ranks.select("node", "lead", F.expr(_by_rank("rank", _filled(limits, total))).alias("shard")), "labels")
    closed: set[int] = set()  # shards with less room than the first part of what asks for it
    for _ in range(rounds):
        held = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        free = [0 if s in closed else limits[s] - held.get(s, 0) for s in range(shards)]
        near = links.join(labels.select("node", "shard"), "node")
        counts = near.groupBy("group").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"s{s}") for s in range(shards)])
        per_node = links.join(small(counts), "group").groupBy("node").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(shards)])
        room = F.array(*[F.lit(x) for x in free])
        pull = F.array(*[F.col(f"s{s}") for s in range(shards)])
        turn = lambda s: F.pmod(F.lit(s) + F.xxhash64("lead"), F.lit(shards))  # noqa: E731  so that ties of a group fall on one shard, those of all groups on all
        best = F.array_max(
            F.array(*[F.when((F.element_at(room, s + 1) > 0) | (F.col("shard") == s), F.struct(F.element_at(pull, s + 1).alias("n"), turn(s).alias("t"), F.lit(s).alias("s"))) for s in range(shards)])
        )
        asked = labels.join(per_node, "node").withColumn("best", best)
        own = F.element_at(pull, F.col("shard") + 1)
        wants = (F.col("best.s") != F.col("shard")) & ((F.col("best.n") > own) | ((F.col("best.n") == own) & (F.col("best.t") > F.pmod(F.col("shard") + F.xxhash64("lead"), F.lit(shards)))))
        order = F.pmod(F.xxhash64("lead"), F.lit(GROUP_PARTS)) * MEMBER_PARTS + F.pmod(F.xxhash64("node"), F.lit(MEMBER_PARTS))
        asked = staged(asked.select("node", "lead", "shard", F.when(wants, F.col("best.s")).alias("to"), order.alias("turn")), "requests")
        sums = asked.where("to is not null").groupBy("to", "turn").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("to").orderBy("turn"))
        limit = F.element_at(room, F.col("to") + 1)
        answers = sums.withColumn("sum", upto).groupBy("to").agg(F.max(F.when(F.col("sum") <= limit, F.col("turn"))).alias("last")).collect()
        if not answers:
            break
        granted = {r["to"]: r["last"] for r in answers if r["last"] is not None}
        closed |= {r["to"] for r in answers} - set(granted)
        last = F.element_at(F.array(*[F.lit(granted.get(s, -1)) for s in range(shards)]), F.col("to") + 1)
        labels = staged(asked.select("node", "lead", F.when(F.col("to").isNotNull() & (F.col("turn") <= last), F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
    return labels.select("node", "shard")


def _filled(limits: list[int], total: int) -> list[int]:
    """``total`` dealt out over shards as evenly as their limits allow."""
    out, left = [0] * len(limits), total
    while left:
        open_ = [s for s, x in enumerate(limits) if out[s] < x]
        each = max(1, left // len(open_))
        for s in open_:
            take = min(each, limits[s] - out[s], left)
            out[s] += take
            left -= take
    return out


def _by_rank(rank: str, sizes: list[int]) -> str:
    """SQL: the shard of a rank when shards take ``sizes`` ranks in turn."""
    upto, whens = 0, []
    for s, x in enumerate(sizes):
        upto += x
        whens.append(f"when {rank} < {upto} then {s}")
    return f"cast(case {' '.join(whens)} end as int)"


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; equal texts are linked.

    Texts of one hash of 64 bits count as equal: a collision would link two groups, and change no size, slot or law.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = text.cast("binary")
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("group"))
    own = staged(own.withColumn("node", F.monotonically_increasing_id()), "rows")
    n = own.count()
    limits = quotas(n, shards)
    groups = own.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    linked = staged(propagated(own.join(small(groups), "group", "left_semi").select("node", "group"), limits, rounds), "linked")
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    rest = own.select("node").join(linked, "node", "left_anti")
    rest = ranked(rest, n, "node", "rank").select("node", F.expr(_by_rank("rank", [x - held.get(s, 0) for s, x in enumerate(limits)])).alias("shard"))
    placed = own.join(linked.unionByName(rest), "node")
    return ranked(placed, n, "node", "slot", "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(prepared(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
