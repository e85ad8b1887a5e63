"""What several operators of this package share: the staging area, Arrow helpers, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.session import ready, shared_root

#: Rows of one Arrow batch. Documents can be long, and a Python worker holds two batches or so.
BATCH_ROWS = 512
#: Bytes of a row group of a staged table; a writer holds one in memory.
ROW_GROUP = 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches and with workers that can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ready(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session of one machine that names none (tests, notebooks) gets a folder of its own.
    """
    return shared_root(spark).rstrip("/")


_own: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the application's folder, which is deleted when the application ends.

    It tells its filesystem: a name without one is taken as Spark takes it, by the default filesystem.
    """
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark-{sc.applicationId}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    whole = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    if whole not in _own:
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _own.add(whole)
    return f"{whole}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(uri: str):
    """(filesystem, path) of a path or URI, for Python workers. ``new_folder`` makes only names that tell their filesystem."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri[5:] if uri.startswith('file:') else uri}"
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    """A stream into a new file of the shared folder."""
    where, path = _place(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A file of the shared folder, for reading at any place."""
    where, path = _place(uri)
    return where.open_input_file(path)


def map_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Append ``outputs`` computed from Python lists of ``inputs``, batch by batch.

    ``make`` runs once a task and returns a function from lists to lists of columns.
    Columns of ``df`` that clash with an output are replaced.
    """
    for c in inputs:
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n, _ in outputs}]
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *[T.StructField(n, t, True) for n, t in outputs]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            got = work(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            cols += [pa.array(v, type=arrow.field(n).type) for v, (n, _) in zip(got, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """One row for each of the ``n`` keys that come first by hash: a sample whose size is bounded whatever ``df`` is.

    Only keys are ranked, so tasks send no wide rows to the driver.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi").dropDuplicates([key])


#: Rows of a key that one task joins, and keys of more rows up to which these are told apart.
SPLIT, MANY = 20_000, 10_000


def joined_split(rows: DataFrame, own: DataFrame, key: str, split: int = SPLIT) -> DataFrame:
    """``rows`` joined to ``own`` (one row a key). Keys of over ``split`` rows are dealt over tasks, with a copy of their row of ``own`` in each.

    If more than MANY keys are so frequent, no single one of them keeps a task busy alone, and nothing is split.
    """
    many = rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > split).select(key, F.ceil(F.col("rows") / split).cast("int").alias("copies"))
    found = [(r[key], r["copies"]) for r in many.limit(MANY + 1).collect() if r[key] is not None]
    if not found or len(found) > MANY:
        return rows.join(own, key)
    copies = F.broadcast(rows.sparkSession.createDataFrame(found, T.StructType([rows.schema[key], T.StructField("copies", T.IntegerType())])))
    copied = lambda df: df.join(copies, key, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    dealt = copied(rows.withColumn("copy row", F.monotonically_increasing_id())).withColumn("copy", F.pmod(F.xxhash64("copy row"), F.col("copies")).cast("int"))
    spread = copied(own).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return dealt.drop("copies", "copy row").join(spread.drop("copies"), [key, "copy"]).drop("copy")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of ``links``: one row (node, root) per node that has a link, root the smallest node.

    Alternating large and small stars: each round hangs every node under the smallest
    node around it; the work of a round is linear in the links, a chain of n nodes ends
    after about log(n) rounds, and no component is ever gathered in one place.
    Null ends are dropped; a link of a node with itself is no link.
    """
    edges = (
        links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = staged(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(
            edges.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
        )
        small = both.groupBy("n").agg(F.min("m").alias("s"))
        small = small.select("n", F.least("n", "s").alias("s"))
        large = both.where("m > n").join(small, "n").select(F.col("m").alias("hi"), F.col("s").alias("lo"))
        large = large.where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("s"))
        edges = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("s").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("s").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        edges = staged(edges, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return stars.unionByName(roots)
