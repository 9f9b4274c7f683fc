"""Helpers shared by the corpus operators: staged tables, Arrow grouping, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many members a candidate group is compared in blocks, each block pair in its own task.
BLOCK_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, a temporary one only where it is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='weirflow-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_scopes: list[list[Stage]] = []


@contextlib.contextmanager
def scratch():
    """Drops the stages made within at its end, but for those that keep() is called on."""
    _scopes.append([])
    try:
        yield
    finally:
        for stage in _scopes.pop():
            stage.drop()


class Stage:
    """A DataFrame cut from its lineage: written to the shared folder as Parquet and read again.

    A lost executor costs nothing but the tasks it ran, since the rows are in the shared folder.
    ``drop`` removes a stage once nothing lazy reads it any more.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        free_shuffles(self.spark)
        if _scopes:
            _scopes[-1].append(self)

    def keep(self) -> Stage:
        """Lets the stage outlive the innermost scratch()."""
        if _scopes and self in _scopes[-1]:
            _scopes[-1].remove(self)
            if len(_scopes) > 1:
                _scopes[-2].append(self)
        return self

    def drop(self) -> None:
        _drop_path(self.spark, self.path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's cleaner remove the shuffle files of finished stages now rather than at its next collection."""
    spark.sparkContext._jvm.System.gc()


def row_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of ``column`` (one row at least), so that Python never holds a whole batch."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(column)
        ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        width = 4 if pa.types.is_list(col.type) else 1
        start = 0
        while start < len(col):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most // width, "right")) - 1)
            yield b.slice(start, stop - start)
            start = stop


def group_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a partition sorted by integer ``keys``: tables with the start of each group.

    A group that crosses a batch boundary is carried into the next table, so no table ends inside one.
    """
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t[k].to_numpy() for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        cuts = np.flatnonzero(change)
        last = tuple(c[-1] for c in cols)
        if len(cuts):
            held.append(t.slice(0, int(cuts[-1])))
            whole = pa.concat_tables(held).combine_chunks()
            if whole.num_rows:
                yield whole, _starts(whole, keys)
            held = [t.slice(int(cuts[-1]))]
        else:
            held.append(t)
    if held:
        whole = pa.concat_tables(held).combine_chunks()
        if whole.num_rows:
            yield whole, _starts(whole, keys)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.ones(t.num_rows, bool)
    change[1:] = False
    for k in keys:
        c = t[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def in_blocks(rows: DataFrame, key: list[str], member: str, home: str, cap: int = BLOCK_ROWS) -> DataFrame:
    """Deals groups of over ``cap`` members out in (home block, other block) pairs; every pair of rows still meets.

    Adds hb, cb, as_home and as_other.  A group of at most ``cap`` rows is one block pair.  The sizes are
    pre-aggregated; the joined list holds only groups over the cap.
    """
    sizes = Stage(rows.groupBy(*key).count().where(F.col("count") > cap).select(*key, F.ceil(F.col("count") / cap).cast("int").alias("nb")), "hot-groups")
    home_col = F.col(home)
    if sizes.df.isEmpty():
        sizes.drop()
        return rows.withColumns({"hb": F.lit(0), "cb": F.lit(0), "as_home": home_col, "as_other": F.lit(True)})
    joined = rows.join(sizes.df, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    blk = F.pmod(F.xxhash64(member), F.col("nb")).cast("int")
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    pairs = F.when(F.col("nb") == 1, F.array(F.struct(F.lit(0).alias("hb"), F.lit(0).alias("cb"), home_col.alias("as_home"), F.lit(True).alias("as_other")))).otherwise(
        F.concat(
            F.transform(every, lambda i: F.struct(i.alias("hb"), blk.alias("cb"), F.lit(False).alias("as_home"), F.lit(True).alias("as_other"))),
            F.when(home_col, F.transform(every, lambda i: F.struct(blk.alias("hb"), i.alias("cb"), F.lit(True).alias("as_home"), F.lit(False).alias("as_other")))).otherwise(F.array().cast("array<struct<hb:int,cb:int,as_home:boolean,as_other:boolean>>")),
        )
    )
    return joined.select(*rows.columns, F.explode(pairs).alias("bp")).select(*rows.columns, "bp.hb", "bp.cb", "bp.as_home", "bp.as_other")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); root is the smallest node reachable.

    Alternates the two star operations until nothing changes: a number of rounds logarithmic in the longest chain,
    each round's edges staged in the shared folder.  No neighbour list is ever gathered; minima are pre-aggregated.
    """
    now = Stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        sign = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
        both = now.df.union(now.df.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = Stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = Stage(small, "cc")
        now.drop()
        large.drop()
        now = after
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over 0..n-1, smallest index on top."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
