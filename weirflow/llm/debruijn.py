"""Substring deduplication by de Bruijn compaction.

Nodes are k-grams of words, chosen so that equal passages choose equal ones; an edge runs from one to the next in a text
and stands for all words between.  Edges that occur once are dropped.  Paths through nodes with one edge in and one out
are compacted by pointer doubling, one Spark join a round.  A text's walk along a compacted path has source coordinates;
walks over the same stretch of a path have the same words, and so verify each other as long repeated spans.  Where walks
of different lengths overlap or paths branch, the words at the coordinates of one place of a path are verified against each
other window by window (see ``spans``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .shared import Stage, scratch

WINDOW = 35
SHAPE = spans.Shape(window=WINDOW, gram=6, reach=15, words=True)


def shape_for(window: int) -> spans.Shape:
    """The widest reach that leaves k-grams of about a sixth of the window."""
    gram = max(1, window // 6 + 1 - window % 2)
    return spans.Shape(window, gram, (window - gram + 1) // 2, True)


def compact(edges: DataFrame) -> DataFrame:
    """(edge, path, place) of edges (edge, node, next_node): the nonbranching path of each, and its place on it.

    A path is named by its first edge.  Edges on a cycle without a branch are paths of their own.
    """
    into = edges.groupBy(F.col("next_node").alias("x")).agg(F.count("*").alias("n"), F.min("edge").alias("before")).where("n = 1")
    out = edges.groupBy(F.col("node").alias("x")).agg(F.count("*").alias("n"), F.min("edge").alias("edge")).where("n = 1")
    links = into.select("x", "before").join(out.select("x", "edge"), "x").where("before <> edge").select("edge", "before")
    start = edges.select("edge").join(links, "edge", "left")
    now = Stage(start.select("edge", F.coalesce("before", "edge").alias("path"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("before").isNull().alias("done")), "paths")
    open_before = None
    while (left := now.df.where("not done").count()) and left != open_before:
        open_before = left
        # pointers of finished edges stay; an open one jumps to where its target points
        target = now.df.select(F.col("edge").alias("path"), F.col("path").alias("far"), F.col("place").alias("more"), F.col("done").alias("far_done"))
        moved = now.df.where("not done").join(target, "path").select("edge", F.col("far").alias("path"), (F.col("place") + F.col("more")).alias("place"), F.col("far_done").alias("done"))
        after = Stage(now.df.where("done").union(moved), "paths")
        now.drop()
        now = after
    return now.df.select("edge", F.when(F.col("done"), F.col("path")).otherwise(F.col("edge")).alias("path"), F.when(F.col("done"), F.col("place")).otherwise(0).alias("place"))


def placed(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """``anchors`` with the path and place of their edges, in the graph of the edges of ``found``."""
    edges = Stage(found.groupBy("edge").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("next_node").alias("next_node")), "graph").df
    return spans.join_split(anchors, compact(edges.drop("n")), "edge", spans.hot_keys(edges, "edge"))


def walks(on: DataFrame) -> DataFrame:
    """(uid, path, a, b, lo, hi): each text's walks along compacted paths, from place a to b, words lo to hi."""
    order = Window.partitionBy("uid").orderBy("i")
    before = F.lag("i").over(order)
    # a repeated row lists each of its edges again
    go_on = (before == F.col("i")) | ((before == F.col("i") - 1) & (F.lag("path").over(order) == F.col("path")) & (F.lag("place").over(order) == F.col("place") - 1))
    cut = on.select("uid", "i", "path", "place", "at", "end").withColumn("new", F.when(go_on, 0).otherwise(1)).withColumn("walk", F.sum("new").over(order))
    return cut.groupBy("uid", "walk").agg(F.min("path").alias("path"), F.min("place").alias("a"), F.max("place").alias("b"), F.min("at").alias("lo"), F.max("end").alias("hi"))


def _paths(found: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The anchors, of one class at one place of a path, and the walks that another text takes too."""
    with scratch():
        on = Stage(placed(found.drop("whole", "node", "next_node"), found), "on-paths").keep().df
    long = Stage(walks(on).where(F.col("hi") - F.col("lo") >= window), "walks").df
    many = long.groupBy("path", "a", "b").count().where("count > 1").select("path", "a", "b")
    return on.withColumn("cls", F.xxhash64("path", "place")), long.join(many, ["path", "a", "b"], "left_semi").select("uid", "lo", "hi")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, spans) of the words of each text that a window of ``window`` words repeated anywhere covers."""
    return spans.repeated(docs, SHAPE if window == WINDOW else shape_for(window), _paths)


def _cut(text: bytes | None, runs: np.ndarray) -> tuple:
    if text is None:
        return None, 0, 0
    if not len(runs):
        return text.decode(), len(text.split()), 0
    raw = np.frombuffer(text, np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    edges = np.append(starts, len(raw))
    keep, at = [], 0
    for lo, hi in runs:
        keep.append(text[at : edges[lo]])
        at = int(edges[hi])
    keep.append(text[at:])
    return b"".join(keep).decode(), len(starts), int((runs[:, 1] - runs[:, 0]).sum())


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of ``docs`` (all columns) with repeated passages cut out of text; n_words and n_removed (long) are added.

    Words are runs of bytes other than space, tab and line breaks.  A word goes if a window of ``window`` words that covers
    it starts at another place too, in the same text or another; windows are judged on the input.  What is left keeps its
    white space.  Null texts stay null; short and empty texts are unchanged; repeated rows, also of one doc_id, repeat each
    other; a null doc_id is a document like any other; an empty table gives no rows.
    """
    return spans.apply_runs(docs, repeated_spans(docs, window), _cut, "text string, n_words long, n_removed long").select(*docs.columns, *(c for c in ("n_words", "n_removed") if c not in docs.columns))
