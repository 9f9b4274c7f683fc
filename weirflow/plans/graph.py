"""Iteration over call edges: a fixpoint of effect sets and keyed closures, safe on cycles.

Both are semi-naive: a round joins only what the round before found.  Every round's state is staged, so plans stay short
and a lost executor costs one round's tasks at most.  A cap on rounds raises; no answer is ever cut short.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage

ROUNDS = 10_000


def propagate(edges: DataFrame, seeds: DataFrame, staged: bool = False) -> DataFrame:
    """(fn, mask): the least sets such that a caller has all that its callees have.

    ``edges`` (src, dst) and ``seeds`` (fn, mask bigint); sets are bits, united by bit_or, which combines before the shuffle.
    Units without a seed that reach nothing are not listed.  ``staged`` edges are read as they are each round.
    """
    calls = edges if staged else Stage(edges.select("src", "dst").distinct(), "calls").df
    fresh = Stage(seeds.groupBy("fn").agg(F.bit_or("mask").alias("mask")).where("mask <> 0"), "masks")
    levels = [fresh]
    for _ in range(ROUNDS):
        found = fresh.df.join(calls, F.col("fn") == F.col("dst")).groupBy(F.col("src").alias("fn")).agg(F.bit_or("mask").alias("add"))
        known = functools.reduce(DataFrame.unionByName, [level.df for level in levels])
        # what is known is read beside what was found, not rewritten; few finds are broadcast by their measured size
        both = found.join(known, "fn", "left").groupBy("fn").agg(F.bit_or("add").alias("add"), F.coalesce(F.bit_or("mask"), F.lit(0)).alias("mask"))
        fresh = Stage(both.select("fn", F.col("add").bitwiseAND(F.bitwise_not("mask")).alias("mask")).where("mask <> 0"), "masks")
        if fresh.df.isEmpty():
            break
        levels.append(fresh)
        if len(levels) > 8:  # one table of the levels so far, the last aside, so that a round joins few
            levels = [_united(levels[:-1]), fresh]
    else:
        raise RuntimeError("the fixpoint did not settle")
    fresh.drop()
    return (levels[0] if len(levels) == 1 else _united(levels)).df


def _united(levels: list[Stage]) -> Stage:
    """One table of several of (fn, mask), which are dropped."""
    whole = functools.reduce(DataFrame.unionByName, [level.df for level in levels])
    out = Stage(whole.groupBy("fn").agg(F.bit_or("mask").alias("mask")), "masks")
    for level in levels:
        level.drop()
    return out


def closure(edges: DataFrame, seeds: DataFrame, key: list[str] = [], seeded: bool = True, staged: bool = False) -> DataFrame:  # noqa: B006
    """(*key, node, hops): what each key's seeds reach along ``edges`` (src, dst, and key columns of its own if any).

    ``seeds`` has (*key, node).  With ``seeded`` the seeds are in the answer at 0 hops; without, a seed is in it only if a
    path leads back to it.  hops is the length of the shortest path.  ``staged`` edges are read as they are each round.
    """
    ids = [*key, "node"]
    own = [k for k in key if k in edges.columns]
    steps = edges if staged else Stage(edges.select(*own, "src", "dst").distinct(), "steps").df
    first = seeds.select(*ids).distinct().withColumn("hops", F.lit(0))
    delta = Stage(first, "delta")
    reached = [delta] if seeded else []
    for hop in range(1, ROUNDS):
        on = [delta.df["node"] == steps["src"], *(delta.df[k] == steps[k] for k in own)]
        near = delta.df.join(steps, on).select(*(delta.df[k] for k in key), F.col("dst").alias("node")).distinct()
        for old in reached:
            near = near.join(old.df.select(*ids), ids, "left_anti")
        after = Stage(near.withColumn("hops", F.lit(hop)), "delta")
        if after.df.isEmpty():
            after.drop()
            break
        reached.append(after)
        delta = after
        if len(reached) > 8:  # one table of what is reached, so that a round joins few
            whole = reached[0].df
            for other in reached[1:-1]:
                whole = whole.unionByName(other.df)
            merged = Stage(whole, "reached")
            for old in reached[:-1]:
                old.drop()
            reached = [merged, reached[-1]]
    else:
        raise RuntimeError("the closure did not settle")
    out = first.limit(0)
    for part in reached:
        out = out.unionByName(part.df)
    return out


def witness(edges: DataFrame, starts: DataFrame, goals: DataFrame, stop: bool = True) -> DataFrame:
    """(key, path array): of the shortest paths from each key's start to a goal, the first one.

    ``starts`` has (key, node), ``goals`` (key, node); ``edges`` (key, src, dst).  A start that is a goal is its own path.
    Paths stand in the order of the places of their steps if edges have one (ord), which a breadth-first walk that takes
    callees in that order follows; else in the order of their names.  One path is kept for each node and key.
    """
    ranked = "ord" in edges.columns
    place = F.col("ord").cast("long") if ranked else F.col("dst")
    steps = Stage(edges.select("key", "src", "dst", place.alias("ord")).groupBy("key", "src", "dst").agg(F.min("ord").alias("ord")), "steps").df
    ends = Stage(goals.select("key", "node").distinct(), "goals").df
    origin = F.array().cast("array<bigint>" if ranked else "array<string>")
    delta = Stage(starts.select("key", "node", origin.alias("rank"), F.array("node").alias("path")), "delta").df
    seen = delta.select("key", "node")
    found = []
    for _ in range(ROUNDS):
        hit = Stage(delta.join(ends, ["key", "node"]).groupBy("key").agg(F.min(F.struct("rank", "path")).alias("best")).select("key", "best.path"), "found").df
        found.append(hit)
        open_keys = delta.join(hit.select("key"), "key", "left_anti") if stop else delta
        near = open_keys.join(steps, (open_keys["node"] == steps["src"]) & (open_keys["key"] == steps["key"])).select(open_keys["key"], F.col("dst").alias("node"), F.array_append("rank", F.col("ord")).alias("rank"), F.array_append("path", F.col("dst")).alias("path"))
        near = near.join(seen, ["key", "node"], "left_anti").groupBy("key", "node").agg(F.min(F.struct("rank", "path")).alias("best"))
        delta = Stage(near.select("key", "node", "best.rank", "best.path"), "delta").df
        if delta.isEmpty():
            break
        seen = Stage(seen.unionByName(delta.select("key", "node")), "seen").df
    else:
        raise RuntimeError("the walk did not settle")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def witnesses(edges: DataFrame, start: str, goals: DataFrame, keys: list[str]) -> DataFrame:
    """(key, path array): what ``witness`` gives for one start and edges (src, dst) that are the same for all keys.

    One walk serves all ``keys``, so the edges are not multiplied by them, and a round reads them as they are unless they
    have a place (ord).  It ends when every key has its path or nothing new is reached.
    """
    spark = edges.sparkSession
    ranked = "ord" in edges.columns
    steps = Stage(edges.groupBy("src", "dst").agg(F.min(F.col("ord").cast("long")).alias("ord")), "steps").df if ranked else edges.select("src", "dst")
    shape = f"node string, {'rank array<bigint>, ' if ranked else ''}path array<string>"
    delta = Stage(spark.createDataFrame([(start, *([[]] if ranked else []), [start])], shape), "delta")
    best, levels, left, found = [*(["rank"] if ranked else []), "path"], [delta], set(keys), []
    for _ in range(ROUNDS):
        open_goals = goals.where(F.col("key").isin(*left)).distinct()
        hit = delta.df.join(open_goals, "node").groupBy("key").agg(F.min(F.struct(*best)).alias("best")).select("key", "best.path")
        rows = hit.collect()  # a path a key
        found += [(r["key"], r["path"]) for r in rows]
        left -= {r["key"] for r in rows}
        if not left:
            break
        near = delta.df.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), *([F.array_append("rank", F.col("ord")).alias("rank")] if ranked else []), "path")
        near = near.groupBy("node").agg(F.min(F.struct(*best)).alias("best")).select("node", *(f"best.{b}" for b in best))
        for old in levels:
            near = near.join(old.df.select("node"), "node", "left_anti")
        delta = Stage(near.withColumn("path", F.array_append("path", F.col("node"))), "delta")
        if delta.df.isEmpty():
            break
        levels.append(delta)
        if len(levels) > 8:  # one table of the nodes so far, so that a round joins few
            merged = Stage(functools.reduce(DataFrame.unionByName, [old.df.select("node") for old in levels[:-1]]), "seen")
            for old in levels[:-1]:
                old.drop()
            levels = [merged, delta]
    else:
        raise RuntimeError("the walk did not settle")
    for old in {id(x): x for x in [*levels, delta]}.values():
        old.drop()
    return spark.createDataFrame(found, "key string, path array<string>")
