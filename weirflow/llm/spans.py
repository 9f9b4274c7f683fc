"""Repeated windows of units (bytes or words) across all texts: anchors, candidate edges and the exact check.

Each window of W units has one anchor: the place of the smallest k-gram hash among its first g (the leftmost of ties), so
equal windows have their anchors at equal offsets.  With 2 g + k - 1 <= W the next anchor and its k-gram also lie inside
the window, so the window holds the whole edge, the units from its anchor to the end of the next one's k-gram.  A window
can therefore repeat only if the edge of its anchor does.  That leaves few candidate edges, which the two substring
operators order or compact by their own methods.  A method gives back stretches that repeat and the anchors that stand
together with another place, with what they have in common as their class; nothing else is looked at again.  The windows
of such anchors that no stretch holds are verified within their class: first all windows of an anchor at once (by a
128-bit hash of the units they span), then, where surroundings differ, window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stage, row_slices, scratch

#: Windows that are thinned out together before they are compared one by one.
BLOCK = 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _A) ^ ((np.arange(1, 257, dtype=np.uint64) * _B) >> np.uint64(23))


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int
    reach: int
    words: bool

    def __post_init__(self):
        if 2 * self.reach + self.gram - 1 > self.window:
            raise ValueError("a window must hold a whole edge")


class Units:
    """The units of a text: their hashes and the bytes of any run of them."""

    def __init__(self, text: bytes | None, words: bool):
        text = text or b""
        if not words:
            self.data, self.n = text, len(text)
            self.sym = _BYTE[np.frombuffer(text, np.uint8)]
            self.starts = self.ends = None
            return
        parts = text.split()
        self.data, self.n = b" ".join(parts), len(parts)
        raw = np.frombuffer(self.data, np.uint8)
        space = np.flatnonzero(raw == 32)
        self.starts, self.ends = np.append(0, space + 1), np.append(space, len(raw))
        if not self.n:
            self.sym = np.zeros(0, np.uint64)
            return
        place = np.arange(len(raw)) - np.repeat(self.starts, np.append(np.diff(self.starts), len(raw) - self.starts[-1]))
        mixed = _BYTE[raw] * _powers(int(place.max()) + 1)[place]
        mixed[space] = 0
        h = np.add.reduceat(mixed, self.starts) + (self.ends - self.starts).astype(np.uint64) * _B
        self.sym = (h ^ (h >> np.uint64(31))) * _A

    def cut(self, i: int, j: int) -> bytes:
        return self.data[i:j] if self.starts is None else self.data[self.starts[i] : self.ends[j - 1]]


_power_table = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power_table
    if len(_power_table) < n:
        table = np.full(max(n, 256), _B | np.uint64(1), np.uint64)
        table[0] = 1
        _power_table = np.multiply.accumulate(table)
    return _power_table


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def grams(sym: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k units, by doubling."""
    h, done = sym, 1
    while done < k:
        step = min(done, k - done)
        h = _joined(h[:-step], h[step:])
        done += step
    return h


@dataclass
class Anchors:
    at: np.ndarray  # place of each anchor
    end: np.ndarray  # end of its edge
    first: np.ndarray  # its windows start at first..last
    last: np.ndarray
    node: np.ndarray  # k-gram hash at the anchor, and at the next
    next_node: np.ndarray


def find_anchors(u: Units, shape: Shape) -> Anchors | None:
    if u.n < shape.window:
        return None
    h = grams(u.sym, shape.gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done < shape.reach:
        step = min(done, shape.reach - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    at = place[first]
    m = int(np.searchsorted(first, u.n - shape.window, "right"))
    following = at[1 : m + 1]
    last = np.minimum(np.append(first[1:], len(place))[:m] - 1, u.n - shape.window)
    return Anchors(at[:m], following + shape.gram, first[:m], last, h[at[:m]], h[following])


def _hash64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _edges(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1):
            uid, at, edge = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                u = Units(text, shape.words)
                a = find_anchors(u, shape)
                if a is None:
                    continue
                m = len(a.at)
                uid.append(np.full(m, doc, np.int64))
                at.append(np.arange(m, dtype=np.int32))
                edge.append(np.fromiter((_hash64(u.cut(s, e)) for s, e in zip(a.at.tolist(), a.end.tolist())), np.uint64, m).view(np.int64))
            if uid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (uid, at, edge)], ["uid", "i", "edge"])

    return run


def _details(shape: Shape):
    """What the exact check needs of the candidate anchors of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1):
            cols: list[list] = [[] for _ in DETAIL_NAMES]
            for doc, text, chosen in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                u = Units(text, shape.words)
                a = find_anchors(u, shape)
                i = np.array(sorted(chosen), np.int64)
                if a is None or not len(i):
                    continue
                s, e, f, t = a.at[i], a.end[i], a.first[i], a.last[i] + shape.window
                edge = np.fromiter((_hash64(u.cut(x, y)) for x, y in zip(s.tolist(), e.tolist())), np.uint64, len(i))
                common = shape.window - shape.reach + 1  # units from the anchor that all its windows hold
                core = np.fromiter((_hash64(u.cut(x, x + common)) for x in s.tolist()), np.uint64, len(i))
                span = np.frombuffer(b"".join(xxhash.xxh3_128_digest(u.cut(x, y) + b"|%d" % (z - x)) for x, y, z in zip(f.tolist(), t.tolist(), s.tolist())), np.int64).reshape(-1, 2)
                whole = np.maximum(np.searchsorted(a.end, s + shape.window, "right") - i, 1)
                for c, v in zip(cols, (np.full(len(i), doc, np.int64), i.astype(np.int32), edge.view(np.int64), s, e, f, t, a.node[i].view(np.int64), a.next_node[i].view(np.int64), core.view(np.int64), span[:, 0], span[:, 1], whole.astype(np.int32))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], DETAIL_NAMES)

    return run


DETAIL_NAMES = ["uid", "i", "edge", "at", "end", "lo", "hi", "node", "next_node", "core", "s1", "s2", "whole"]
#: An anchor of a text: its number, edge, the edge's units, those that its windows span, and how many edges a window holds at most.
DETAIL_SCHEMA = "uid long, i int, edge long, at long, end long, lo long, hi long, node long, next_node long, core long, s1 long, s2 long, whole int"
#: What a method makes of the candidate anchors: those that stand together with another place (their columns and a class,
#: cls long), and stretches (uid, lo, hi) of units that occur at another place too.
Method = Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]


def _blocks(shape: Shape):
    """A row for each BLOCK neighbouring windows of an anchor: hashes of the units that all of them hold, and of all they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1, 1 << 20):
            for doc, text, chosen in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                u, out = Units(text, shape.words), []
                for c in chosen:
                    at, first, last = c["at"], c["lo"], c["hi"] - shape.window
                    for b in range((at - last) // BLOCK, (at - first) // BLOCK + 1):
                        high = at - BLOCK * b  # the block's last start; blocks are counted from the anchor
                        low, top = max(first, high - BLOCK + 1), min(last, high)
                        key = xxhash.xxh3_64_digest(u.cut(high, high - BLOCK + 1 + shape.window) + b"|%d" % b)
                        span = xxhash.xxh3_128_digest(u.cut(low, top + shape.window) + b"|%d" % (at - low))
                        out.append((key + span, low, top, c["single"]))
                w = np.frombuffer(b"".join(x[0] for x in out), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(w[:, k])) for k in range(3)), pa.array(np.full(len(out), doc, np.int64)), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.bool_())], ["core", "s1", "s2", "uid", "first", "last", "single"])

    return run


def _windows(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1, 1 << 20):
            for doc, text, chosen in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                u = Units(text, shape.words)
                for k in range(0, len(chosen), 500):
                    out = [(x, c["single"]) for c in chosen[k : k + 500] for x in range(c["first"], c["last"] + 1)]
                    w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(u.cut(x, x + shape.window)) for x, _ in out), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(len(out), doc, np.int64)), pa.array([x for x, _ in out], pa.int64()), pa.array([s for _, s in out], pa.bool_())], ["w1", "w2", "uid", "x", "single"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(uid, text): a row's identity is the hash of its doc_id and text; rows that are repeated repeat each other's windows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text).alias("uid"), text.alias("text"))


def hot_keys(counts: DataFrame, key: str, share: int = 1000) -> list:
    """The keys with over one ``share``-th of all rows, so fewer than ``share``; ``counts``: (key, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.where(F.col("n") * share > total).select(key).collect()]


def join_split(rows: DataFrame, keyed: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed`` (one row a key); the rows of the few ``hot`` keys stay where they are."""
    if not hot:
        return rows.join(keyed, key, how)
    often = F.col(key).isin(hot)
    return rows.where(~often).join(keyed.where(~often), key, how).unionByName(rows.where(often).join(F.broadcast(keyed.where(often)), key, how))


def repeated(docs: DataFrame, shape: Shape, method: Method) -> DataFrame:
    """(uid, spans array<struct<lo, hi>>): runs of units covered by windows that start at more than one place.

    ``method`` gets the candidate anchors (DETAIL_SCHEMA).
    """
    with scratch():
        return Stage(_repeated(keyed(docs), shape, method), "spans").keep().df


def _meeting(rows: DataFrame) -> DataFrame:
    """The rows (w1, w2, single) whose key has two rows or more, one of them single."""
    shared = rows.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.max("single").alias("s")).where("c > 1 and s").select("w1", "w2")
    return rows.join(shared, ["w1", "w2"], "left_semi")


def _settled(anchors: DataFrame, stretches: DataFrame) -> DataFrame:
    """``anchors`` with settled: whether one of their text's stretches holds all their windows."""
    kept = ["uid", "i", "at", "core", "lo", "hi", "s1", "s2", "cls"]
    starts = stretches.groupBy("uid", "lo").agg(F.max("hi").alias("reach"))
    events = anchors.select(*kept, F.lit(1).alias("asks"), F.lit(None).cast("long").alias("reach")).unionByName(starts.withColumn("asks", F.lit(0)), allowMissingColumns=True)
    known = F.max("reach").over(Window.partitionBy("uid").orderBy("lo", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("known", known).where("asks = 1").select(*kept, F.coalesce(F.col("known") >= F.col("hi"), F.lit(False)).alias("settled"))


def _candidates(texts: DataFrame, shape: Shape) -> tuple[Stage, DataFrame]:
    """The candidate anchors (DETAIL_SCHEMA), and the identities (uid) of rows that are there more than once."""
    edges = Stage(texts.mapInArrow(_edges(shape), "uid long, i int, edge long"), "edges")
    many = Stage(edges.df.groupBy("edge").agg(F.count("*").alias("n")).where("n > 1"), "edge-counts")
    chosen = join_split(edges.df, many.df.select("edge"), "edge", hot_keys(many.df, "edge"), "left_semi").groupBy("uid").agg(F.collect_set("i").alias("chosen"))
    chosen = Stage(chosen, "chosen")
    twins = Stage(edges.df.where("i = 0").groupBy("uid").count().where("count > 1").select("uid"), "twins").df
    edges.drop()
    many.drop()
    found = Stage(texts.join(chosen.df, "uid").select("uid", "text", "chosen").mapInArrow(_details(shape), DETAIL_SCHEMA), "anchors")
    chosen.drop()
    return found, twins


def _repeated(texts: DataFrame, shape: Shape, method: Method) -> DataFrame:
    found, twins = _candidates(texts, shape)
    with scratch():
        anchors, stretches = method(found.df, shape.window)
        # a row that is there twice repeats itself
        stretches = Stage(stretches.select("uid", "lo", "hi").union(found.df.join(twins, "uid", "left_semi").select("uid", "lo", "hi").distinct()), "stretches").keep().df
        rest = Stage(_settled(anchors, stretches), "rest").keep().df
    found.drop()
    classes = rest.groupBy("cls", "s1", "s2").agg(F.count("*").alias("n"), F.min("core").alias("core"), F.min(F.struct("uid", "i", "at", "lo", "hi")).alias("one"), F.min("settled").alias("settled"))
    classes = Stage(classes, "classes").df
    whole = rest.where("not settled").join(classes.where("n > 1").select("cls", "s1", "s2"), ["cls", "s1", "s2"]).select("uid", "lo", "hi")
    # cores with an open class and several classes: compare block by block and window by window, one place a class
    varied = classes.groupBy("core").agg(F.count("*").alias("k"), F.max((F.col("n") == 1) & ~F.col("settled")).alias("open")).where("k > 1 and open").select("core")
    asked = classes.join(varied, "core").select("one.*", ((F.col("n") == 1) & ~F.col("settled")).alias("single"))
    if shape.reach > BLOCK:
        asked = asked.groupBy("uid").agg(F.collect_list(F.struct("at", "lo", "hi", "single")).alias("asked"))
        blocks = Stage(texts.join(asked, "uid").select("uid", "text", "asked").mapInArrow(_blocks(shape), "core long, s1 long, s2 long, uid long, first long, last long, single boolean"), "blocks").df
        classes = blocks.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.min("core").alias("core"), F.min(F.struct("uid", "first", "last")).alias("one"), F.max("single").alias("single"))
        classes = Stage(classes, "classes").df
        whole = whole.union(blocks.where("single").join(classes.where("n > 1").select("s1", "s2"), ["s1", "s2"]).select("uid", "first", (F.col("last") + shape.window).alias("hi")))
        varied = classes.groupBy("core").agg(F.count("*").alias("k"), F.max((F.col("n") == 1) & F.col("single")).alias("open")).where("k > 1 and open").select("core")
        asked = classes.join(varied, "core").select("one.*", ((F.col("n") == 1) & F.col("single")).alias("single"))
    else:
        asked = asked.select("uid", F.col("lo").alias("first"), (F.col("hi") - shape.window).alias("last"), "single")
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "single")).alias("asked"))
    windows = Stage(texts.join(asked, "uid").select("uid", "text", "asked").mapInArrow(_windows(shape), "w1 long, w2 long, uid long, x long, single boolean"), "windows")
    runs = _meeting(windows.df).where("single").groupBy("uid").agg(F.collect_set("x").alias("starts"))
    found_runs = whole.union(stretches.select("uid", "lo", "hi")).groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("wide"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    narrow = F.transform("starts", lambda x: F.struct(x.alias("lo"), (x + shape.window).alias("hi")))
    return found_runs.join(runs, "uid", "full_outer").select("uid", F.concat(F.coalesce("wide", none), F.coalesce(narrow, none)).alias("spans"))


def merge_runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(n, 2): maximal disjoint runs, in order; runs that touch are one."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > top[:-1])
    return np.stack([lo[new], top[np.append(new[1:], True)]], axis=1)


def _runs(col: pa.ListArray) -> list[np.ndarray]:
    flat = col.flatten()
    lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    ends = np.cumsum(np.append(0, pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)))
    return [merge_runs(lo[a:b], hi[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def apply_runs(docs: DataFrame, spans: DataFrame, change: Callable, added: str) -> DataFrame:
    """``docs`` with columns ``added``: what ``change(text bytes or None, runs)`` gives for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    uid = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text)
    names = [c.split()[0] for c in added.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<lo:long,hi:long>>": pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))}[c.split()[1]] for c in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 0):
            rows = [change(t, r) for t, r in zip(part.column(0).cast(pa.binary()).to_pylist(), _runs(part.column(1)))]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*kept, *names])

    joined = docs.withColumn("uid__", uid).join(spans.select(F.col("uid").alias("uid__"), F.col("spans").alias("runs__spans")), "uid__", "left")
    return joined.select(F.col("text").cast("string").alias("text__spans"), "runs__spans", *kept).mapInArrow(run, ", ".join(x for x in (schema, added) if x))
