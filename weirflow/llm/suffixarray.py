"""Suffix-array deduplication of bytes by a distributed difference-cover algorithm.

The letters are the candidate edges of ``spans``: runs of bytes between places that equal passages choose alike, about a
hundred bytes each; edges that occur once end a string.  Suffixes of the strings are sorted by the difference cover
modulo 3: the triples at places 1 and 2 (mod 3) are sorted and named, the string of names is sorted in turn, and the
suffixes at places 0 (mod 3) are merged in, since from any two places one can step at most two letters to two sampled
ones.  Neighbours in the order are compared letter by letter; what they share is a stretch of bytes that repeats, and a
suffix that shares nothing with its neighbours has no repeat.  The bytes just before and after such stretches, within the
letters around them, are verified window by window.

The recursion goes on until names are unique or cover as many letters as the window of any text here holds, which is what
the order is needed over: suffixes that agree in more are equal as far as windows go.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import Stage, group_runs, scratch

WINDOW = 400
SHAPE = spans.Shape(window=WINDOW, gram=24, reach=188, words=False)
#: Letters that neighbours are compared over at a time; a longer stretch that two texts share is made of several.
COMPARE = 8
#: Suffixes that a task merges at a time.
BUCKET = 50_000
#: Bound of the suffixes that the driver draws to divide the order.
SPLITTERS = 65_536
SEP = np.iinfo(np.int64).min
FIELDS = ["uid", "p", "mod", "s0", "s1", "r0", "r1", "r2"]


def shape_for(window: int) -> spans.Shape:
    gram = max(1, min(24, window // 6) + 1 - (window + min(24, window // 6)) % 2)
    return spans.Shape(window, gram, (window - gram + 1) // 2, False)


def _lists(col: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of lists; null lists are empty."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.append(0, pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, p, q, t0, t1, t2): sampled places, where their names will stand in the string of names, and their triples."""
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for uid, c in zip(b.column(0).to_pylist(), _lists(b.column(1))):
            n = len(c)
            p = np.arange(n)
            p = p[(p % 3 != 0) & (c != SEP)]
            padded = np.append(c, [SEP, SEP])
            t0, t1, t2 = padded[p], padded[p + 1], padded[p + 2]
            t2 = np.where(t1 == SEP, SEP, t2)
            q = np.where(p % 3 == 1, (p - 1) // 3, (n + 1) // 3 + 1 + (p - 2) // 3)
            for x, v in zip(cols, (np.full(len(p), uid), p, q, t0, t1, t2)):
                x.append(v.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in cols], ["uid", "p", "q", "t0", "t1", "t2"])


def _string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of (place, letter) pairs, with a separator where a place is missing."""
    for b in batches:
        out = []
        for p, c in zip(_lists(b.column(1)), _lists(b.column(2))):
            row = np.full(int(p.max()) + 1 if len(p) else 0, SEP, np.int64)
            row[p] = c
            out.append(row)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["uid", "c"])


def _strings(rows: DataFrame, place: str, letter: str) -> DataFrame:
    """(uid, c array<long>) of rows (uid, place, letter)."""
    pairs = F.sort_array(F.collect_set(F.struct(F.col(place).cast("long").alias("p"), F.col(letter).alias("c"))))
    return rows.groupBy("uid").agg(pairs.alias("pc")).select("uid", "pc.p", "pc.c").mapInArrow(_string, "uid long, c array<long>")


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are merged: each place with its next letters and the ranks of the sampled places from there on."""
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in range(8)]
        for uid, c, at, rank in zip(b.column(0).to_pylist(), *(_lists(b.column(k)) for k in range(1, 4))):
            n = len(c)
            s, r = np.append(c, [SEP, SEP, SEP]), np.full(n + 3, -1, np.int64)
            r[at.astype(np.int64)] = rank
            p = np.flatnonzero(c != SEP)
            ended = s[p + 1] == SEP
            for x, v in zip(cols, (np.full(len(p), uid), p, p % 3, s[p], s[p + 1], r[p], np.where(ended, -1, r[p + 1]), np.where(ended, -1, r[p + 2]))):
                x.append(v.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in cols], FIELDS)


def compare(x: dict, y: dict) -> np.ndarray:
    """-1, 0 or 1 for rows of suffixes, elementwise: by ranks if both are sampled, else after one or two letters."""
    xs, ys = x["mod"] != 0, y["mod"] != 0
    both, two = xs & ys, (x["mod"] == 2) | (y["mod"] == 2)
    out = np.zeros(np.broadcast(x["p"], y["p"]).shape, np.int8)
    keys = [
        [np.where(both, v["r0"], v["s0"]) for v in (x, y)],
        [np.where(both, 0, np.where(two, v["s1"], v["r1"])) for v in (x, y)],
        [np.where(both | ~two, 0, v["r2"]) for v in (x, y)],
        [v["uid"] for v in (x, y)],
        [v["p"] for v in (x, y)],
    ]
    for a, b in keys:
        out = np.where(out != 0, out, np.int8(1) * (a > b) - np.int8(1) * (a < b))
    return out


def _place(rows: dict, among: dict, size: int) -> np.ndarray:
    """How many of the sorted ``among`` are smaller than each row."""
    n = len(rows["p"])
    low, high = np.zeros(n, np.int64), np.full(n, size, np.int64)
    while (go := low < high).any():
        mid = (low + high) // 2
        at = np.minimum(mid, size - 1)
        less = compare({k: v[at] for k, v in among.items()}, rows) < 0
        low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
    return low


def merge(rows: dict) -> np.ndarray:
    """The order of a bucket's suffixes: sampled and other ones are sorted apart and then merged."""
    sampled, other = np.flatnonzero(rows["mod"] != 0), np.flatnonzero(rows["mod"] == 0)
    sampled = sampled[np.lexsort((rows["p"][sampled], rows["uid"][sampled], rows["r0"][sampled]))]
    other = other[np.lexsort((rows["p"][other], rows["uid"][other], rows["r1"][other], rows["s0"][other]))]
    if not len(sampled) or not len(other):
        return np.append(sampled, other)
    at = _place({k: v[other] for k, v in rows.items()}, {k: v[sampled] for k, v in rows.items()}, len(sampled))
    at = np.maximum.accumulate(at)
    return np.append(sampled, other)[np.argsort(np.append(2 * np.arange(len(sampled)) + 1, 2 * at), kind="stable")]


def _bucketed(rows: DataFrame, carried: tuple = ()) -> tuple[DataFrame, Broadcast]:
    """``rows`` with a bucket, each a range of the order, and the drawn suffixes that divide it, bounded in number.

    The last suffix of each bucket but the last is the one drawn; these have the columns ``carried`` too.
    """
    spark = rows.sparkSession
    n = rows.count()
    wanted = int(min(SPLITTERS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET)))
    drawn = rows.select(*FIELDS, *carried).orderBy(F.xxhash64("uid", "p")).limit(wanted).toPandas()
    order = sorted(range(len(drawn)), key=functools.cmp_to_key(lambda i, j: int(compare(*({k: drawn[k].to_numpy()[[m]] for k in FIELDS} for m in (i, j)))[0]))) if len(drawn) < 3000 else merge({k: drawn[k].to_numpy() for k in FIELDS})
    cuts = {k: drawn[k].to_numpy()[order] for k in FIELDS}
    cuts |= {k: np.array(drawn[k].tolist(), np.int64)[order] for k in carried if len(drawn)}
    shared = spark.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = {k: shared.value[k] for k in FIELDS}
        for b in batches:
            row = {k: b.column(b.schema.get_field_index(k)).to_numpy() for k in FIELDS}
            bucket = _place(row, cuts, len(cuts["p"])) if len(cuts["p"]) else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns], names=["bucket", *b.schema.names])

    schema = ", ".join(f"{c} {t}" for c, t in (("bucket", "long"), *rows.dtypes))
    return rows.mapInArrow(run, schema).repartition("bucket").sortWithinPartitions("bucket"), shared


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, p, rank) in the order; suffixes that can't be told apart share a rank."""
    for t, starts in group_runs(batches, ["bucket"]):
        for s, e in zip(starts, np.append(starts[1:], t.num_rows)):
            part = t.slice(s, e - s)
            rows = {k: part[k].to_numpy() for k in FIELDS}
            order = merge(rows)
            rows = {k: v[order] for k, v in rows.items()}
            now = {k: v[1:] for k, v in rows.items()}
            before = {k: (v[:-1] if k not in ("uid", "p") else now[k]) for k, v in rows.items()}
            rank = np.cumsum(np.append(0, compare(before, now) != 0)) + (int(part["bucket"][0].as_py()) << 40)
            yield pa.RecordBatch.from_arrays([pa.array(rows["uid"]), pa.array(rows["p"]), pa.array(rank)], ["uid", "p", "rank"])


def sampled_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """(uid, p, rank) of the places 1 and 2 (mod 3) of ``strings`` (uid, c): their triples named, and the names sorted."""
    triples = Stage(strings.mapInArrow(_triples, "uid long, p long, q long, t0 long, t1 long, t2 long"), "triples").df
    key = ["t0", "t1", "t2"]
    names = Stage(triples.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id()), "names").df
    named = Stage(triples.join(names, key).select("uid", "p", "q", "name"), "named").df
    if not depth or names.count() == triples.count():
        return named.select("uid", "p", F.col("name").alias("rank"))
    ranks = suffix_ranks(_strings(named, "q", "name"), depth - 1).withColumnRenamed("p", "q")
    return named.join(ranks, ["uid", "q"]).select("uid", "p", "rank")


def _with_ranks(strings: DataFrame, depth: int) -> DataFrame:
    ranks = sampled_ranks(strings.select("uid", "c"), depth).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("p", "rank"))).alias("pr"))
    rest = [c for c in strings.columns if c not in ("uid", "c")]
    return strings.join(ranks, "uid", "left").select("uid", "c", "pr.p", "pr.rank", *rest)


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """(uid, p, rank) of every place of ``strings`` (uid, c array<long>): its suffix's rank in the order of all suffixes."""
    strings = Stage(strings, "strings").df
    with scratch():
        rows = Stage(_with_ranks(strings, depth).mapInArrow(_suffixes, ", ".join(f"{f} long" for f in FIELDS)), "suffixes").keep().df
    return _bucketed(rows)[0].mapInArrow(_ranked, "uid long, p long, rank long")


def _neighbours(shared: Broadcast):
    """(uid, i, lo, hi): the bytes of the letters that each suffix shares with a neighbour in the order.

    The suffix before a bucket's first is the one drawn to end the bucket before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in group_runs(batches, ["bucket"]):
            for s, e in zip(starts, np.append(starts[1:], t.num_rows)):
                part = t.slice(s, e - s).combine_chunks()
                order, bucket = merge({k: part[k].to_numpy() for k in FIELDS}), int(part["bucket"][0].as_py())
                rows = {k: part[k].to_numpy()[order] for k in ("uid", "p", "at")}
                rows |= {k: part[k].combine_chunks().flatten().to_numpy().reshape(-1, COMPARE)[order] for k in ("letters", "ends")}
                if bucket:
                    rows = {k: np.concatenate([shared.value[k][bucket - 1 : bucket], v]) for k, v in rows.items()}
                letters = rows["letters"]
                same = (letters[1:] == letters[:-1]) & (letters[1:] != SEP)
                agree = np.where(same.all(axis=1), COMPARE, (~same).argmax(axis=1))
                most = np.maximum(np.append(0, agree), np.append(agree, 0))
                hit = np.flatnonzero(most > 0)
                yield pa.RecordBatch.from_arrays([pa.array(rows["uid"][hit]), pa.array(rows["p"][hit].astype(np.int32)), pa.array(rows["at"][hit]), pa.array(rows["ends"][hit, most[hit] - 1])], ["uid", "i", "lo", "hi"])

    return run


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes with the bytes where they start, their next letters, and the bytes where those end."""
    for b in batches:
        base = next(_suffixes(iter([b])))
        out: list[list[np.ndarray]] = [[] for _ in range(3)]
        for c, at, end in zip(_lists(b.column(1)), _lists(b.column(4)), _lists(b.column(5))):
            p = np.flatnonzero(c != SEP)
            pick = p[:, None] + np.arange(COMPARE)
            for x, v in zip(out, (at[p], np.append(c, [SEP] * COMPARE)[pick], np.append(end, [0] * COMPARE)[pick])):
                x.append(v.reshape(-1))
        at, c, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        step = pa.array(np.arange(0, len(c) + 1, COMPARE), pa.int32())
        yield pa.RecordBatch.from_arrays([*base.columns, pa.array(at), pa.ListArray.from_arrays(step, pa.array(c)), pa.ListArray.from_arrays(step, pa.array(e))], [*FIELDS, "at", "letters", "ends"])


def _placed_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, c, at, end) of (uid, p, edge, at, end): arrays by place, separators and zeros where a place is missing."""
    for b in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        for p, *values in zip(*(_lists(b.column(k)) for k in range(1, 5))):
            for x, v, filler in zip(out, values, (SEP, 0, 0)):
                row = np.full(int(p.max()) + 1, filler, np.int64)
                row[p] = v
                x.append(row)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in out)], ["uid", "c", "at", "end"])


def depth_for(letters: int) -> int:
    """Levels of names until each covers so many letters: three at the first, three times as many at each further one."""
    depth = 0
    while 3 ** (depth + 1) < letters:
        depth += 1
    return depth


def _order(found: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The anchors whose suffix shares its first letter (their class) with a neighbour, and what neighbours share."""
    lists = F.sort_array(F.collect_set(F.struct(F.col("i").cast("long").alias("p"), "edge", "at", "end")))
    by_text = found.groupBy("uid").agg(lists.alias("x")).select("uid", "x.p", "x.edge", "x.at", "x.end")
    strings = Stage(by_text.mapInArrow(_placed_string, "uid long, c array<long>, at array<long>, end array<long>"), "strings")
    depth = depth_for(found.agg(F.max("whole")).first()[0] or 1)
    schema = ", ".join([*(f"{f} long" for f in FIELDS), "at long", "letters array<long>", "ends array<long>"])
    with scratch():
        rows = Stage(_with_ranks(strings.df, depth).mapInArrow(_lettered, schema), "suffixes").keep()
    strings.drop()
    ordered, cuts = _bucketed(rows.df, ("at", "letters", "ends"))
    shared = ordered.mapInArrow(_neighbours(cuts), "uid long, i int, lo long, hi long")
    shared = Stage(shared.groupBy("uid", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "neighbours").df
    rows.drop()
    anchors = found.join(shared.select("uid", "i"), ["uid", "i"], "left_semi").withColumn("cls", F.col("edge"))
    return anchors, shared.where(F.col("hi") - F.col("lo") >= window).select("uid", "lo", "hi")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, spans) of the bytes of each text that a string of ``window`` bytes that starts elsewhere too covers."""
    return spans.repeated(docs, SHAPE if window == WINDOW else shape_for(window), _order)


def _cut(text: bytes | None, runs: np.ndarray) -> tuple:
    text = text or b""
    keep, at = [], 0
    for lo, hi in runs:
        keep.append(text[at:lo])
        at = hi
    keep.append(text[at:])
    return b"".join(keep), len(text), int((runs[:, 1] - runs[:, 0]).sum()), [{"lo": int(a), "hi": int(b)} for a, b in runs]


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row's doc_id with kept (binary: what is left of the UTF-8 bytes), n_bytes, n_removed and removed (spans).

    A byte goes if a string of ``window`` bytes that covers it starts at another place too, in the same text or another;
    strings are judged on the input, and end with their text.  Null texts are empty; texts shorter than a window are kept;
    repeated rows, also of one doc_id, repeat each other; a null doc_id is a document like any other; an empty table
    gives no rows; further columns are ignored.
    """
    out = spans.apply_runs(docs.select("doc_id", "text"), repeated_spans(docs, window), _cut, "kept binary, n_bytes long, n_removed long, removed array<struct<lo:long,hi:long>>")
    return out.drop("text")
