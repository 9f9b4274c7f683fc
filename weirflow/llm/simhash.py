"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at 3 or fewer differing bits.  Bits 0-30 and 31-61 are two words of 31 bits; if two
fingerprints differ in at most 3 bits, they differ in at most 1 bit of one of the words.  The anchors of a word are the
codewords of the perfect [31, 26] Hamming code, whose covering radius is 1.  A fingerprint's home is the anchor within
1 of it; it is also copied to every anchor within 1 + 1 of it (16 at most), so each such pair meets at a home.  Within
an anchor the whole 64 bits are compared.  That costs at most 32 rows a distinct fingerprint, however many copies it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLOCK_ROWS, Stage, connected_components, group_runs, in_blocks

THRESHOLD = 3
WORD_BITS = 31


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """SimHash of a text in UTF-8; null or without words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    elif words_per_shingle == 3:
        shingles = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + words_per_shingle]) for i in range(len(words) - words_per_shingle + 1)]
    h = np.fromiter(map(_hash, shingles), np.uint64, len(shingles))
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long: the fingerprint's bits as a signed long), one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words_per_shingle) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def anchors(fps: DataFrame) -> DataFrame:
    """(anchor long, fp long, home boolean): where each fingerprint of ``fps`` stands, by built-in expressions."""
    low = (1 << WORD_BITS) - 1

    def places(word: int) -> Column:
        x = F.shiftrightunsigned("fp", word * WORD_BITS).bitwiseAND(F.lit(low))
        s = F.lit(0)
        for k in range(5):
            mask = sum(1 << (i - 1) for i in range(1, WORD_BITS + 1) if i >> k & 1)
            s = s + F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))) % 2 * (1 << k)
        return F.struct(F.lit(word).alias("w"), x.alias("x"), s.cast("int").alias("s"))

    def flip(i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << j).cast("long") for j in range(WORD_BITS)]), i)

    one = F.explode(F.array(places(0), places(1))).alias("p")
    at = fps.select("fp", one).select("fp", "p.*").withColumn("base", F.col("w").cast("long") * (1 << WORD_BITS))
    home = F.when(F.col("s") == 0, F.col("x")).otherwise(F.col("x").bitwiseXOR(flip(F.greatest(F.col("s"), F.lit(1)))))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(WORD_BITS)), lambda i: (i < i.bitwiseXOR(F.col("s"))) & (i != F.col("s")) & (F.col("s") != 0))
    near = F.transform(pairs, lambda i: F.struct((F.col("base") + F.col("x").bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(F.col("s"))))).alias("anchor"), F.lit(False).alias("home")))
    every = F.concat(F.array(F.struct((F.col("base") + home).alias("anchor"), F.lit(True).alias("home"))), near)
    return at.select("fp", F.explode(every).alias("e")).select("e.anchor", "fp", "e.home")


def _links(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in group_runs(batches, ["anchor", "hb", "cb"]):
            fp = t["fp"].to_numpy().view(np.uint64)
            group = np.zeros(len(fp), np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            size = np.diff(np.append(starts, len(fp)))
            a, b = [], []
            small = size[group] <= 16  # neighbours at fixed distances in the sorted rows, for all small groups at once
            for s in range(1, int(min(16, size.max()))):
                i = np.flatnonzero((group[s:] == group[:-s]) & small[s:])
                i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= threshold]
                a.append(fp[i])
                b.append(fp[i + s])
            for g in np.flatnonzero(size > 16):
                for x, y in _spanning(fp[starts[g] : starts[g] + size[g]], threshold):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    return run


def _spanning(fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among ``fp``: each fingerprint is compared only with those not reached yet."""
    rest = np.unique(fp)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                yield np.full(len(found), x), found


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, threshold: int = THRESHOLD, block: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fp (signed bits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``threshold`` (3 or fewer) differing bits.
    Null texts and texts without words have fingerprint 0 and link like any other.  Rows with a null doc_id are given
    the component of their fingerprint (null if none of its rows has a doc_id).  Repeated rows stay repeated.  An empty
    table gives an empty result; further columns are ignored.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover 3 differing bits")
    base = Stage(fingerprints(docs, words_per_shingle), "simhash")
    distinct = base.df.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    spread = distinct.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))  # each becomes many rows; by fp itself the shuffle would be merged with the one before and coalesced
    rows = in_blocks(anchors(spread), ["anchor"], "fp", "home", block).select("anchor", "hb", "cb", "fp")
    links = rows.repartition("anchor", "hb", "cb").sortWithinPartitions("anchor", "hb", "cb").mapInArrow(_links(threshold), "a long, b long")
    roots = connected_components(links)
    reps = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    reps = Stage(reps, "simhash-roots").df
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = Stage(reps.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return base.df.join(classes.df, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest doc_id.

    Of rows that share that doc_id, the one with the smallest text stays.  Rows without a doc_id can't be named as a
    group's document and stay as they are.
    """
    kept = near_duplicates(docs, **settings).where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept__id")).agg(F.count("*").alias("rows__id"))
    first = docs.join(kept, F.col("doc_id") == F.col("kept__id"))
    unique = first.where("rows__id = 1").select(*docs.columns)
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    many = first.where("rows__id > 1").withColumn("nth__", F.row_number().over(order)).where("nth__ = 1").select(*docs.columns)
    return unique.unionByName(many).unionByName(docs.where("doc_id is null"))
