"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed from left to right into phrases, each the longest phrase seen so far and one byte more.
The set of phrases stands for what a compressor would learn from the text; minimum-hash signatures of two sets estimate
how much the texts share, as compressing one after the other would.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in a signature, 16 bits each.
VALUES = 128
_MASK = (1 << 61) - 1
_rng = np.random.default_rng(20_011)
_MUL = _rng.integers(1, 1 << 62, VALUES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 62, VALUES, dtype=np.uint64)


class Phrases:
    """The phrases of a parse: a trie of (node, byte) steps and the hash of each phrase."""

    def __init__(self, steps: dict[int, int] | None = None, hashes: list[int] | None = None, at: int = 0):
        self.steps, self.hashes, self.at = steps or {}, hashes or [0], at

    def copy(self) -> Phrases:
        return Phrases(self.steps.copy(), self.hashes.copy(), self.at)

    def parse(self, text: bytes) -> Phrases:
        """Goes on with ``text``; the phrase left open at the end may be closed by a later call."""
        steps, hashes, at = self.steps, self.hashes, self.at
        get = steps.get
        for byte in text:
            after = get(at << 8 | byte)
            if after is None:
                steps[at << 8 | byte] = len(hashes)
                hashes.append((hashes[at] * 1_000_003 + byte + 1) & _MASK)
                at = 0
            else:
                at = after
        self.at = at
        return self


def signature(phrases: Phrases) -> np.ndarray:
    """VALUES minimum hashes of the phrases (one left open is among them already); of no phrases: all ones."""
    h = np.array(phrases.hashes[1:], np.uint64)
    if not len(h):
        return np.full(VALUES, 0xFFFF, np.uint16)
    h ^= h >> np.uint64(29)
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 512):
        low = np.minimum(low, (h[i : i + 512, None] * _MUL + _ADD).min(axis=0))
    low ^= low >> np.uint64(32)
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: bytes | None) -> np.ndarray:
    return signature(Phrases().parse(text or b""))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values, 0 to 1; an estimate of the phrase sets' overlap."""
    return float(np.mean(a == b))


def as_text(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal string) of each row's whole text; null is empty.  Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(fingerprint(t)) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below a value, 0 for null.

    Blocks of about sqrt(n) cuts are told apart by their last ones, so a row compares with 2 sqrt(n) of n cuts; all of them
    are two literals of the plan.
    """
    if not cuts:
        return F.lit(0)
    side = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[i : i + side] for i in range(0, len(cuts), side)]

    def literal(text: str, kind: str) -> Column:
        return F.from_json(F.lit(text), kind)  # folded into one literal

    ends = literal(json.dumps([b[-1] for b in blocks]), "array<bigint>")
    inner = literal(json.dumps(blocks), "array<array<bigint>>")
    block = F.size(F.filter(ends, lambda e: e < value))
    within = F.size(F.filter(F.coalesce(F.get(inner, block), F.array().cast("array<bigint>")), lambda e: e < value))
    return F.when(value.isNull(), 0).otherwise(F.least(block * side + within, F.lit(len(cuts))))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, doc_id, text, place) so that each bucket, sorted, holds a run of documents and then the one after them.

    Documents stand in order of doc_id (null first), then text.  place is 0 for a document of the run, 1 for the one after.
    The buckets are ranges of doc_id; only the first doc_id of each, one number a bucket, passes the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = _below(F.col("doc_id"), [int(c) for c in cuts])
    placed = rows.withColumn("bucket", bucket.cast("int"))
    first = {r["bucket"]: (r["nulls"], r["low"]) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()}
    used = sorted(first)
    after = {b: used[i - 1] for i, b in enumerate(used)}  # the bucket that a bucket's first document also ends
    heads = [(None if nulls else low, after[b], b) for b, (nulls, low) in first.items()]
    if not heads:
        return placed.withColumn("place", F.lit(0))
    lead = spark.createDataFrame(heads, "head long, ends int, own int")
    copies = placed.join(F.broadcast(lead), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("ends").alias("bucket"), F.lit(1).alias("place"))
    return placed.withColumn("place", F.lit(0)).unionByName(copies)


def edited_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, in ascending order of doc_id (null first, then by text); the first follows the last.  A single document is
    its own next.  Returns doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts are empty; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None  # document, its text, state of the parse
        over: int | None = None  # the bucket whose run has ended
        for b in batches:
            for bucket, doc_id, text, place in zip(*(c.to_pylist() for c in b.columns)):
                if bucket == over:
                    continue  # ties of the document after the run
                state = _Parsed(text)
                if held is not None:
                    out.append((held[0], *held[1].against(state)))
                held = (doc_id, state) if not place else None
                over = bucket if place else over
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    # the first document must stand after the last of its bucket: place decides before doc_id
    rows = with_next(docs, buckets).select("bucket", "doc_id", "text", "place")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "place", F.col("doc_id").asc_nulls_first(), "text")
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)


class _Parsed:
    """A text whose parse is kept where its kept three quarters end."""

    def __init__(self, text: str):
        self.text = text
        self.keep = len(text) - len(text) // 4
        self.prefix = Phrases().parse(text[: self.keep].encode())
        self.values = signature(self.prefix.copy().parse(text[self.keep :].encode()))

    def against(self, after: _Parsed) -> tuple:
        tail = after.text[: len(self.text) - self.keep]
        values = signature(self.prefix.parse(tail.encode()))
        return (len(self.text), self.text[: self.keep] + tail, as_text(self.values), as_text(values), likeness(self.values, values), likeness(self.values, after.values))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
