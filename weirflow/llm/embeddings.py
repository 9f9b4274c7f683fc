"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated vectors make balanced binary codes.  Codes are
cut into words, one hash table a word; a vector looks into the buckets within one bit of its own word in each table.
Pairs whose whole codes are near are ranked again by the cosine of the original vectors in double precision.

Only vectors of one label and one width can link, so each such group stands for itself, and a width has a rotation of its
own.  Groups of all sizes go through the tables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLOCK_ROWS, Forest, Stage, connected_components, group_runs, in_blocks

CODE_BITS = 64
WORD_BITS = 16
TABLES = CODE_BITS // WORD_BITS


def unit_rows(v: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows as unit vectors, which rows are usable): null, zero, partly null or non-finite rows and those of another width are not."""
    rows = v.to_pylist()
    ok = np.array([r is not None and len(r) == width and None not in r for r in rows], bool)
    x = np.zeros((len(rows), width))
    if ok.any():
        x[ok] = np.array([r for r, o in zip(rows, ok) if o], float)
    ok &= np.isfinite(x).all(axis=1)
    x[~ok] = 0
    with np.errstate(over="ignore"):
        top = np.abs(x).max(axis=1, keepdims=True)
        x = np.divide(x, top, out=np.zeros_like(x), where=top > 0)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
    ok &= norm[:, 0] > 0
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), ok


def learn_rotation(sample: np.ndarray, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation: principal axes, then alternating signs and best rotation.

    The axes are those about the origin, not about the mean: planes through it seldom part vectors of a small angle, even
    where all vectors point one way.
    """
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    if len(sample) < 2:
        return np.zeros(dims), np.linalg.qr(rng.normal(size=(max(dims, CODE_BITS),) * 2))[0][:dims, :CODE_BITS]
    mean = np.zeros(dims)
    values, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, np.argsort(-values)][:, :CODE_BITS]
    v = sample @ axes
    k = v.shape[1]
    r = np.linalg.qr(rng.normal(size=(k, k)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    out = axes @ r
    if k < CODE_BITS:  # fewer axes than bits: random directions fill the rest
        out = np.hstack([out, rng.normal(size=(dims, CODE_BITS - k))])
    return mean, out


def rotation_of(width: int, fitted: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of a width: the fitted one, or random directions for a width that the sample lacks."""
    if width not in fitted:
        fitted[width] = learn_rotation(np.zeros((0, width)))
    return fitted[width]


def _codes(fitted: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(id, code, label, width) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes[sizes > 0]).tolist():
                some = b.take(pa.array(np.flatnonzero(sizes == width)))
                mean, projection = rotation_of(width, fitted)
                x, ok = unit_rows(some.column(1), width)
                keep = np.flatnonzero(ok)
                bits = (x[keep] - mean) @ projection >= 0 if len(keep) else np.zeros((0, CODE_BITS), bool)
                code = np.packbits(bits, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64).reshape(-1)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(keep)), pa.array(code.view(np.int64)), some.column(2).take(pa.array(keep)), pa.array(np.full(len(keep), width, np.int32))], ["id", "code", "label", "width"])

    return run


def buckets(codes: DataFrame) -> DataFrame:
    """(bucket, t, id, code, home): a vector's own bucket in each table and, not as home, those one bit away.

    A bucket is a hash; vectors of two groups that share one by chance are told apart when they are compared.
    """
    mask = (1 << WORD_BITS) - 1
    flips = F.array(*[F.lit(f).cast("long") for f in [0, *(1 << j for j in range(WORD_BITS))]])

    def probes(t: int) -> Column:
        word = F.shiftrightunsigned("code", t * WORD_BITS).bitwiseAND(F.lit(mask))
        return F.transform(flips, lambda f: F.struct(F.lit(t).alias("t"), word.bitwiseXOR(f).alias("word"), (f == 0).alias("home")))

    every = codes.select("label", "width", "id", "code", F.explode(F.concat(*map(probes, range(TABLES)))).alias("p"))
    return every.select(F.xxhash64("label", "width", "p.t", "p.word").alias("bucket"), "p.t", "id", "code", "p.home")


def _words_near(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) >> np.uint64(t * WORD_BITS) & np.uint64((1 << WORD_BITS) - 1)) <= 1


def _candidates(radius: int):
    """Members of a block with a partner whose whole code is within ``radius``, met here first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, starts in group_runs(batches, ["bucket", "t", "hb", "cb"]):
            code, ident = tab["code"].to_numpy().view(np.uint64), tab["id"].to_numpy()
            home, other = tab["as_home"].to_numpy(zero_copy_only=False), tab["as_other"].to_numpy(zero_copy_only=False)
            t, ends = tab["t"].to_numpy(), np.append(starts[1:], len(code))
            keep = np.zeros(len(code), bool)
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                h, o = s + np.flatnonzero(home[s:e]), s + np.flatnonzero(other[s:e])
                if not len(h) or not len(o):
                    continue
                for i in range(0, len(h), 256):
                    near = np.bitwise_count(code[h[i : i + 256], None] ^ code[None, o]) <= radius
                    near &= ident[h[i : i + 256], None] != ident[None, o]
                    keep[h[i : i + 256]] |= near.any(axis=1)
                    keep[o] |= near.any(axis=0)
            yield pa.RecordBatch.from_pydict({n: tab[n].combine_chunks().filter(pa.array(keep)) for n in ("bucket", "hb", "cb", "t", "id", "code", "as_home", "as_other")})

    return run


def _rank(cosine: float):
    """Counts of links of each home of a block, and a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, starts in group_runs(batches, ["bucket", "t", "hb", "cb"]):
            code, ident, weight = tab["code"].to_numpy().view(np.uint64), tab["id"].to_numpy(), tab["weight"].to_numpy()
            home, other = tab["as_home"].to_numpy(zero_copy_only=False), tab["as_other"].to_numpy(zero_copy_only=False)
            t = tab["t"].to_numpy()
            rows, label = tab["embedding"].combine_chunks(), tab["label"].to_numpy()
            sizes = pc.list_value_length(rows).to_numpy()
            out: list[tuple] = []
            for s, e in zip(starts, np.append(starts[1:], len(code))):
                h, o = s + np.flatnonzero(home[s:e]), s + np.flatnonzero(other[s:e])
                width = int(sizes[s:e].max())
                x, _ = unit_rows(rows.slice(s, e - s), width)
                forest, count = Forest(e - s), np.zeros(e - s, np.int64)
                for i in range(0, len(h), 256):
                    part = h[i : i + 256]
                    link = (x[part - s] @ x[o - s].T >= cosine) & (ident[part, None] != ident[None, o])
                    link &= (label[part, None] == label[None, o]) & (sizes[part, None] == sizes[None, o])
                    link &= _words_near(code[part, None], code[None, o], t[s])
                    for earlier in range(t[s]):  # a pair counts in the first table that it meets in
                        link &= ~_words_near(code[part, None], code[None, o], earlier)
                    count[part - s] += link @ weight[o]
                    for row in np.flatnonzero(link.any(axis=1)):
                        for y in o[link[row]] - s:
                            forest.join(int(part[row] - s), int(y))
                root = ident[s + np.array([forest.find(k) for k in range(e - s)])]
                busy = (count > 0) | (root != ident[s:e])
                out.append((ident[s:e][busy], root[busy], count[busy]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, radius: int = 18, sample: int = 20_000, block: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have one width, and their cosine, in double precision, is at
    least ``cosine``.  Null, empty, zero, partly null or non-finite vectors link with nothing: they are components of their
    own.  Equal vectors of a label are one point with a weight.  A row with a null vec_id has a null component of its own
    and counts as a partner of no one.  Rows that repeat a vec_id with the same vector and label count once as a partner
    and are each returned.  The rotations are fitted, one a width, on at most ``sample`` vectors, chosen by the hash of
    vec_id; every vector is indexed.  Pairs that share a word within one bit are candidates, in groups of any size;
    ``radius`` bounds the Hamming distance of their whole codes (pairs at the threshold differ in 4 of 64 bits on average).
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("long"))
    named = rows.where("vec_id is not null")
    drawn = named.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    by_width = defaultdict(list)
    for v in drawn:
        by_width[len(v)].append([None if c is None else float(c) for c in v])
    units = {w: unit_rows(pa.array(some, pa.list_(pa.float64())), w) for w, some in by_width.items() if w}
    # a rotation takes more vectors than it has bits; with less the widths get random directions
    fitted = {w: learn_rotation(x[ok] if ok.sum() > CODE_BITS else x[:0]) for w, (x, ok) in units.items()}
    points = named.where("label is not null and embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("weight"))
    points = Stage(points, "vectors").df
    codes = points.select("id", "embedding", "label").mapInArrow(_codes(fitted), "id long, code long, label long, width int")
    found = in_blocks(buckets(codes), ["bucket", "t"], "id", "home", block)
    found = found.repartition("bucket", "t", "hb", "cb").sortWithinPartitions("bucket", "t", "hb", "cb")
    schema = "bucket long, hb int, cb int, t int, id long, code long, as_home boolean, as_other boolean"
    found = Stage(found.select("bucket", "hb", "cb", "t", "id", "code", "as_home", "as_other").mapInArrow(_candidates(radius), schema), "candidates")
    ranked = found.df.join(points.select("id", "embedding", "weight", "label"), "id").repartition("bucket", "t", "hb", "cb").sortWithinPartitions("bucket", "t", "hb", "cb")
    links = Stage(ranked.mapInArrow(_rank(cosine), "a long, b long, n long"), "links")
    roots = connected_components(links.df.select("a", "b"))
    counts = links.df.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    state = points.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    usable = codes.select("id").withColumn("usable", F.lit(True))
    state = Stage(state.join(usable, "id", "left").where("usable").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "id").alias("root")), "vector-classes").df
    keyed = rows.withColumn("known", F.col("vec_id").isNotNull())
    out = keyed.join(state.withColumn("known", F.lit(True)), ["label", "embedding", "known"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
