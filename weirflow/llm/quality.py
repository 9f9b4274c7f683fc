"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned filters slide over each chunk, their
responses are max-pooled over the chunk, and the means and maxima over chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 6
CHUNK = 512
FILTERS = 16
#: Bounds of the fitting sample: labelled rows, and bytes of a row that may be drawn into it.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 65_536
THRESHOLD = 0.3


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS): what each byte at each place adds to each filter
    bias: np.ndarray  # (FILTERS,)
    weight: np.ndarray  # (2 * FILTERS,): of the means and the maxima over chunks
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(self, texts)[0] @ self.weight + self.offset, -60, 60)))


def chunks(text: bytes) -> np.ndarray:
    """Rows of CHUNK bytes; neighbours overlap by WIDTH - 1 at least and all bytes are covered.  Short texts: zero bytes follow."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= CHUNK:
        row = np.zeros((1, CHUNK), np.uint8)
        row[0, : len(raw)] = raw
        return row
    starts = np.append(np.arange(0, len(raw) - CHUNK, CHUNK - WIDTH + 1), len(raw) - CHUNK)
    return raw[starts[:, None] + np.arange(CHUNK)]


def features(net: Network, texts: list[bytes], where: bool = False) -> tuple[np.ndarray, list]:
    """Means and maxima over chunks of the pooled responses of each text; with ``where``, also where the maxima stood."""
    out, trace = np.zeros((len(texts), 2 * FILTERS), np.float32), []
    group: list[np.ndarray] = []
    held = first = 0
    for i, text in enumerate(texts):
        rows = chunks(text)
        if len(rows) > 256:  # a very long text: by itself, in parts
            if group:
                _pool(net, group, out, first, trace, where)
                group, held = [], 0
            parts = [_responses(net, rows[k : k + 128], where) for k in range(0, len(rows), 128)]
            best = np.concatenate([p[0] for p in parts])
            out[i] = np.concatenate([best.mean(axis=0), best.max(axis=0)])
            trace.append((rows, best, np.concatenate([p[1] for p in parts]) if where else None))
            first = i + 1
            continue
        if not group:
            first = i
        group.append(rows)
        held += len(rows)
        if held >= 64:
            _pool(net, group, out, first, trace, where)
            group, held = [], 0
    if group:
        _pool(net, group, out, first, trace, where)
    return out, trace


def _pool(net: Network, group: list[np.ndarray], out: np.ndarray, first: int, trace: list, where: bool) -> None:
    best, at = _responses(net, np.concatenate(group), where)
    k = 0
    for i, rows in enumerate(group, first):
        part = best[k : k + len(rows)]
        out[i, :FILTERS], out[i, FILTERS:] = part.mean(axis=0), part.max(axis=0)
        if where:
            trace.append((rows, part, at[k : k + len(rows)]))
        k += len(rows)


def _responses(net: Network, rows: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
    places = CHUNK - WIDTH + 1
    best = np.empty((len(rows), FILTERS), np.float32)
    at = np.empty((len(rows), FILTERS), np.int64) if where else None
    for k in range(0, len(rows), 32):
        part = rows[k : k + 32]
        total = net.table[0].take(part[:, :places], axis=0)
        for j in range(1, WIDTH):
            total += net.table[j].take(part[:, j : j + places], axis=0)
        if where:
            at[k : k + 32] = total.argmax(axis=1)
        best[k : k + 32] = total.max(axis=1)
    return np.maximum(best + net.bias, 0), at


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the log loss; a gradient flows to the bytes under each maximum only."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    if not len(texts):
        return net
    y = np.asarray(labels, np.float32)
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    net.offset = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():  # one class: nothing to tell apart
        net.weight[:] = 0
        return net
    params = [net.table, net.bias, net.weight, np.array([net.offset], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            take = order[s : s + batch]
            net.offset = float(params[3][0])
            x, trace = features(net, [texts[i] for i in take], True)
            p = 1 / (1 + np.exp(-np.clip(x @ net.weight + net.offset, -30, 30)))
            g = (p - y[take]) / len(take)
            grads = [np.zeros_like(q) for q in params]
            grads[2][:] = x.T @ g
            grads[3][0] = g.sum()
            for i, (rows, best, at) in enumerate(trace):
                d = np.repeat((g[i] * net.weight[None, :FILTERS] / len(rows)).astype(np.float32), len(rows), axis=0)
                d[best.argmax(axis=0), np.arange(FILTERS)] += g[i] * net.weight[FILTERS:]
                d *= best > 0
                grads[1] += d.sum(axis=0)
                r = np.arange(len(rows))[:, None]
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (rows[r, at + j], np.arange(FILTERS)[None, :]), d)
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for q, dq, m, v in zip(params, grads, first, second):
                m += 0.1 * (dq - m)
                v += 0.001 * (dq * dq - v)
                q -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.table[:, 0, :] = 0  # the filler of short texts adds nothing
    net.offset = float(params[3][0])
    return net


def held_out(doc_id):
    """Column: whether a row is kept from fitting."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 3) -> Network:
    """A network fitted on at most ``rows`` labelled rows that aren't held out, chosen by the hash of their doc_id.

    Rows with a null label or doc_id are not used, nor are texts of over SAMPLE_BYTES bytes.  The doc_ids are drawn first,
    from the labels alone; only those, ``rows`` at most, are sent to where the documents are read.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out("doc_id"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    if not ids:
        return fit([], np.zeros(0))
    chosen = docs.sparkSession.createDataFrame(ids, known.schema)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    drawn = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "quality").toPandas().sort_values("doc_id")
    return fit([t.encode() for t in drawn["text"]], (drawn["quality"] == 1).to_numpy(), seed=seed)


def score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (an input column of that name replaced), double: the whole text's probability of label 1.

    Null and empty texts have the score of no text, very long ones are read whole, equal texts score the same, repeated
    rows are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            scores = [shared.value.scores([t or b"" for t in texts.slice(i, 500).to_pylist()]) for i in range(0, b.num_rows, 500)]
            score_col = pa.array(np.concatenate(scores).astype(float) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], score_col], names=[*b.schema.names[1:], name])

    text = F.col("text").cast("string").alias("text__score")
    kept = [c for c in docs.columns if c != name]
    names = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(text, *kept).mapInArrow(run, f"{names}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1 if the score reaches ``threshold``).

    A null doc_id is held out.  Without labelled rows every score is near one half of the prior; an empty table gives none.
    """
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, rows))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``, all columns as they are, without the documents that the network rejects.

    A document stays if its score reaches ``threshold``: nulls and empty texts by the score of no text, equal texts alike,
    repeated rows each; an empty table gives no rows.
    """
    return score(docs, learn(docs, labels, rows), "score__quality").where(F.col("score__quality") >= threshold).select(*docs.columns)


def frame_scores(net: Network, texts: pd.Series) -> pd.Series:
    return pd.Series(net.scores([("" if t is None else t).encode() for t in texts]))
