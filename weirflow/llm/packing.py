"""Packing by lexical retrieval: BM25 neighbours fill each seed document's window.

The corpus is indexed in shards that are chosen by content.  Each document gets a sort key of terms drawn by weighted
minimum hashing: two documents draw the same term as often as their terms, weighted by their inverse document frequency
in the whole corpus, overlap.  In the order of these keys, documents that share rare terms stand together; a shard is a
run of that order and has an inverted index of its own, with postings by term and the corpus's frequencies.

The first unused document of a shard is the seed of a window; the unused documents that BM25 ranks highest for it follow,
the last one cut where the window is full; what is cut off stays unused and keeps its place in the index.  Every window but
a shard's last is full; that one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import Stage

WINDOW = 1024
#: A shard ends at this many documents or ids, whichever comes first (a longer document is a shard of its own).
SHARD_DOCS = 1024
SHARD_IDS = 1 << 21
#: Terms in a document's sort key.
KEYS = 4
K1, B = 1.2, 0.75
#: Neighbours that are ranked at first; more only if they don't fill the window.
RANKED = 16


class Statistics:
    """What BM25 takes from the whole corpus: documents, mean length, and the inverse document frequency of each id.

    Ids in one document only, or in more than half of all, have none: they help no ranking and count as zero.
    """

    def __init__(self, docs: int, ids: int, frequency: dict[int, int]):
        df = np.zeros(max(frequency, default=0) + 1)
        df[list(frequency)] = list(frequency.values())
        self.mean = max(1.0, ids / max(1, docs))
        self.idf = np.where((df >= 2) & (df <= docs / 2), np.log((docs - df + 0.5) / (df + 0.5) + 1e-12), 0).astype(np.float32)
        # the draws of the sort key: the id with the smallest exponential variate, its rate the idf
        draws = np.random.default_rng(5).exponential(size=(KEYS, len(df)))
        self.draws = np.divide(draws, self.idf, out=np.full_like(draws, np.inf), where=self.idf > 0)

    def key(self, ids: np.ndarray) -> np.ndarray:
        """The terms that a document draws; -1 where none of its ids has a weight."""
        own = self.draws[:, np.minimum(ids, len(self.idf) - 1)]
        at = own.argmin(axis=1)
        return np.where(np.isfinite(own[np.arange(KEYS), at]), ids[at].astype(np.int64), -1)


def statistics(docs: list[np.ndarray]) -> Statistics:
    """The statistics of documents at hand."""
    ids, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True) if docs else (np.zeros(0, int),) * 2
    return Statistics(len(docs), sum(map(len, docs)), dict(zip(ids.tolist(), df.tolist())))


class Index:
    """The inverted index of a shard: for each term the documents that have it, with their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], s: Statistics):
        size = np.array([len(d) for d in docs], np.int64)
        owner, ids = np.repeat(np.arange(len(docs)), size), np.concatenate(docs).astype(np.int64)
        weighty = s.idf[np.minimum(ids, len(s.idf) - 1)] > 0
        pair, tf = np.unique(owner[weighty] << 32 | ids[weighty], return_counts=True)
        doc, term = pair >> 32, pair & 0xFFFFFFFF
        norm = K1 * (1 - B + B * size / s.mean)
        self.terms_at = np.searchsorted(doc, np.arange(len(docs) + 1))  # the terms of each document, as queries
        _, self.term = np.unique(term, return_inverse=True)
        order = np.argsort(self.term, kind="stable")
        self.n = len(docs)
        self._post(self.term[order], doc[order], s.idf[term[order]] * tf[order] * (K1 + 1) / (tf[order] + norm[doc[order]]))

    def _post(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.postings = term, doc, weight
        self.first = np.searchsorted(term, np.arange(int(self.term.max(initial=-1)) + 2))

    def forget(self, used: np.ndarray) -> None:
        """Drops the postings of used documents."""
        keep = ~used[self.postings[1]]
        self._post(*(x[keep] for x in self.postings))

    def scores(self, query: int) -> np.ndarray:
        """BM25 of all documents for the terms of one."""
        t = self.term[self.terms_at[query] : self.terms_at[query + 1]]
        begin, count = self.first[t], self.first[t + 1] - self.first[t]
        ends = np.cumsum(count)
        at = np.repeat(begin - (ends - count), count)
        at += np.arange(len(at))
        return np.bincount(self.postings[1].take(at), self.postings[2].take(at), self.n)


def ranking(scores: np.ndarray, unused: np.ndarray) -> Iterator[int]:
    """The unused documents, the highest score first, of ties the first."""
    left = np.flatnonzero(unused)
    if len(left) > RANKED:
        own = scores[left]
        least = np.partition(own, len(own) - RANKED)[-RANKED]
        top = left[own >= least]
        yield from top[np.lexsort((top, -scores[top]))].tolist()
        left = left[own < least]
    yield from left[np.lexsort((left, -scores[left]))].tolist()


def pack_shard(docs: list[np.ndarray], stats: Statistics | None = None, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); each id of each document lies in exactly one piece."""
    index = Index(docs, stats or statistics(docs))
    size = np.array([len(d) for d in docs])
    at, unused = np.zeros(len(docs), np.int64), size > 0
    out: list[list[tuple[int, int, int]]] = []
    live = len(docs)
    for seed in range(len(docs)):
        while size[seed] - at[seed] >= window:
            out.append([(seed, int(at[seed]), window)])
            at[seed] += window
        unused[seed] = False
        if at[seed] == size[seed]:
            continue
        row, room = [(seed, int(at[seed]), int(size[seed] - at[seed]))], window - int(size[seed] - at[seed])
        at[seed] = size[seed]
        if 8 * unused.sum() < 7 * live:
            live = int(unused.sum())
            index.forget(~unused)
        for d in ranking(index.scores(seed), unused):
            # a long neighbour gives its odd ids first, so that what is left of it still fills whole windows
            n = min(room, int(size[d] - at[d]) % window or window)
            row.append((d, int(at[d]), n))
            at[d] += n
            room -= n
            unused[d] = at[d] < size[d]
            if not room:
                break
        if room:
            out.extend(_powers(row))
        else:
            out.append(row)
    return out


def _powers(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short window cut into windows whose sizes are powers of two."""
    total, out, rest = sum(n for _, _, n in row), [], list(row)
    for bit in reversed(range(total.bit_length())):
        need = total & 1 << bit
        part = []
        while need:
            d, s, n = rest.pop(0)
            part.append((d, s, min(n, need)))
            if n > need:
                rest.insert(0, (d, s + need, n - need))
            need -= min(n, need)
        if part:
            out.append(part)
    return out


def _partition() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, place, ids binary): a row for each document, its ids in the vocabulary's smallest type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, kind = _partition() << 36, tokens.id_type(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = b.column(1).slice(i, 256).to_pylist()
                ids = [np.array([*tokens.encode(t or "", path), end_id], kind).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array(np.arange(place, place + len(ids))), pa.array(ids, pa.binary())], ["doc_id", "place", "ids"])
                place += len(ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, place long, ids binary")


def corpus_statistics(rows: DataFrame, path: str) -> Statistics:
    """Of ``rows`` (ids).  What reaches the driver is one number for each id of the vocabulary, however many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokens.id_type(path)
        df = np.zeros(np.iinfo(kind).max + 1 if kind == np.uint16 else 0, np.int64)
        docs = total = 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                own = np.unique(ids := np.frombuffer(raw, kind))
                if own[-1] >= len(df):
                    df = np.append(df, np.zeros(int(own[-1]) + 1 - len(df), np.int64))
                df[own] += 1
                docs, total = docs + 1, total + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], some)), pa.array(np.append([docs, total], df[some]))], ["id", "n"])

    found = {r["id"]: r["n"] for r in rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    return Statistics(found.pop(-2, 0), found.pop(-1, 0), found)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = 0, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text followed by ``end_id``; a null or empty text has ``end_id`` alone.
    Null doc_ids and repeated rows are documents like any other; an empty table gives no rows; other columns are ignored.
    Equal keys are told apart by the rows' places, so that any number of copies is dealt out over many shards.
    A sequence_id holds the partition above bit 36 and counts on within it, so a task that is run again gives the same ids.
    """
    path = vocabulary or tokens.vocabulary_path("byte_bpe_50k.json")
    rows = Stage(tokenized(docs, path, end_id), "tokens").df
    stats = corpus_statistics(rows, path)
    shared = rows.sparkSession.sparkContext.broadcast(stats)  # a few numbers for each id of the vocabulary
    keys = [f"k{i}" for i in range(KEYS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokens.id_type(path)
        for b in batches:
            drawn = np.array([shared.value.key(np.frombuffer(raw, kind)) for raw in b.column(2).to_pylist()], np.int64).reshape(-1, KEYS)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(drawn[:, i])) for i in range(KEYS))], [*b.schema.names, *keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, kind = _partition() << 36, tokens.id_type(path)
        ids: list = []
        held: list[np.ndarray] = []
        total = 0
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(raw, kind)
                if held and (len(held) >= shard_docs or total + len(own) > shard_ids):
                    out, sequence = _rows(ids, held, pack_shard(held, shared.value, window), sequence)
                    yield out
                    ids, held, total = [], [], 0
                ids.append(doc_id)
                held.append(own)
                total += len(own)
        if held:
            yield _rows(ids, held, pack_shard(held, shared.value, window), sequence)[0]

    order = rows.mapInArrow(keyed, "doc_id long, place long, ids binary, " + ", ".join(f"{k} long" for k in keys)).repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return order.select("doc_id", "ids").mapInArrow(run, schema)


def _rows(ids: list, docs: list[np.ndarray], windows: list, sequence: int) -> tuple[pa.RecordBatch, int]:
    cols: list[list] = [[] for _ in range(7)]
    for row in windows:
        offset = 0
        for d, s, n in row:
            for c, v in zip(cols, (ids[d], s, n, docs[d][s : s + n].astype("<u4").tobytes(), len(docs[d]), sequence, offset)):
                c.append(v)
            offset += n
        sequence += 1
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names), sequence
