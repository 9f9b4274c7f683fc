"""Unigram segmentation over the pieces of a SentencePiece model: token counts by a trie, ids by streaming Viterbi.

Of all ways to cut a text into pieces the one with the largest sum of scores wins; equal sums go to fewer pieces, then to
the longer last piece.  A character in no piece costs more than any piece and becomes its UTF-8 bytes.  Pieces hold a
space mark only in front and never a line end, so all paths meet where ``SEGMENT`` cuts: the counts take what lies between
as pre-tokens, and the encoder starts new lanes there.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_slices
from .tokens import vocabulary_path

MARK = "▁"
SEGMENT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: The same, cut before a stop that follows a letter too; right where no piece has such a pair.
LETTER, STOP = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:"
_GO_ON = f"(?:[^{MARK}\n{STOP}]|(?<![{LETTER}])[{STOP}])*"
FINE_SEGMENT = re.compile(f"\n|{MARK}+{_GO_ON}|[^{MARK}\n]{_GO_ON}")
#: Characters of a lane: the next place after so many where all paths meet starts a new one.
LANE = 160
#: Characters whose matching pieces are looked up at a time: those of some lanes, or a part of a longer one.
BLOCK = 1 << 17
#: Pre-tokens whose counts a Python worker remembers in each of two generations.
MEMORY = 300_000
UNKNOWN_PENALTY = 10.0
_MUL, _FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LOW, _FEW = np.uint64((1 << 20) - 1), np.uint64((1 << 17) - 1)
_MANY = np.iinfo(np.int32).max


@dataclass
class Pieces:
    """The vocabulary: pieces with id and score, byte ids, and sorted piece hashes for each length."""

    ids: dict[str, int]
    score: dict[str, float]
    byte_ids: list[int]
    unknown: float
    longest: int
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    names: list[str]
    raw: np.ndarray  # the bytes of all pieces, marks as spaces, and where each begins and how long it is
    raw_start: np.ndarray
    raw_size: np.ndarray
    segment: re.Pattern
    maybe: list[np.ndarray]  # for each length, which low bits some hash has
    slots: list[list[np.ndarray]]  # for each length, tables of places in by_length by the low bits of a hash, -1: none


@functools.cache
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    byte_of = {i: int(names[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
    ids = {names[i]: i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    score = {p: model.get_score(i) for p, i in ids.items()}
    if any(MARK in p.lstrip(MARK) or "\n" in p or (p.startswith(MARK * 2) and p.strip(MARK)) for p in ids):
        raise ValueError("a piece crosses segments")
    by_length = []
    for k in range(1, max(map(len, ids)) + 1):
        own = [p for p in ids if len(p) == k]
        h = _hash_of_ends(_mixed(_codes("".join(own))), np.arange(1, len(own) + 1) * k - 1, k)
        o = np.argsort(h)
        by_length.append((h[o], np.array([score[p] for p in own])[o], np.array([ids[p] for p in own], np.int32)[o]))
    pair = re.compile(f"[{LETTER}][{STOP}]")
    raw = [bytes((byte_of[i],)) if i in byte_of else names[i].replace(MARK, " ").encode() for i in range(n)]
    size = np.array([len(r) for r in raw])
    bytes_first = [i for _, i in sorted((b, i) for i, b in byte_of.items())]
    return Pieces(ids, score, bytes_first, min(score.values()) - UNKNOWN_PENALTY, len(by_length), by_length, names, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, SEGMENT if any(pair.search(p) for p in ids) else FINE_SEGMENT, [_seen(h) for h, _, _ in by_length], [_tables(h) for h, _, _ in by_length])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mixed(codes: np.ndarray) -> np.ndarray:
    out = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_MUL)
    return out ^ (out >> np.uint64(32))


def _step(k: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, k - 1, 1 << 64))


def _hash_of_ends(mixed: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k characters that end at each of the places ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j in range(1, k + 1):
        out += mixed[at - (j - 1)] * _step(j)
    return out


def _seen(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(int(_FEW) + 1, bool)
    out[hashes & _FEW] = True
    return out


def _tables(hashes: np.ndarray) -> list[np.ndarray]:
    """Tables that hold each hash in its slot, a further one where hashes share a slot."""
    out, left = [], np.arange(len(hashes))
    while len(left):
        table = np.full(int(_LOW) + 1, -1, np.int32)
        table[hashes[left] & _LOW] = left
        out.append(table)
        left = left[table[hashes[left] & _LOW] != left]
    return out


def _find(v: Pieces, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are those of pieces of k characters, their places in ``by_length``)."""
    maybe = np.flatnonzero(v.maybe[k - 1][h & _FEW])
    h = h[maybe]
    low, known, found = h & _LOW, v.by_length[k - 1][0], [(maybe[:0], maybe[:0])]
    for table in v.slots[k - 1]:
        place = table[low]
        hit = (place >= 0) & (known[place] == h)
        found.append((maybe[hit], place[hit]))
    return tuple(map(np.concatenate, zip(*found)))


def _matches(v: Pieces, mixed: np.ndarray, lo: int, hi: int, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest, n): score (minus infinity: no piece) and id of the piece that ends at each place; the longest in row 0.

    The places are lo to hi, after ``longest`` more in front of ``mixed``; the i-th one's column is ``column[i]``.  Pieces
    that would begin before a lane are found too; no path reaches where they begin.
    """
    score, ident = np.full((v.longest, hi - lo), -np.inf, np.float32), np.full((v.longest, hi - lo), -1, np.int32)
    h = np.zeros(hi - lo, np.uint64)
    for k in range(1, v.longest + 1):
        h += mixed[lo + v.longest - k + 1 : hi + v.longest - k + 1] * _step(k)
        found, place = _find(v, k, h)
        to = column[found]
        score[-k, to], ident[-k, to] = v.by_length[k - 1][1][place], v.by_length[k - 1][2][place]
    score[-1, ident[-1] < 0] = v.unknown
    return score, ident


class StreamingViterbi:
    """Takes lanes of text, many at once, a character at a time and gives ids as soon as they are certain.

    Scores are kept for the last ``longest`` places of a lane only, since no later piece can start before them.  Now and
    then the backpointer paths of all of those places are followed back; where they have met in one boundary, the pieces
    before it are committed and never looked at again.  A lane whose paths don't meet is asked again after twice as long,
    so that following them takes time in proportion to the text.
    """

    def __init__(self, v: Pieces, codes: np.ndarray, starts: np.ndarray):
        """``starts``: where each lane of ``codes`` begins, ascending; none is empty."""
        self.v, self.starts, self.length = v, starts, np.diff(np.append(starts, len(codes)))
        self.mixed = np.append(np.zeros(v.longest, np.uint64), _mixed(codes))
        self.back = np.zeros(len(codes), np.int8)  # length of the best piece that ends at a place
        self.ident = np.zeros(len(codes), np.int32)
        self.on_path = np.zeros(len(codes), bool)  # where committed pieces end
        self.base = np.zeros(len(starts), np.int64)  # what is committed of each lane
        self.ask = np.full(len(starts), 2 * v.longest)
        self.most_open = 0  # the longest stretch that a commit had to look at

    def run(self) -> None:
        """Decides all lanes; afterwards ``on_path`` and ``ident`` hold the result."""
        first = 0
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.starts + self.length, self.starts[first] + BLOCK, "right")))
            lanes = np.arange(first, last)
            self._run(lanes[np.argsort(-self.length[lanes], kind="stable")])  # those that go on are always the first ones
            first = last

    def _run(self, lanes: np.ndarray) -> None:
        k, rows, starts, length = self.v.longest, 8 * self.v.longest, self.starts[lanes], self.length[lanes]
        score, pieces = np.full((rows, len(lanes)), -np.inf), np.zeros((rows, len(lanes)), np.int32)
        score[k - 1] = 0
        steps = int(length[0])
        every = np.arange(len(lanes))
        row = k
        for t0 in range(0, steps, BLOCK):  # more than one round only for a lane that is longer than a block
            t1 = min(steps, t0 + BLOCK)
            counts = len(lanes) - np.searchsorted(length[::-1], np.arange(t0, t1), "right")  # lanes longer than t
            begins = np.cumsum(counts) - counts  # columns: step by step, in each step lane by lane
            lo = int(starts.min()) + t0
            hi = lo + int(counts.sum())
            text_order = np.argsort(starts)
            size = np.minimum(length, t1)[text_order] - t0
            step = np.arange(hi - lo) - np.repeat(np.cumsum(size) - size, size)
            column = begins[step] + np.repeat(text_order, size)
            found, ident = _matches(self.v, self.mixed, lo, hi, column)
            picks = np.zeros(hi - lo, np.int8)
            for t, (a, m) in enumerate(zip(begins.tolist(), counts.tolist()), t0):
                if row == rows:  # the window moves to the top again; scores are counted from its best one
                    self._commit(lanes[:m], t)
                    score[:k, :m] = score[-k:, :m] - score[-k:, :m].max(axis=0)
                    pieces[:k, :m] = pieces[-k:, :m] - pieces[-k:, :m].min(axis=0)
                    row = k
                new = score[row - k : row, :m] + found[:, a : a + m]
                best = new.max(axis=0)
                count = np.where(new == best, pieces[row - k : row, :m], _MANY)
                pick = count.argmin(axis=0)  # the first of ties is the longest piece
                score[row, :m], pieces[row, :m] = best, count[pick, every[:m]] + 1
                picks[a : a + m] = pick
                self.back[starts[:m] + t] = k - pick
                row += 1
            self.ident[lo:hi] = ident[picks[column], column]
        self._emit(lanes, length)

    def _commit(self, lanes: np.ndarray, t: int) -> None:
        """Commits what is certain of those of the lanes that are due after their first ``t`` characters."""
        lanes = lanes[self.ask[lanes] <= t]
        if not len(lanes):
            return
        k, every = self.v.longest, np.arange(len(lanes))
        first = self.starts[lanes]
        alive = np.ones((k + 1, len(lanes)), bool)  # ends of surviving paths, by place modulo k + 1
        alive[(t - k) % (k + 1)] = False
        count, boundary = np.full(len(lanes), k), np.full(len(lanes), t)
        p = t
        while (count > 1).any():
            go = every[alive[p % (k + 1)] & (count > 1)]
            alive[p % (k + 1), go] = False
            before = p - self.back[first[go] + p - 1].astype(np.int64)
            met = alive[before % (k + 1), go]
            alive[before % (k + 1), go] = True
            count[go[met]] -= 1
            one = met & (count[go] == 1)
            boundary[go[one]] = before[one]
            p -= 1
        still_open = t - self.base[lanes]
        self.most_open = max(self.most_open, int(still_open.max()))
        self.ask[lanes] = t + np.where(boundary > self.base[lanes], 2 * k, still_open)
        self._emit(lanes, boundary)

    def _emit(self, lanes: np.ndarray, boundary: np.ndarray) -> None:
        """Marks the ends of the pieces on the path from each boundary back to what is committed."""
        first, base, at = self.starts[lanes], self.base[lanes], boundary.copy()
        self.base[lanes] = np.maximum(base, boundary)
        while len(go := np.flatnonzero(at > base)):
            first, base, at = first[go], base[go], at[go]
            self.on_path[first + at - 1] = True
            at = at - self.back[first + at - 1]


def lane_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where lanes begin: at each text, and within one at places where all paths meet, about ``LANE`` apart."""
    mark, line = codes == ord(MARK), codes == ord("\n")
    meet = np.flatnonzero(np.append(False, (mark[1:] & ~mark[:-1]) | line[1:] | line[:-1]))
    return np.union1d(text_starts, meet[np.append(True, meet[1:] // LANE != meet[:-1] // LANE)] if len(meet) else meet)


def encode_texts(v: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and where each text's begin and end; null and empty texts have none."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    ends = np.cumsum([0, *map(len, marked)])
    codes = _codes("".join(marked))
    machine = StreamingViterbi(v, codes, lane_starts(codes, ends[:-1][np.diff(ends) > 0]))
    machine.run()
    place = np.flatnonzero(machine.on_path)
    ids = machine.ident[place]
    lost = ids < 0  # characters in no piece
    raw = codes[place[lost]].tobytes().decode("utf-32-le").encode()
    c = codes[place]
    size = np.where(lost, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 1)
    flat = np.repeat(ids, size)
    flat[flat < 0] = np.array(v.byte_ids, np.int32)[np.frombuffer(raw, np.uint8)]
    return flat, np.append(0, np.cumsum(size))[np.searchsorted(place, ends)]


def segments(text: str | None, at: re.Pattern = SEGMENT) -> list[str]:
    """The text with space marks, one before the first character, cut where all paths meet; null and empty: none."""
    return at.findall(MARK + text.replace(" ", MARK)) if text else []


def trie_counts(v: Pieces, words: list[str]) -> np.ndarray:
    """Tokens of each of ``words`` (distinct, sorted): forward scores once for each node of their trie.

    Level by level: the node of depth d that a word passes is new unless the word before it passes the same one.  A node's
    forward score comes from those of its ancestors; where a word ends, its count is stored.
    """
    codes = _codes("".join(words))
    mixed = _mixed(codes)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    out = np.zeros(len(words), np.int64)
    # of the last levels: each node's score, pieces, tokens and parent
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    word, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # the words that go on, and their nodes
    d = 0
    while len(word):
        d += 1
        char = codes[start[word] + d - 1]
        new = np.append(True, (node[1:] != node[:-1]) | (char[1:] != char[:-1]))
        at, parent, char = start[word[new]] + d - 1, node[new], char[new]
        node = np.cumsum(new) - 1
        m = len(at)
        h, found = np.zeros(m, np.uint64), []
        for k in range(1, min(v.longest, d) + 1):
            h += mixed[at - (k - 1)] * _step(k)
            which, place = _find(v, k, h)
            found.append(np.full(m, -np.inf))
            found[-1][which] = v.by_length[k - 1][1][place]
        size = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        unknown = found[0] == -np.inf
        found[0][unknown] = v.unknown
        best, pieces, tokens = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
        up = parent
        for k in range(1, len(found) + 1):
            f_score, f_pieces, f_tokens, f_parent = levels[-k]
            score, count = f_score[up] + found[k - 1], f_pieces[up] + 1
            win = (score > best) | ((score == best) & (score > -np.inf) & (count <= pieces))  # of ties the longest piece
            step = np.where(unknown, size, 1) if k == 1 else 1
            best, pieces, tokens = np.where(win, score, best), np.where(win, count, pieces), np.where(win, f_tokens[up] + step, tokens)
            up = f_parent[up]
        levels = [*levels, (best, pieces, tokens, parent)][-v.longest :]
        ends = length[word] == d
        out[word[ends]] = tokens[node[ends]]
        word, node = word[~ends], node[~ends]
    return out


class Memory:
    """What has been counted for pre-tokens.  When the young generation is full it becomes the old one, from which those
    that come again are taken back; the rest is forgotten at the next turn."""

    def __init__(self):
        self.young, self.old = {}, {}

    def know(self, texts: list[list[str]], decide) -> None:
        """Afterwards ``young`` has all pre-tokens of ``texts``: ``decide`` gets the new ones, sorted."""
        wanted = set().union(*texts)
        if len(self.young) + len(wanted) > MEMORY and self.young:
            self.young, self.old = {}, self.young
        fresh, young, old = [], self.young, self.old
        for s in wanted:
            if s not in young:
                if s in old:
                    young[s] = old[s]
                else:
                    fresh.append(s)
        fresh.sort()
        young.update(zip(fresh, decide(fresh).tolist()))


_counts: dict[str, Memory] = {}


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, n_pretokens, n_tokens of the whole text.

    Null texts count as empty: zero tokens.  Very long words go through the trie like any other.  Repeated rows are counted
    each; further columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, memory = load(path), _counts.setdefault(path, Memory())
        for part in row_slices(batches, 1):
            texts = part.column(1).to_pylist()
            cut = [segments(t, v.segment) for t in texts]
            memory.know(cut, lambda fresh: trie_counts(v, fresh))
            count = memory.young.__getitem__
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([sum(s[0] == MARK for s in c) for c in cut], pa.int64()), pa.array([sum(map(count, c)) for c in cut], pa.int64())], ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, n_pretokens long, n_tokens long")


def encode(docs: DataFrame, vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (array of int) of the whole text, and with ``decoded`` what they decode to.

    Null and empty texts have no ids, which decode to an empty text.  Repeated rows are encoded each; further columns are
    ignored; an empty table gives no rows.
    """
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    names = ["doc_id", "ids", *["text"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for part in row_slices(batches, 1, 1 << 20):
            flat, ends = encode_texts(v, part.column(1).to_pylist())
            text = [pa.array(decode_many(v, flat, ends), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), *text], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode_many(v: Pieces, flat: np.ndarray, ends: np.ndarray) -> list[str]:
    """The text of each run of ids: pieces joined, byte pieces read as UTF-8, marks as spaces, without the first space."""
    size = v.raw_size[flat]
    stop = np.append(0, np.cumsum(size))
    at = np.repeat(v.raw_start[flat] - stop[:-1], size) + np.arange(stop[-1])
    data = v.raw[at].tobytes()
    cut = stop[ends].tolist()
    return [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


def decode_ids(v: Pieces, ids: list[int]) -> str:
    return decode_many(v, np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` (ids, array of int) with a column text, an input column of that name replaced.

    Null ids have null text, no ids an empty one; byte pieces that are no UTF-8 become the replacement character.  Repeated
    rows are decoded each; an empty table gives no rows.
    """
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    kept = [c for c in encoded.columns if c != "text"]  # ids among them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for part in row_slices(batches, len(kept)):
            ids = part.column(len(kept)).to_pylist()
            text = pa.array([None if i is None else decode_ids(v, i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], names=[*kept, "text"])

    names = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.select(*kept, F.col("ids").alias("ids__decode")).mapInArrow(run, f"{names}, text string")
