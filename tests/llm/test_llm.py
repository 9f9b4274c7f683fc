"""Corpus operators against brute force, on odd inputs and on the small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import debruijn, embeddings, linededup, lzfingerprint, oracles, packing, quality, queries, shared, simhash, spans, suffixarray, tokens, unigram

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, extra string, uid string"
PASSAGE = " ".join(f"word{i}" for i in range(70))
ODD = [
    (1, "a b c " + PASSAGE + " x y", "e", "u"), (2, PASSAGE + "\nz", None, "u"), (3, None, "e", None), (None, "lonely words here", None, None), (4, "", "e", "u"), (5, " \t\n ", "e", "u"),
    (6, "same text", "e", "u"), (6, "same text", "e", "u"), (7, "same text", "e", "u"), (8, "x" * 5000, "e", "u"), (9, "été 漢字 😀 \u0001 ▁ ok", "e", "u"), (10, "ab" * 900, "e", "u"), (None, PASSAGE, None, None),
    (11, "\n".join(["a longer line that repeats itself"] * 3 + ["a longer line that repeats itselF"]), "e", "u"),
]
VECTORS = "vec_id long, embedding array<float>, label int, id string, code string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def plain_cut(v, text):
    """The ids of the best way to cut, by a table over the whole text."""
    t = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, 0, 0)] + [None] * len(t)
    for j in range(1, len(t) + 1):
        for k in range(min(v.longest, j), 0, -1):
            p = t[j - k : j]
            if p in v.ids or k == 1:
                s, n, _ = best[j - k]
                new = (s + v.score.get(p, v.unknown), n + 1, k)
                if best[j] is None or new[0] > best[j][0] or (new[0] == best[j][0] and new[1] < best[j][1]):
                    best[j] = new
    out, j = [], len(t)
    while j:
        p = t[j - best[j][2] : j]
        out.append([v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()])
        j -= best[j][2]
    return [i for x in reversed(out) for i in x]


LONG = ["theconditionofthing" * 300, "ab" * 900, "x" * 4000, "\n\n a  b\n", " ▁  ", "漢字かな" * 300, "a\u0001" * 50]


def test_token_counts(spark, odd, nothing):
    v = unigram.load(tokens.vocabulary_path("piece_bpe_32k.model"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in unigram.count_tokens(odd).collect())
    assert got == Counter((d, len(plain_cut(v, t))) for d, t, *_ in ODD)
    frame = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in unigram.count_tokens(frame).collect()} == {i: len(plain_cut(v, t)) for i, t in enumerate(LONG)}
    rows = {r["doc_id"]: r for r in queries.op1_token_counts(spark, SF).collect()}
    docs = documents(spark)
    assert len(rows) == len(docs) and all(rows[d]["n_chars"] == len(t) for d, t in docs)
    for d, t in docs[::4]:
        assert rows[d]["n_tokens"] == len(plain_cut(v, t))
    assert not unigram.count_tokens(nothing).collect()


def test_codec(spark, odd, nothing):
    import sentencepiece

    path = tokens.vocabulary_path("piece_bpe_32k.model")
    v = unigram.load(path)
    coded = unigram.encode(odd, decoded=True).collect()
    assert Counter(r["text"] for r in coded) == Counter((t or "").replace("▁", " ") for _, t, *_ in ODD)
    again = unigram.decode(unigram.encode(odd)).collect()
    assert Counter(r["text"] for r in again) == Counter(r["text"] for r in coded)
    assert not unigram.encode(nothing).collect()
    texts = LONG + [t for _, t, *_ in ODD] + [t for _, t in documents(spark)[::5]]
    flat, ends = unigram.encode_texts(v, texts)
    for a, b, t in zip(ends, ends[1:], texts):
        assert flat[a:b].tolist() == plain_cut(v, t or "")
    # the same pieces in a library that searches whole texts; an appended field makes its model a unigram one
    with open(path, "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")
    words = sorted({s for _, t in documents(spark) for s in unigram.segments(t) if re.fullmatch("▁[a-z]+", s)})[:3000]

    def total(ids):
        return sum(v.score[v.names[i]] for i in ids)

    flat, ends = unigram.encode_texts(v, [w[1:] for w in words])
    mine = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
    theirs = [library.encode(w[1:]) for w in words]
    assert all(total(a) >= total(b) - 1 for a, b in zip(mine, theirs))  # never a worse way to cut, and nearly always as good
    assert np.mean([total(a) - total(b) <= 1 or total(b) < -1e8 for a, b in zip(mine, theirs)]) > 0.99


@pytest.mark.parametrize("block", [1 << 17, 1000])
def test_streaming_commits_early(block, monkeypatch):
    monkeypatch.setattr(unigram, "BLOCK", block)
    v = unigram.load(tokens.vocabulary_path("piece_bpe_32k.model"))
    codes = unigram._codes("▁" + LONG[0] + "\nshort" + "▁" + LONG[0][7:])
    starts = unigram.lane_starts(codes, np.array([0]))
    machine = unigram.StreamingViterbi(v, codes, starts)
    emitted, emit = [], machine._emit
    machine._emit = lambda lanes, boundary: (emitted.append((lanes, boundary.copy())), emit(lanes, boundary))
    machine.run()
    assert len(starts) == 2 and machine.most_open < 20 * v.longest
    early = np.concatenate([b[lanes == 0] for lanes, b in emitted[:-1]])
    assert early.max() > len(LONG[0]) - 20 * v.longest
    # one that never meets is followed only a few times
    codes = unigram._codes("x" * 4000)
    machine = unigram.StreamingViterbi(v, codes, np.array([0]))
    machine.run()
    assert machine.on_path[-1]


def test_fast_ids_are_the_slow_ones(spark):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    for t in [t for _, t in documents(spark)[:60]] + [t or "" for _, t, *_ in ODD] + ["<|endoftext|> a", "don't  \n\n\t x", "naïve  €5"]:
        assert tokens.encode(t, path) == tokens.slow_encoder(path).encode(t, add_special_tokens=False).ids


def test_packing(spark, odd, nothing):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    slow = tokens.slow_encoder(path)
    for frame, docs in ((odd, [(d, t) for d, t, *_ in ODD]), (spark.read.parquet(f"{SF}/documents.parquet"), documents(spark))):
        rows = packing.pack(frame, shard_docs=50).collect()
        want = [(d, np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in docs]
        have = Counter()
        by = defaultdict(list)
        for r in rows:
            have[r["doc_id"]] += r["length"]
            by[r["sequence_id"]].append((r["offset"], r["length"]))
            assert len(r["ids"]) == 4 * r["length"]
        total = Counter()
        for d, i in want:
            total[d] += len(i)
        assert have == total
        many = Counter(d for d, _ in docs)
        for d, ids in want:
            if many[d] == 1:
                at = 0
                for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]):
                    assert (r["start"], bytes(r["ids"]), r["doc_tokens"]) == (at, ids[at : at + r["length"]].tobytes(), len(ids))
                    at += r["length"]
                assert at == len(ids)
        for pieces in by.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert not packing.pack(nothing).collect()
    want = {(d, i[:1024].tobytes()) for d, i in want}  # of documents, the last table
    for r in queries.op2_lexical_packing(spark, SF).where("start = 0").collect():
        ids = next(i for d, i in want if d == r["doc_id"])
        assert r["ids_crc32"] == zlib.crc32(ids[: 4 * r["length"]])


def brute_bm25(docs, i, j):
    n, mean, total = len(docs), np.mean([len(d) for d in docs]), 0.0
    for t in set(docs[i].tolist()):
        df, tf = sum(t in d for d in docs), int((docs[j] == t).sum())
        if 2 <= df <= n / 2:
            total += np.log((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[j]) / mean))
    return total


def test_neighbours_are_lexical():
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 500, 120) + 1000 * k for k in range(4)]
    docs = [np.append(rng.choice(topics[i % 4], 100), 0).astype(np.uint32) for i in range(16)]
    for row in packing.pack_shard(docs, window=404):
        assert len({d % 4 for d, _, _ in row}) == 1
    stats = packing.statistics(docs)
    index = packing.Index(docs, stats)
    for i in range(16):
        assert np.allclose(index.scores(i), [brute_bm25(docs, i, j) for j in range(16)], atol=1e-3)
    used = np.arange(16) % 3 == 0
    index.forget(used)
    assert np.allclose(index.scores(1), [0 if used[j] else brute_bm25(docs, 1, j) for j in range(16)], atol=1e-3)
    scores = rng.integers(0, 5, 300).astype(float)
    unused = rng.random(300) < 0.7
    assert list(packing.ranking(scores, unused)) == sorted(np.flatnonzero(unused), key=lambda d: (-scores[d], d))


def test_shards_hold_lexical_neighbours(spark):
    """Copies and near copies far apart in the table share a shard, and mostly a window."""
    rng = np.random.default_rng(3)
    word = [f"{a}{b}" for a in ("stone", "river", "cloud", "glass", "north", "paper", "light", "green") for b in ("field", "house", "bird", "song", "mark", "way", "fall", "ring")]
    base = [list(rng.choice(word, 150)) for _ in range(150)]
    rare = [[f"{rng.integers(10**9)}" for _ in range(10)] for _ in base]
    texts = [" ".join(b + r) for b, r in zip(base, rare)] + [" ".join(b[:140] + r + b[:5]) for b, r in zip(base, rare)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_docs=30).collect()
    windows = defaultdict(set)
    for r in rows:
        windows[r["doc_id"]].add(r["sequence_id"])
    assert np.mean([bool(windows[i] & windows[i + 150]) for i in range(150)]) > 0.6  # by chance 2 in 100


def brute_windows(units_of, window):
    seen = Counter()
    for _, u in units_of:
        for i in range(len(u) - window + 1):
            seen[tuple(u[i : i + window])] += 1
    out = []
    for key, u in units_of:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((key, u, gone))
    return out


def planted(seed):
    rng = np.random.default_rng(seed)
    word = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(word, 150)) for _ in range(6)]
    out = [(i, b) for i, b in enumerate(base)]
    for i in range(6, 26):
        a, b = base[rng.integers(6)].split(), base[rng.integers(6)].split()
        s, n = rng.integers(0, 100), rng.integers(20, 80)
        mid = a[s : s + n]
        if rng.random() < 0.5 and mid:
            mid[rng.integers(len(mid))] = "changed"
        out.append((i, " ".join([*rng.choice(word, rng.integers(0, 30)), *mid, *b[: rng.integers(0, 90)]])))
    return out + [(30, "tick tock " * 60), (31, "tock tick " * 60), (32, base[0]), (33, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    docs = planted(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, edge string")
    rows = {r["doc_id"]: r for r in debruijn.dedup(frame).collect()}
    for d, words, gone in brute_windows([(d, t.split()) for d, t in docs], 35):
        assert rows[d]["text"].split() == [w for w, g in zip(words, gone) if not g], d
        assert (rows[d]["n_words"], rows[d]["n_removed"], rows[d]["edge"]) == (len(words), gone.sum(), "x")


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_array_dedup(spark, seed):
    docs = planted(seed)
    rows = {r["doc_id"]: r for r in suffixarray.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    removed = 0
    for d, b, gone in brute_windows([(d, t.encode()) for d, t in docs], 400):
        assert bytes(rows[d]["kept"]) == bytes(c for c, g in zip(b, gone) if not g), d
        assert rows[d]["n_removed"] == gone.sum() and len(rows[d]["removed"]) == (np.diff(np.append(0, gone.astype(int))) == 1).sum()
        removed += gone.sum()
    assert removed


@pytest.mark.parametrize("operator, name", [(debruijn, "_paths"), (suffixarray, "_order")])
def test_the_method_carries_the_result(spark, monkeypatch, operator, name):
    """Nothing goes but what the method stands together: without its anchors and stretches all is kept."""
    real = getattr(operator, name)
    frame = spark.createDataFrame(planted(5), "doc_id long, text string")
    assert any(r["n_removed"] for r in operator.dedup(frame).collect())
    monkeypatch.setattr(operator, name, lambda found, window: tuple(x.where("false") for x in real(found, window)))
    assert not any(r["n_removed"] for r in operator.dedup(frame).collect())


def test_substrings_of_odd_rows(spark, odd, nothing):
    for run, unit, window in ((debruijn.dedup, lambda t: (t or "").split(), 35), (suffixarray.dedup, lambda t: (t or "").encode(), 400)):
        want = Counter((d, len(u), int(g.sum())) for d, u, g in brute_windows([(d, unit(t)) for d, t, *_ in ODD], window))
        n = "n_words" if run is debruijn.dedup else "n_bytes"
        assert Counter((r["doc_id"], r[n], r["n_removed"]) for r in run(odd).collect()) == want
        assert not run(nothing).collect()


def test_suffix_order(spark):
    rng = np.random.default_rng(5)
    strings = [(i, rng.integers(0, 3, rng.integers(1, 40)).tolist()) for i in range(12)]
    got = suffixarray.suffix_ranks(spark.createDataFrame(strings, "uid long, c array<long>"), depth=3).collect()
    assert len(got) == sum(len(c) for _, c in strings)
    by = dict(strings)
    order = [by[r["uid"]][r["p"] :] for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order)


def test_compaction(spark):
    # 1 -> 2 -> 3 -> 4 without a branch, then 4 -> 5 and 4 -> 6, and a circle 7 -> 8 -> 7
    edges = [(12, 1, 2), (23, 2, 3), (34, 3, 4), (45, 4, 5), (46, 4, 6), (78, 7, 8), (87, 8, 7)]
    got = {r["edge"]: (r["path"], r["place"]) for r in debruijn.compact(spark.createDataFrame(edges, "edge long, node long, next_node long")).collect()}
    assert got == {12: (12, 0), 23: (12, 1), 34: (12, 2), 45: (45, 0), 46: (46, 0), 78: (78, 0), 87: (87, 0)}


def test_windows_have_one_anchor_each():
    shape, text = suffixarray.SHAPE, bytes(np.random.default_rng(2).integers(97, 101, 3000, dtype=np.uint8))
    a = spans.find_anchors(spans.Units(text, False), shape)
    assert np.array_equal(np.concatenate([np.arange(f, t + 1) for f, t in zip(a.first, a.last)]), np.arange(len(text) - shape.window + 1))
    b = spans.find_anchors(spans.Units(b"zz" + text[500:2500] + b"q", False), shape)
    inner = {int(at) - 2 + 500 for at, f, t in zip(b.at, b.first, b.last) if f > 2 and t < 2000 - shape.window}
    assert inner and inner <= set(a.at.tolist())


def brute_lines(docs):
    last = 1 << 63
    every = [((last if d is None else d), i, x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 20 or abs(len(a) - len(b)) > 1:
            return False
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:])

    gone = {(d, i) for d, i, x in every if any((e, j) < (d, i) and near(x, y) for e, j, y in every)}
    return {(d, t): "\n".join(x for i, x in enumerate(t.split("\n")) if ((last if d is None else d), i) not in gone) for d, t in docs if t is not None}


def test_line_dedup(spark, odd, nothing):
    line = "the quick brown fox jumps over the lazy dog and keeps on running until it is far away from here"
    docs = [(1, line + "\nshort\n\nshort"), (2, line.replace("lazy", "laxy") + "\nother line that nobody has"), (3, line.replace("quick", "quic")), (4, "x" + line), (5, line + "zz"), (6, "shoet"), (None, "other line that nobody  has\nlast"), (0, line.upper())]
    docs += [(10 + i, line[:i] + "#" + line[i + 1 :]) for i in range(0, len(line), 7)]
    for some in (docs, [(d, t) for d, t, *_ in ODD]):
        want = brute_lines(some)
        rows = linededup.dedup(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert len(rows) == len(some)
        for r in rows:
            if r["text"] is not None and Counter(d for d, _ in some)[r["doc_id"]] == 1:
                text = next(t for d, t in some if d == r["doc_id"])
                assert r["text"] == want[(r["doc_id"], text)], r
    assert linededup.dedup(odd).columns == ["doc_id", "extra", "uid", "text", "n_lines", "n_removed"]
    assert not linededup.dedup(nothing).collect()


def test_line_dedup_tells_rows_apart(spark):
    import xxhash

    line = "a line that is long enough to be compared one edit apart"
    docs = [(None, "A1\nunique"), (None, "B1\nA1"), (None, "A1\nunique"), (None, line + "\nx"), (None, line.replace("long", "lung") + "\ny"), (None, None), (None, ""), (None, "\n\n"), (7, "A2\nmine"), (7, "A2\nhers"), (7, "C2\nA2\n\nA2"), (7, "C2\nA2\n\nA2"), (8, "hers\nnew"), (8, line.replace("edit", "edits"))]
    docs += [(None, f"common\nown {i}") for i in range(20)]
    place, order = Counter(), []
    for k, (d, t) in enumerate(docs):
        h = xxhash.xxh64((t or "").encode(), seed=42).intdigest()
        order.append(((1 << 63) - 1 if d is None else d, h - (1 << 64) * (h >> 63), place[(d, t)], k))
        place[(d, t)] += 1
    ranked = [(r, docs[k][1]) for r, (*_, k) in enumerate(sorted(order))]
    by_rank = brute_lines(ranked)
    want = Counter((docs[k][0], t if t is None else by_rank[(r, t)]) for (r, t), (*_, k) in zip(ranked, sorted(order)))
    rows = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == want
    assert sum("unique" in (r["text"] or "") for r in rows) == 1 and sum("common" in (r["text"] or "") for r in rows) == 1
    solid = lambda t: sum(bool(x.strip(" \t\r\x0b\x0c")) for x in (t or "").split("\n"))
    assert all(r["n_lines"] - r["n_removed"] == solid(r["text"]) for r in rows)


def test_short_lines_one_edit_apart(spark):
    texts = ["cat", "cut", "cats", "at", "dog", "a", "b", "xyz\ncat", "\u6f22\u5b57\u304c", "\u6f22\u5b57\u306f", "nineteen characters", "nineteen characterss", "nineteen charactess"]
    every = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    for floor in (1, 4, 20):
        rows = linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_fuzzy=floor).collect()
        first = {x: (d, i) for d, i, x in reversed(every)}
        gone = {(d, i) for d, i, x in every if first[x] < (d, i) or len(x) >= floor and any(len(y) >= floor and x != y and near(x, y) and first[y] < first[x] for y in first)}
        assert {r["doc_id"]: r["text"] for r in rows} == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)}, floor


def test_line_dedup_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = duckdb.sql(oracles.SQL["op5_line_dedup"]).fetchall()
    mine = queries.op5_line_dedup(spark, SF).collect()
    assert sorted(map(tuple, mine)) == sorted(theirs) and sum(r["n_removed"] for r in mine)


def brute_simhash(docs, words=3):
    import xxhash

    def one(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        if not w:
            return 0
        sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    fps = [(d, one(t)) for d, t in docs]
    known = sorted({f for _, f in fps})
    forest = shared.Forest(len(known))
    for i, a in enumerate(known):
        for j in range(i):
            if (a ^ known[j]).bit_count() <= 3:
                forest.join(i, j)
    root = {f: forest.find(i) for i, f in enumerate(known)}
    low = {}
    for d, f in fps:
        if d is not None:
            low[root[f]] = min(d, low.get(root[f], d))
    return [(d, f, low.get(root[f])) for d, f in fps]


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash(spark, nothing, block):
    rng = np.random.default_rng(8)
    base = [str(x) for x in rng.integers(0, 10**6, 400)]
    near = [(1000 + i, " ".join(base[:k] + ["odd"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 400, 40))]
    docs = documents(spark) + near + [(d, t) for d, t, *_ in ODD if d is None or d < 0]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter(brute_simhash(docs))
    assert not simhash.near_duplicates(nothing).collect()


def test_every_pair_within_three_bits_meets(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    pairs = [(int(x), int(x) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for x, n in zip(a, [1, 2, 3] * 20)]
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for p in pairs for f in p], "fp long")
    at, homes = defaultdict(set), defaultdict(set)
    for r in simhash.anchors(frame).collect():
        at[r["fp"] % (1 << 64)].add(r["anchor"])
        if r["home"]:
            homes[r["fp"] % (1 << 64)].add(r["anchor"])
    assert all(homes[x] & at[y] and homes[y] & at[x] for x, y in pairs) and max(map(len, at.values())) <= 32


def test_keep_one(spark, odd):
    got = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(odd).collect())
    assert got[(6, "same text")] == 1 and (7, "same text") not in got and got[(None, PASSAGE)] == 1
    assert simhash.keep_one(odd).columns == SCHEMA.replace(",", "").split()[::2]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 1000])
def test_cuts_below_a_value(spark, n):
    import bisect

    cuts = [3 * i - 7 for i in range(n)]
    values = [None, -(2**63), 2**63 - 1, *range(-12, 12), *cuts[-3:], *(c + 1 for c in cuts[-3:])]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", lzfingerprint._below(F.col("v"), cuts).alias("n"))
    assert all(r["n"] == (0 if r["v"] is None else bisect.bisect_left(cuts, r["v"])) for r in rows.collect())


def test_fingerprints(spark, odd, nothing):
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in queries.op7_lz_fingerprints(spark, SF).collect()}
    order = sorted(docs)
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[d]["n_chars"] == len(t)
        assert rows[d]["fingerprint"] == lzfingerprint.as_text(lzfingerprint.fingerprint(t.encode()))
        assert rows[d]["edited_fingerprint"] == lzfingerprint.as_text(lzfingerprint.fingerprint(edited.encode()))
    near, after = (np.median([r[c] for r in rows.values()]) for c in ("near_edited", "near_next"))
    assert near > 0.5 > 0.3 > after
    for buckets in (1, 3, 50):
        assert len(lzfingerprint.edited_likeness(odd, buckets).collect()) == len(ODD)
    one = lzfingerprint.edited_likeness(odd.where("doc_id = 9")).first()
    t = ODD[10][1]
    assert one["edited"] == t[: len(t) - len(t) // 4] + t[: len(t) // 4]
    assert not lzfingerprint.edited_likeness(nothing).collect() and not lzfingerprint.fingerprints(nothing).collect()
    # signatures estimate the overlap of phrase sets
    for a, b in zip(docs[:20], docs[1:21]):
        x, y = (set(lzfingerprint.Phrases().parse(v[1].encode()).hashes[1:]) for v in (a, b))
        true = len(x & y) / len(x | y)
        assert abs(lzfingerprint.likeness(*(lzfingerprint.fingerprint(v[1].encode()) for v in (a, b))) - true) < 0.2


def test_quality(spark, odd, nothing):
    rows = queries.op9_quality_cnn(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.classify(odd, labels, rows=10).collect()
    assert len(got) == len(ODD)
    none = quality.classify(odd, labels.where("false")).collect()
    assert all(0 <= r["score"] <= 1 for r in none) and not quality.classify(nothing, labels).collect()
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_chunks_cover_the_text():
    text = bytes(np.random.default_rng(1).integers(1, 256, 5000, dtype=np.uint8))
    seen = {r[i : i + quality.WIDTH].tobytes() for r in quality.chunks(text) for i in range(quality.CHUNK - quality.WIDTH + 1)}
    assert seen == {text[i : i + quality.WIDTH] for i in range(len(text) - quality.WIDTH + 1)}
    net = quality.fit([b"good text here", b"!!!!"] * 8, np.array([1, 0] * 8), epochs=20)
    assert net.scores([b"good text here"])[0] > 0.5 > net.scores([b"!!!!"])[0] and len(net.scores([b"", text * 60])) == 2


def test_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = quality.fit([b"some good text", b"!!##!!"] * 6, np.array([1, 0] * 6), epochs=3)
    for text in (b"", b"a", b"short text", bytes(rng.integers(1, 256, 700, dtype=np.uint8)), b"long " * 900):
        rows = quality.chunks(text)
        best = np.array([[max(sum(float(net.table[j][row[i + j]][f]) for j in range(quality.WIDTH)) for i in range(quality.CHUNK - quality.WIDTH + 1)) for f in range(3)] for row in rows[:3]])
        got = quality._responses(net, rows, False)[0]
        assert np.allclose(np.maximum(best + net.bias[:3], 0), got[:3, :3], atol=1e-3)
        pooled = np.concatenate([got.mean(axis=0), got.max(axis=0)])
        assert abs(1 / (1 + np.exp(-(pooled @ net.weight + net.offset))) - net.scores([text])[0]) < 1e-4


def test_clashing_columns_stay(spark):
    frame = spark.createDataFrame([(1, "good text that stays here", 5, 6.0, "a", 7), (2, PASSAGE, 8, 9.0, "b", 1), (3, PASSAGE, 3, 2.0, "c", 0)], "doc_id long, text string, n int, score double, spans string, uid__x int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {(r["doc_id"], r["score"]) for r in quality.keep_good(frame, labels, threshold=0.0).collect()} == {(1, 6.0), (2, 9.0), (3, 2.0)}
    assert {(r["doc_id"], r["n"]) for r in simhash.keep_one(frame).collect()} == {(1, 5), (2, 8)}
    assert {(r["doc_id"], r["spans"], r["n_removed"]) for r in debruijn.dedup(frame).collect()} == {(1, "a", 0), (2, "b", 70), (3, "c", 70)}


def brute_vectors(rows):
    n = len(rows)
    ok = [bool(v) and None not in v and np.isfinite(v).all() and any(v) and lab is not None for _, v, lab in rows]
    x = [np.asarray(v, np.float32).astype(float) if o else None for (_, v, _), o in zip(rows, ok)]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                link[i, j] = x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98
    forest = shared.Forest(n)
    for i, j in zip(*np.nonzero(link)):
        forest.join(int(i), int(j))
    low = defaultdict(lambda: 1 << 62)
    for i, (v, _, _) in enumerate(rows):
        low[forest.find(i)] = min(low[forest.find(i)], v)
    return {(v, int(link[i].sum()), low[forest.find(i)]) for i, (v, _, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [4096, 8])
def test_embeddings(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        rows += [(centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.4]), c % 3) for _ in range(12)]
    rows = [(i, [float(np.float32(a)) for a in v], lab) for i, (v, lab) in enumerate(rows)]
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(600, rows[0][1], 2), (601, rows[0][1], None), (602, None, 0), (603, [0.0] * 24, 0), (604, [None] + [1.0] * 23, 0), (605, [float("nan")] * 24, 0), (606, [float("inf")] * 24, 0), (607, [], 0), (608, [2 * a for a in rows[3][1]], rows[3][2])]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], VECTORS)
    got = embeddings.near_duplicates(frame, block=block).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == brute_vectors(rows) and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    odd = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", "")], VECTORS)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in odd) == [(-1, 0), (1, 0), (1, 0)]
    assert not embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).collect()


def links_of(spark, rows, **how):
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "a", "b") for r in rows], VECTORS.replace("label int", "label long")), **how).collect()
    assert len(got) == len(rows)
    return {(r["vec_id"], r["n_links"], r["component_id"]) for r in got}


def clusters(seed, width, n, first=0, label=0):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        centre = rng.normal(size=width)
        rows += [(first + 10 * c + k, [float(np.float32(a)) for a in centre + rng.normal(size=width) * 0.02], label) for k in range(4)]
    return rows


@pytest.mark.parametrize("block", [4096, 6])
def test_widths_stand_apart(spark, block):
    rows = clusters(5, 16, 10) + clusters(6, 20, 5, 1000) + clusters(7, 3, 2, 2000) + [(500, [1.0] * 21, 0), (502, [1.0] * 40 + [None], 0)]
    want = brute_vectors(rows)
    assert sum(n for _, n, _ in want) >= 200
    for sample in (20_000, 8):
        got = links_of(spark, rows, block=block, sample=sample)
        if block == 4096:
            assert got == want
        assert sum(n for _, n, _ in got) >= 0.9 * sum(n for _, n, _ in want)


def test_few_vectors_and_great_labels(spark):
    two = [(1, [1.0, 0.0, 0.01], 1 << 50), (2, [1.0, 0.01, 0.0], 1 << 50), (3, [1.0, 0.01, 0.0], -(1 << 63)), (4, [1.0, 0.0, 0.0], (1 << 63) - 1)]
    assert links_of(spark, two) == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}


def test_recall_of_tables(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(600, 64)) @ rng.normal(size=(64, 64)) * np.linspace(0.2, 2, 64)
    rows = [(i, v.astype(np.float32).astype(float).tolist(), 1) for i, v in enumerate(base)]
    for i, v in enumerate(base):
        noise = rng.normal(size=64)
        noise -= noise @ v / (v @ v) * v
        angle = np.arccos(rng.uniform(0.9805, 0.9999))
        rows.append((1000 + i, (v + np.tan(angle) * np.linalg.norm(v) * noise / np.linalg.norm(noise)).astype(np.float32).astype(float).tolist(), 1))
    want = brute_vectors(rows)
    got = links_of(spark, rows, block=100)
    assert sum(n for _, n, _ in want) >= 1200
    assert sum(n for _, n, _ in got) >= 0.95 * sum(n for _, n, _ in want)
    assert links_of(spark, rows) == want  # one block holds them all


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_that_point_one_way(spark, block):
    """The tables hold at any block size, even where all vectors of a label are near their mean."""
    rng = np.random.default_rng(1)
    rows = [(i, v.astype(np.float32).astype(float).tolist(), 1) for i, v in enumerate(1 + rng.normal(size=(90, 24)) * 0.1)]
    want = brute_vectors(rows)
    got = links_of(spark, rows, block=block)
    assert sum(n for _, n, _ in want) >= 7000
    assert sum(n for _, n, _ in got) >= 0.95 * sum(n for _, n, _ in want)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (70, 2))] + [(300, 300)]
    forest = shared.Forest(400)
    for a, b in edges:
        forest.join(a, b)
    got = {r["node"]: r["root"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: forest.find(x) for a, b in edges if a != b for x in (a, b)}


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty texts, repeated rows and an empty table pass through every stage."""
    import corpus_pipeline as C

    for rows in (ODD, []):
        docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in C.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                docs = shared.Stage(docs, "odd").df
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert bool(docs.collect()) == bool(rows)


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, now = [], docs
    for name, stage in C.STAGES[:-1]:
        before, now = now, shared.Stage(stage(spark, now, SF), "test").df
        assert now.columns == docs.columns, name
        sizes.append((before, now))
    (a, b), (_, c), (_, d), (_, e) = sizes
    net = quality.learn(a, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [(r["doc_id"], r["text"]) for r in a.collect() if net.scores([r["text"].encode()])[0] >= 0.3]
    assert sorted(good) == sorted((r["doc_id"], r["text"]) for r in b.collect())
    assert {(r["doc_id"], r["text"]) for r in c.collect()} == {(k[0], t) for k, t in brute_lines(good).items()}
    low = {x[0] for x in brute_simhash([(r["doc_id"], r["text"]) for r in c.collect()]) if x[0] == x[2]}
    assert {r["doc_id"] for r in d.collect()} == low
    left = {k: [w for w, g in zip(u, gone) if not g] for k, u, gone in brute_windows([(r["doc_id"], r["text"].split()) for r in d.collect()], 35)}
    assert {r["doc_id"]: r["text"].split() for r in e.collect()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in e.collect())
    assert {r["doc_id"] for r in C.STAGES[-1][1](spark, e, SF).collect()} == set(left)
