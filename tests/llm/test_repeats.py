"""Exact passage removal, near duplicates and search, against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinframe.llm import near, phrases, pivots, suffixes


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_sorted_suffixes(rng, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 7)
    for trial in range(120):
        letters = "ab" if trial % 2 else "abcd"
        strings = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).encode() for _ in range(rng.randint(1, 12))]
        strings += [strings[0] + b"\x00\xff\xff" + strings[0]] * (trial % 3 == 0)
        cap, budget = rng.choice([3, 9, 30]), rng.choice([5, 1000])
        blocks = list(suffixes.sorted_suffixes(strings, cap, budget))
        order, shared = (np.concatenate(x).tolist() for x in zip(*blocks, strict=True))
        plain = [(1, i) if v == 1 else (v, 0) for i, v in enumerate(suffixes._joined(strings)[0].tolist())]
        assert order == sorted(range(len(plain)), key=lambda i: plain[i:], reverse=True)  # noqa: B023
        want = [0] + [min(cap, common(plain[i:], plain[j:])) for i, j in zip(order, order[1:])]
        assert shared == want
        width, windows = rng.choice([8, 9, 12]), []
        windows = [max(0, len(s) - width + 1) for s in strings]
        copies = [rng.choice([1, 1, 2]) for _ in strings]
        count = Counter()
        for s, n, c in zip(strings, windows, copies, strict=True):
            for i in range(n):
                count[s[i : i + width]] += c
        got = suffixes.repeated_windows(strings, windows, copies, width, budget)
        for hit, s, n in zip(got, strings, windows, strict=True):
            assert hit.tolist() == [count[s[i : i + width]] > 1 for i in range(n)]


def test_shards_beyond_their_queues(spark, rng):
    """One shard of over ten times what its queues may keep: the rest goes to disk."""
    base = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    texts = [base[a : a + 400] + rng.choice("xyz") * rng.randint(0, 3) for a in [rng.randrange(29_600) for _ in range(300)]]
    held, before = sum(map(len, texts)), suffixes.BucketQueues.spills
    raw = [t.encode() for t in texts]
    hits = suffixes.repeated_windows(raw, [len(t) - 199 for t in raw], [1] * len(raw), 200, held // 12)
    assert suffixes.BucketQueues.spills - before >= 4
    count = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for t, hit in zip(raw, hits, strict=True):
        assert hit.tolist() == [count[t[i : i + 200]] > 1 for i in range(len(t) - 199)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = (
        Counter(tuple(r) for r in suffixes.repeat_digests(docs.coalesce(1), queue_entries=n).collect()) for n in (held // 50, 1 << 24)
    )
    assert few == many and sum(r[2] for r in few) > 1000


def covered(items, width, gone):
    mark = bytearray(len(items))
    for i in range(len(items) - width + 1):
        if gone(i):
            mark[i : i + width] = b"\1" * width
    return mark


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeated_substrings(odd_docs, odd_rows, no_docs, crowd):
    texts = [(r[0], (r[1] or "").encode()) for r in odd_rows]
    count = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = Counter()
    for own, t in texts:
        mark = covered(t, 200, lambda i: count[t[i : i + 200]] > 1)  # noqa: B023
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        want[own, len(t), sum(mark), spans, sha(bytes(b for b, m in zip(t, mark, strict=True) if not m))] += 1
    assert Counter(tuple(r) for r in suffixes.repeat_digests(odd_docs, crowd=crowd).collect()) == want
    if crowd > 2:
        out = suffixes.remove_repeats(odd_docs, as_text=True)
        assert out.count() == len(odd_rows) and suffixes.repeat_digests(no_docs).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeated_phrases(odd_docs, odd_rows, no_docs, crowd):
    texts = [(r[0], (r[1] or "").encode().split()) for r in odd_rows]
    first = {}
    for own, words in texts:
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            if own is not None:
                first[key] = min(first.get(key, own), own)
    want = Counter()
    for own, words in texts:
        mark = covered(words, 50, lambda i: own is not None and first[tuple(words[i : i + 50])] < own)  # noqa: B023
        kept = b" ".join(w for w, m in zip(words, mark, strict=True) if not m)
        want[own, len(words), sum(mark), sha(kept)] += 1
    got = phrases.phrase_digests(odd_docs, crowd=crowd, share=3000)
    assert Counter(tuple(r) for r in got.collect()) == want
    if crowd > 2:
        assert phrases.remove_phrases(no_docs).count() == 0


def groups(rows, size, percent):
    """Components by comparing all pairs, by id."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
        sets.append(frozenset(grams))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        least.setdefault(find(i), []).append(own)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((own, len(sets[i]), least[find(i)] if sets[i] else own, own == (least[find(i)] if sets[i] else own)) for i, (own, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, rng, odd_rows, no_docs, size, percent):
    words = [f"w{i}" for i in range(2000)]
    rows = [(r[0], r[1]) for r in odd_rows]
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.05]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = groups(rows, size, percent)
    for crowd in (64, 5):
        out = near.near_duplicates(docs, size, percent, share=5, crowd=crowd, block=4).collect()
        assert Counter(tuple(r) for r in out) == want
    if size == 3:
        assert near.near_duplicates(no_docs).count() == 0


def near_copies(rng, n):
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("n", [1000, 2000])
def test_edges_of_one_crowd(spark, rng, monkeypatch, n):
    """Many near copies of one text: whole groups, and links in proportion to documents."""
    rows, edges = near_copies(rng, n), []
    real = near.components
    monkeypatch.setattr(near, "components", lambda e: edges.append(e.count()) or real(e))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near.near_duplicates(docs, 3, 85, block=100).collect()
    assert sum(edges) <= 2 * n
    if n == 1000:
        assert Counter(tuple(r) for r in out) == groups(rows, 3, 85)


def test_blocks_join_components_once(rng):
    sets = [np.unique(np.array([rng.randrange(12) for _ in range(8)], np.uint64)) for _ in range(60)]
    comps = [100 + rng.randrange(20) for _ in sets]
    pairs = near._block_links(sets, comps, 70)
    root = {c: c for c in comps}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in pairs:
        assert find(a) != find(b)
        root[find(a)] = find(b)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if 100 * len(set(s.tolist()) & set(t.tolist())) >= 70 * len(set(s.tolist()) | set(t.tolist())):
                assert find(comps[i]) == find(comps[j])
    assert near._block_links(sets, [5] * 60, 70) == []


def test_signatures_estimate_similarity(rng):
    items = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    pairs = [(items[:300], items[50:350]), (items[:40], items[10:50]), (items[:5], items[2:6])]
    found = []
    for _ in range(40):
        shift = np.uint64(rng.getrandbits(64))
        sets = [near.mix64(s + shift) for pair in pairs for s in pair]
        sig = near.signatures([*sets, items[:0], items[:1]], 80)
        assert np.isinf(sig[-2]).all() and np.isfinite(sig[-1]).all()
        found.append([(sig[2 * i] == sig[2 * i + 1]).mean() for i in range(3)])
    assert np.abs(np.mean(found, axis=0) - [250 / 350, 30 / 50, 3 / 6]).max() < 0.03


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (100, 95)], "a long, b long")
    got = {r["node"]: r["root"] for r in near.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_top_k(spark, rng):
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(200)]
    rows += [(i, [1.0, 1.0, 0.5]) for i in range(300, 420)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(500, 800)]
    rows += [(850, None), (851, [math.nan, 1.0, 1.0]), (900, [None, 1.0, 2.0]), (901, []), (950, [1.0, 2.0]), (951, [3.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (1000, [0.0] * 3), rows[50], (1050, [math.inf, 0.0, 0.0])]
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for own, q in fine:
        if own % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in fine if i != own and len(v) == len(q))
            want |= {(own, r + 1, i, -s) for r, (s, i) in enumerate(best[:5])}
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, q string").repartition(3)
    got = pivots.top_k(table, F.col("vec_id") % 50 == 0, block=16, group=4, share=3)
    assert {tuple(r) for r in got.collect()} == want
    assert pivots.top_k(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0
