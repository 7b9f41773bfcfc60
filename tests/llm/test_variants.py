"""Spelling variants against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np

from basinframe.llm import variants

ALPHABET = list(range(97, 123)) + list(range(0xC0, 0x100))


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(rows):
    counts, out = plain_counts(rows), {}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    for w, found in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (found[0], root, *found[1:])
    return out


def misspelt(rng):
    base = ["recherché", "straßenbau", "hesitation", "wonderful", "aaaaaaaa", "ÀÀÀÀÀÀÀÀ", "Abcdefgh"]
    texts = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(base)
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeé") + w[k + 1 :], w[:k] + rng.choice("aeé") + w[k:]])
            words.append(w)
        texts.append((i, rng.choice([" ", "-", "1"]).join(words)))
    return texts + [(None, None), (1000, ""), (None, "wonderful " * 50), (7, texts[7][1]), (1001, "wonderful " * 3000)]


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_brute_force(spark, rng):
    rows = misspelt(rng)
    docs = spark.createDataFrame([(i, t, "clash", -1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = plain_variants(rows)
    assert any(f[0] for f in want.values()) and any(f[0] is None for f in want.values())
    assert as_dict(variants.spelling_variants(docs)) == want
    # Every group crowded at first: all words pass through all levels.
    assert as_dict(variants.spelling_variants(docs, levels=(1, 4, None), crowd=1)) == want


def test_chains_of_forms(spark):
    counts = [("abcdefghi", 3), ("abcdefghij", 40), ("abcdefghijk", 500), ("abcdefghijkl", 6000), ("abcdefgh", 2)]
    docs = spark.createDataFrame([(5, " ".join(" ".join([w] * n) for w, n in counts))], "doc_id long, text string")
    got = as_dict(variants.spelling_variants(docs, noise=1 << 40))
    assert {w: f[1] for w, f in got.items()} == dict.fromkeys((w for w, _ in counts), "abcdefghijkl") | {"abcdefgh": "abcdefgh"}
    assert got["abcdefghi"][:1] == ("abcdefghij",) and got["abcdefgh"][0] is None


def test_variants_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = as_dict(variants.spelling_variants(odd_docs))
    assert got == plain_variants([(r[0], r[1]) for r in odd_rows])
    assert variants.spelling_variants(no_docs).count() == 0


def test_query_equals_brute_force(spark, sf):
    from basinframe.llm.queries import QUERIES

    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(rows)
    got = as_dict(QUERIES["op12_spelling_variants"](spark, sf))
    assert {w: f[2] for w, f in got.items()} == counts
    some = sorted(counts)[::7]
    for w in some:
        near = sorted((-counts[v], v) for v in counts if one_edit(w, v))
        assert got[w][3] == len(near)
        assert got[w][0] == (near[0][1] if near and -near[0][0] >= 10 * counts[w] else None)


def test_neighbourhoods_are_full():
    words = ["abcab", "a", "éa"]
    for symbols in (2, None):
        reduced = lambda w: tuple(variants._reduce(np.array([ord(c) for c in w], np.uint32), symbols).tolist())  # noqa: B023, E731
        at, keys = variants.neighbour_keys(words, symbols, ALPHABET)
        for k, w in enumerate(words):
            edits = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
            edits |= {w[:i] + chr(c) + w[i + j :] for i in range(len(w) + 1) for c in ALPHABET for j in (0, 1) if i + j <= len(w)}
            one_each = {reduced(e): e for e in edits if e}
            want = set(variants.reduced_keys(list(one_each.values()), symbols).tolist())
            own = keys[at == k].tolist()
            assert want <= set(own) and len(own) == len(set(own)) and len(own) - len(want) <= 1
