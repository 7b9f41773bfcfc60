"""Disclosing terms over whole documents, against plain Python."""

import math
import re
from collections import Counter

from basinframe.llm import private

EMAIL = r"[a-z]+@[a-z]+\.[a-z]+"


def _plain(texts, theta=0.8):
    """Term spans of texts in which only e-mails are protected."""
    words = [{w.lower() for w in re.findall(r"[^\W_]+", t) if len(w) >= 4} for t in texts]
    entities = [set(re.findall(EMAIL, t)) for t in texts]
    c_t, c_e = Counter(w for s in words for w in s), Counter(e for s in entities for e in s)
    c_te = Counter((w, e) for ws, es in zip(words, entities) for w in ws for e in es)
    n = len(texts)

    def reveals(w, e):
        x = n * c_te[w, e] / (c_t[w] * c_e[e])
        return n * c_te[w, e] > c_t[w] * c_e[e] and math.log(x) >= theta * math.log(n / c_e[e]) - 1e-9

    out = []
    for t, ws, es in zip(texts, words, entities):
        told = {w for w in ws if any(reveals(w, e) for e in es)}
        own = [m.span() for m in re.finditer(EMAIL, t)]
        spans = [m.span() for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in told]
        out.append([f"term:{a}:{b}" for a, b in spans if not any(x <= a and b <= y for x, y in own)])
    return out


def _terms(table):
    rows = private.find_private(table).collect()
    return {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("term")] for r in rows}


def test_entity_of_one_document(spark):
    texts = [f"plain words about the weather {i}" for i in range(60)]
    texts[7] = "Zweig lives here\nmail eve@x.org\nplain words about the weather\n" + "plain weather " * 60 + "zweig"
    got = _terms(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert got[7] == _plain(texts)[7] and {"term:0:5", f"term:{len(texts[7]) - 5}:{len(texts[7])}"} <= set(got[7])
    assert not any(got[i] for i in got if i != 7)


def test_counts_over_whole_documents(spark, rng):
    common, names = [f"word{i}" for i in range(30)], [f"name{i}" for i in range(40)]
    mails = [f"{a}{b}@host.org" for a in "abcd" for b in "wxyz"]

    def text():
        own = rng.sample(range(16), rng.choice([0, 0, 1, 2, 3]))
        parts = [rng.choice(common) for _ in range(rng.randint(5, 40))] + [mails[i] for i in own]
        parts += [names[2 * i + rng.randint(0, 1)].title() for i in own for _ in range(2)] + [rng.choice(names)] * (rng.random() < 0.1)
        rng.shuffle(parts)
        return "\n".join(parts)

    texts = [text() for _ in range(300)]
    texts += [texts[0]] * 5
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    got, want = _terms(table), _plain(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 50
    masked = {r["doc_id"]: r["text"] for r in private.sanitise(table).collect()}
    assert all(masked[i].count("[TERM]") == len(s) for i, s in enumerate(want))


def test_an_entity_of_all_documents_is_not_disclosed(spark):
    table = spark.createDataFrame([(1, "some words to eve@x.org")], "doc_id long, text string")
    assert _terms(table) == {1: []}


def test_columns_of_any_name_stay(spark):
    names = ("_row", "_hit", "_email", "_term", "_told", "_index", "_rest", "_id", "col1", "a.b")
    table = spark.createDataFrame(
        [(1, *("keep",) * 5, "to eve@x.org now", *("keep",) * 5), (2, *(None,) * 11)],
        ", ".join(["doc_id long", *(f"`{c}` string" for c in names[:5]), "text string", *(f"`{c}` string" for c in names[5:])]),
    )
    out = private.sanitise(table)
    assert out.columns == table.columns
    first, second = sorted(map(tuple, out.collect()))
    assert first == (1, *("keep",) * 5, "to [EMAIL] now", *("keep",) * 5) and second == (2, *(None,) * 11)
    found = private.find_private(table.withColumnRenamed("doc_id", "_doc").withColumnRenamed("_row", "doc_id"), id_col="_hit")
    assert sorted((r["_hit"] or "", r["n_email"]) for r in found.collect()) == [("", 0), ("keep", 1)]


def test_a_text_of_many_entities(spark):
    """A very long text, another that shares half of its addresses, and plain ones."""
    host = lambda i: f"u{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
    long = " ".join(f"Name{host(i)} at {host(i)}@host.org wrote" for i in range(4000))
    half = " ".join(f"{host(i)}@host.org with name{host(i)} plain" for i in range(0, 600, 2))
    texts = [long, half, *(f"plain words wrote {i}" for i in range(80))]
    got = _terms(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    want = _plain(texts)
    assert [got[i] for i in range(len(texts))] == want and len(want[0]) >= 4000
