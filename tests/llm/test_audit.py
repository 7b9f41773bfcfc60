"""The audit of filters against plain Python."""

import re
from collections import Counter
from itertools import permutations

from basinframe.llm import audit


def plain_masks(rows):
    """(part, mask, id) of rows (id, text, part)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            i is not None and least[text] < i,
        ]
        yield part or "", fails, i


def plain_audit(rows, good, toxic):
    masks, out, shapley = list(plain_masks(rows)), Counter(), Counter()
    for order in permutations(range(5)):
        name = "".join("ABCDE"[k] for k in order)
        for part, fails, i in masks:
            alive = True
            for step, k in enumerate(order, 1):
                key = (part, name, step)
                gone = alive and fails[k]
                out[key, "redundant"] += not alive and fails[k]
                out[key, "removed"] += gone
                out[key, "good_lost"] += gone and i in good
                out[key, "toxic_lost"] += gone and i in toxic
                out[key, "unique_fails"] += fails[k] and sum(fails) == 1
                shapley[part, k] += gone
                alive = alive and not fails[k]
                out[key, "kept"] += alive
    parts = {p for p, _, _ in masks}
    return {
        (p, "".join("ABCDE"[k] for k in o), s): (*(out[(p, "".join("ABCDE"[k] for k in o), s), m] for m in audit.MEASURES), shapley[p, o[s - 1]])
        for p in parts
        for o in permutations(range(5))
        for s in range(1, 6)
    }


def as_dict(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): (*(r[m] for m in audit.MEASURES), r["shapley"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_brute_force(spark, rng):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 60, 400])]) for _ in range(rng.choice([3, 99, 100, 150]))) for _ in range(60)]
    texts = [rng.choice(["", "A B ", "# "]) * rng.choice([1, 20]) + t for t in texts] + ["SHOUT! " * 30, "x\x0by\x1cz\x85"]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 7], "en") for i in range(40)]
    rows += [rows[3], rows[3], (None, texts[0], "en"), (None, None, "fr"), (-5, texts[1], "de"), (500, None, "fr"), (3, "other", "de")]
    rows += [(600, "a|b " * 4000, "en"), (601, "a|b " * 4000, "en")]
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "doc_id long, text string, lang string, mask int, key string, n int")
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 2)] + [(4, 1, False), (3, 0, True), (None, 1, True), (3, None, None)]
    table = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t and i is not None}
    assert as_dict(audit.filter_audit(docs.repartition(5), table)) == plain_audit(rows, good, toxic)


def test_audit_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = as_dict(audit.filter_audit(odd_docs, labels, part_col="n_words"))
    assert got == plain_audit([(r[0], r[1], r[2]) for r in odd_rows], set(), set())
    assert audit.filter_audit(no_docs, labels, part_col="n_words").count() == 0


def test_sizes_of_orders(spark):
    cells = spark.createDataFrame([("p", 0, 4, 1, 0), ("p", 3, 2, 1, 2), ("q", 1, 7, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = as_dict(audit.order_audit(cells, "AB"))
    assert len(got) == 8
    assert got["p", "AB", 1] == (4, 2, 0, 0, 1, 2, 2) and got["p", "AB", 2] == (4, 0, 2, 0, 0, 0, 2)
    assert got["q", "BA", 1] == (7, 0, 0, 0, 0, 0, 0) and got["q", "BA", 2] == (0, 7, 0, 7, 0, 0, 14)
