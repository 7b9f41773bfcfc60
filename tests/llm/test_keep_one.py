"""One row per component of near duplicates, whatever the ids are."""

from collections import Counter

import corpus_pipeline as cp

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def _text(rng):
    return " ".join(str(rng.randrange(10**6)) for _ in range(60))


def test_null_and_reused_ids(spark, rng):
    a, b, c, d, e, f, g = (_text(rng) for _ in range(7))
    near_a = a + " one more"
    rows = [
        (1, a), (None, near_a), (None, b), (None, c),  # a rejected null id beside null ids that stay
        (7, d), (7, e), (7, e), (7, d + " end"),  # an id used for unlike texts, twice for like ones
        (None, f), (None, f), (None, f + " last"),  # copies that all lack an id
        (9, g), (2, g), (9, b + " b"),  # id 9 is a copy here, and has an id where b has none
        (None, None), (None, " "), (5, ""), (5, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], NAMES).repartition(5)
    out = cp.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    alone = Counter([(1, a), (None, c), (7, e), (2, g), (9, b + " b"), (None, None), (None, " "), (5, ""), (5, "")])
    assert all(got[k] == n for k, n in alone.items())
    either = [[(7, d), (7, d + " end")], [(None, f), (None, f + " last")]]
    assert [sum(got[k] for k in pair) for pair in either] == [1, 1] and sum(got.values()) == sum(alone.values()) + 2


def test_one_row_per_component_when_most_ids_are_null(spark, rng):
    texts = [_text(rng) for _ in range(40)]
    rows = [(None if i % 3 else i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:10], NAMES).repartition(4)
    got = cp.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["text"] for r in got) == sorted(texts)
