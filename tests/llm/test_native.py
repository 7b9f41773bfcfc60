"""Personal data and URL lists, against plain Python."""

import datetime as dt
import math
import re
from datetime import date

import pytest

from basinframe.llm import private, urls

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark, rng, odd_docs, no_docs):
    texts = ["a@b.c_x@d.e a@b..c@d.e", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111x"]
    texts += ["+1 (555) 123-4567+44 20 7946 0958", "𝛀é a@b.co 𝛀 +123456789", "1 " * 30000, "a.b@" + "c." * 15000 + "d", "x" * 50000 + "@"]
    parts = ["4111 1111 1111 1111", "+1 555 123 4567", "a.b@c.de", ".", "-", " ", "1", "10.0.0.1", "\n", "@", "+", "𝛀"]
    texts += ["".join(rng.choice("ab.@-_ 0149+()\n𝛀 ") for _ in range(rng.randint(1, 150))) for _ in range(600)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    table = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in private.find_private(table).collect()}
    for i, text in enumerate(texts):
        assert got[i]["base"] == plain_spans(text), text[:80]
        assert got[i]["spans"].startswith(got[i]["base"])
    assert got[-1]["spans"] == ""
    assert private.find_private(odd_docs).count() == odd_docs.count()
    assert private.find_private(no_docs).count() == 0
    same = private.sanitise(odd_docs)
    assert same.columns == odd_docs.columns and same.count() == odd_docs.count() and private.sanitise(no_docs).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"dr zweig wrote to eve@x.org about weather\nall about weather {i}") for i in range(3)]
    rows += [(10 + i, f"all about weather and wrote a note {i}") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in private.find_private(table).collect()}
    information = math.log(43 / 3)
    reveals = lambda c_t: math.log(43 * 3 / (c_t * 3)) >= 0.8 * information
    assert reveals(3) and not reveals(43)
    assert got[1]["spans"] == "email:18:27,term:3:8" and got[10]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in private.sanitise(table).collect()}
    assert masked[1] == "dr [TERM] wrote to [EMAIL] about weather\nall about weather 1" and masked[10] == rows[3][1]


def test_url_lists(spark, rng):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "y.x.org"]
    captures = [(i, f"https://u@{rng.choice(hosts)}:8080/p?q=http://x.org", day(rng.randint(0, 40)), "r") for i in range(120)]
    captures += [(200, None, day(3), "r"), (201, "no url", day(3), "r"), (202, "http://X.org./", None, "r"), captures[0], (203, "http://X.ORG.", day(5), "r")]
    entries = [(k, v, day(rng.randint(0, 40)), rng.choice(["add", "remove"])) for k in ("host", "domain") for v in hosts for _ in range(4)]
    entries += [entries[0], (None, "x.org", day(1), "add"), ("host", "x.org", day(5), "add"), ("host", "x.org", day(5), "remove")]

    def active(kind, value, at):
        past = sorted((d, a) for k, v, d, a in entries if (k, v) == (kind, value) and d <= at)
        return bool(past) and past[-1][1] == "add"

    want = []
    for i, url, at, _ in captures:
        found = re.match(r"https?://(?:u@)?([^/:]+?)\.?(?:[/:]|$)", url or "")
        host = found[1].lower() if found else None
        hits = [f"host:{host}"] * bool(host and at and active("host", host, at))
        labels = (host or "").split(".")
        below = [".".join(labels[k:]) for k in range(len(labels))]
        hits += [f"domain:{d}" for d in below if host and at and active("domain", d, at)]
        want.append((i, host, len(hits), min(hits, default=None), bool(hits)))
    table = spark.createDataFrame(captures, "page_id long, url string, fetched_on date, rule string").drop("rule")
    lists = spark.createDataFrame(entries, "kind string, value string, listed_on date, action string")
    got = urls.filter_urls(table, lists).select("page_id", "host", "n_active", "rule", "blocked").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert urls.filter_urls(table, lists.where("false")).where("blocked").count() == 0
    assert urls.filter_urls(table.where("false"), lists).count() == 0


@pytest.mark.parametrize("value", ["4111111111111111", "79927398713"])
def test_luhn(spark, value):
    from pyspark.sql import functions as F

    assert spark.range(1).select(private.luhn(F.lit(value))).first()[0] is True


def test_columns_that_clash_and_a_busy_host(spark):
    """Own columns stay; one host with 10^5 entries is no row, and no task, of its own."""
    from pyspark.sql import functions as F

    names = ["_host", "own", "at", "_names", "turn", "host"]
    table = spark.range(3000).select(
        F.lit("http://Busy.example/x").alias("url"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 37 % 40_000).cast("int")).alias("fetched_on"),
        *(F.concat(F.lit("keep"), F.col("id")).alias(n) for n in names),
        "id",
    )
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int"))
    action = F.when(F.col("id") % 3 == 0, "add").when(F.col("id") % 3 == 1, "remove").otherwise("add")
    entries = spark.range(100_000).select(F.lit("host").alias("kind"), F.lit("busy.example").alias("value"), day.alias("listed_on"), action.alias("action"))
    out = urls.filter_urls(table, entries)
    assert not [f for f in out.schema if "array" in f.dataType.simpleString()]
    start, zero = date(2000, 1, 1), date(1990, 1, 1)
    for r in out.collect():
        n = (r["fetched_on"] - zero).days
        assert (start - zero).days <= n and r["blocked"] == (n % 3 != 1) and r["n_active"] == int(n % 3 != 1)
        assert r["host"] == "busy.example" and all(r[c] == f"keep{r['id']}" for c in names[:-1])
