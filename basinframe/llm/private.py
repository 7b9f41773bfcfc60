"""Personal data: fixed patterns, and terms that reveal protected entities.

DataFrame expressions only. Patterns use possessive repeats, which match what greedy ones
would here and neither backtrack nor recurse on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.session import materialize

_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts where a run does, or where the last match ended inside one.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]+"
NOT_TERM = r"[^\p{L}\p{N}]+"
KINDS = ("email", "ip", "card", "phone")
ORDER = (*KINDS, "term")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, at: Column | int = 0) -> Column:
    """Leftmost matches as (start, end, value), in code points from ``at``.

    The texts between the matches come from splitting at the same pattern; their lengths
    and the matches' add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    at = at if isinstance(at, Column) else F.lit(at)
    start = F.struct(at.cast("int").alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc, x):
        a = acc["at"] + x["g"]
        b = a + F.length(x["m"])
        span = F.struct(a.alias("start"), b.alias("end"), x["m"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(both, start, add, lambda acc: acc["out"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""

    def add(acc, i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind; the cheap test in front spares texts that cannot match."""
    none = F.array().cast(_SPANS)
    only = lambda test, spans: F.when(test, spans).otherwise(none)
    n = lambda s: F.length(_digits(s["value"]))
    card_ok = lambda s: F.when(n(s).between(13, 19), luhn(_digits(s["value"]))).otherwise(False)
    ip_ok = lambda s: s["value"].rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    return {
        "email": only(F.instr(text, "@") > 0, matches(text, EMAIL)),
        "ip": only(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(matches(text, IP), ip_ok)),
        "card": only(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(matches(text, CARD), card_ok)),
        "phone": only(text.rlike(r"\+[0-9]"), F.filter(matches(text, PHONE), lambda s: n(s).between(9, 15))),
    }


def _each(kind: str, fn) -> Column:
    """``fn(span, kind)`` for the spans of a kind."""
    return F.transform(F.col(f"_{kind}"), lambda s: fn(s, kind))


def _words(text: Column, shortest: int) -> Column:
    """Distinct terms of a text in lower case."""
    words = F.array_distinct(F.transform(F.split(text, NOT_TERM), F.lower))
    return F.filter(words, lambda w: F.length(w) >= shortest)


def _reveals(n: Column, c_te: Column, c_t: Column, c_e: Column, theta: float) -> Column:
    """Whether c(t, e) documents of both are enough; more of them never are too many.

    A term seen with the entity no more often than by chance reveals nothing.
    """
    c_te, both = c_te.cast("double"), c_t.cast("double") * c_e
    return (n * c_te > both) & (F.log(n * c_te / both) >= theta * F.log(n / c_e) - 1e-9)


def _disclosing(base: DataFrame, docs: DataFrame, text: Column, theta: float, shortest: int) -> DataFrame:
    """(row, terms): for every row with an entity, its terms that reveal one of its entities.

    Of N documents let e occur in c(e), t in c(t), and both in c(t, e), wherever they are in
    the text. The term discloses the entity if their pointwise mutual information
    log(N c(t,e) / (c(t) c(e))) is positive and reaches ``theta`` times the entity's own
    information log(N / c(e)). For an entity of one document this is the term's own
    information log(N / c(t)) against log N.

    c(t, e) lies between 1 and the lesser of c(t) and c(e). Where 1 is enough, or the
    greatest value is not, the pair is decided without counting; only the others are paired.
    """
    if not 0 <= theta <= 1:
        raise ValueError("theta must lie between 0 and 1")
    hits = base.where("_hit")
    entity = F.concat(*(_each(k, lambda s, k: F.struct(F.lit(k).alias("kind"), F.lower(s["value"]).alias("entity"))) for k in KINDS))
    entities = hits.select("_row", F.explode(F.array_distinct(entity)).alias("e")).select("_row", "e.*")
    c_e = materialize(entities.groupBy("kind", "entity").agg(F.count("*").alias("c_e")), "entities")
    most = c_e.agg(F.max("c_e")).first()[0] or 1
    n = F.lit(docs.count()).cast("double")
    at_most = lambda c_t, e: _reveals(n, F.least(c_t, e), c_t, e, theta)
    c_t = docs.select(F.explode(_words(text, shortest)).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))
    c_t = materialize(c_t.where(at_most(F.col("c_t"), F.lit(most))), "terms")
    # An entity of one document is paired once at most, so it is decided without counting,
    # and of all a row's entities the rarest is the first that a term reveals.
    shared = F.when(F.col("c_e") > 1, F.struct("kind", "entity", "c_e"))
    by_row = entities.join(c_e, ["kind", "entity"]).groupBy("_row").agg(
        F.min("c_e").alias("least"), F.collect_list(shared).alias("shared")
    )
    terms = hits.select("_row", F.explode(_words(text, shortest)).alias("term")).join(c_t, "term")
    sure = lambda least: _reveals(n, F.lit(1), F.col("c_t"), least, theta)
    judged = (
        materialize(terms, "candidates").join(materialize(by_row, "by_row"), "_row")
        .select(
            "_row", "term", "c_t",
            sure(F.col("least")).alias("sure"),
            F.filter("shared", lambda e: ~sure(e["c_e"]) & at_most(F.col("c_t"), e["c_e"])).alias("open"),
        )
        .where("sure or size(open) > 0")
    )
    judged = materialize(judged, "judged")
    pairs = judged.select("_row", "term", "c_t", F.explode("open").alias("e")).select("_row", "term", "c_t", "e.*")
    together = pairs.groupBy("term", "kind", "entity", "c_t", "c_e").agg(F.count("*").alias("c_te"))
    told = together.where(_reveals(n, F.col("c_te"), F.col("c_t"), F.col("c_e"), theta)).select("term", "kind", "entity")
    told = pairs.join(materialize(told, "told"), ["term", "kind", "entity"]).select("_row", "term")
    found = judged.where("sure").select("_row", "term").unionByName(told)
    return found.groupBy("_row").agg(F.collect_set("term").alias("_told"))


def _found(docs: DataFrame, text: Column) -> DataFrame:
    """Base spans of every row, and a number of the row."""
    base = docs.withColumns({f"_{k}": c for k, c in base_spans(text).items()})
    base = base.withColumn("_hit", sum(F.size(f"_{k}") for k in KINDS) > 0)
    return base.withColumn("_row", F.monotonically_increasing_id())


def _buckets(items: Column, k: Column, belongs) -> Column:
    """``k`` arrays of the items for which ``belongs(item, number)``."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.filter(items, lambda x: belongs(x, i)))


def _occurrences(text: Column, index: Column) -> Column:
    """Spans of all occurrences of the terms in ``index`` that do not lie inside a base span.

    ``index`` holds about the root of their number of arrays of terms, by hash, and of base
    spans, by place: a word is compared with one array of each.
    """
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.split(text, TERM, -1)
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    terms, own, wide = index["terms"], index["own"], index["wide"]

    def add(acc, x):
        a = acc["at"] + x["g"]
        b = a + F.length(x["m"])
        span = F.struct(a.alias("start"), b.alias("end"), F.lit("").alias("value"))
        word = F.lower(x["m"])
        told = F.array_contains(F.get(terms, F.pmod(F.xxhash64(word), F.size(terms)).cast("int")), word)
        return F.struct(b.alias("at"), F.when(told, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    spans = F.aggregate(both, start, add, lambda acc: acc["out"])
    near = lambda s: F.get(own, F.floor(s["start"] / wide).cast("int"))
    return F.filter(spans, lambda s: ~F.exists(near(s), lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])))


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once for a row and not at each use in a lambda."""
    return F.transform(F.array(value), fn)[0]


def _index(text: Column) -> Column:
    """The row's terms and base spans as :func:`_occurrences` reads them."""
    root = lambda n: F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("int")
    own = F.concat(*(F.col(f"_{k}") for k in KINDS))
    n_own = root(sum(F.size(f"_{k}") for k in KINDS))
    known = F.struct(
        own.alias("own"), root(F.size("_told")).alias("n_terms"), n_own.alias("n_own"),
        (F.floor(F.length(text) / n_own) + 1).alias("wide"),
    )
    covers = lambda s: lambda o, i: (o["start"] < (i + 1) * s["wide"]) & (o["end"] > i * s["wide"])
    return _let(
        known,
        lambda s: F.struct(
            _buckets(F.col("_told"), s["n_terms"], lambda t, i: F.pmod(F.xxhash64(t), s["n_terms"]) == i).alias("terms"),
            _buckets(s["own"], s["n_own"], covers(s)).alias("own"),
            s["wide"].alias("wide"),
        ),
    )


def _with_terms(base: DataFrame, terms: DataFrame, text: Column) -> DataFrame:
    """Rows with a base span get their term spans; the others take no part in the join."""
    none = F.array().cast(_SPANS)
    hits = base.where("_hit").join(terms, "_row", "left")
    spans = _let(_index(text), lambda index: _occurrences(text, index))
    hits = hits.withColumn("_term", F.when(F.col("_told").isNotNull(), spans).otherwise(none)).drop("_told")
    return hits.unionByName(base.where("not _hit").withColumn("_term", none))


def _joined(kinds) -> Column:
    names = (_each(k, lambda s, k: F.concat_ws(":", F.lit(k), s["start"], s["end"])) for k in kinds)
    return F.array_join(F.concat(*names), ",")


def find_private(
    docs: DataFrame,
    theta: float = 0.8,
    shortest: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans of personal data and of disclosing terms in every whole text.

    Per input row: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``n_term``,
    ``base`` (spans of the fixed kinds as kind:start:end, by kind, then start) and ``spans``
    (terms after them). Places are code points, ends exclusive. A null text is an empty
    one; repeated rows repeat and count as documents of their own; other columns are ignored.

    Candidates are all terms of ``shortest`` letters or more of a text with an entity; see
    :func:`_disclosing` for what reveals. A term that reveals an entity has a span at each
    of its occurrences in the documents with that entity. All counts are over all
    documents. Only rows with a span enter joins by row.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = materialize(_found(rows, text).withColumn("_text", F.when(F.col("_hit"), text)), "private")
    terms = _disclosing(base, rows, text, theta, shortest)
    return _with_terms(base, terms, text).select(
        F.col("_id").alias(id_col),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ORDER),
        _joined(KINDS).alias("base"),
        _joined(ORDER).alias("spans"),
    )


def sanitise(
    docs: DataFrame,
    theta: float = 0.8,
    shortest: int = 4,
    text_col: str = "text",
) -> DataFrame:
    """The documents with their spans generalised to the kind, as ``[EMAIL]``, and disclosing
    terms to ``[TERM]``. Overlapping spans become one, named after the first. Texts without a
    span, null ones too, and all other columns stay as they are, whatever their names."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    # Inside one struct the caller's columns cannot meet the working ones.
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.col(text_col).alias("_text"), F.struct(F.lit(0).alias(" "), *rest).alias("_rest"))
    base = materialize(_found(rows, text), "private")
    terms = _disclosing(base, rows, text, theta, shortest)
    named = F.concat(
        *(
            _each(k, lambda s, k: F.struct(s["start"].alias("a"), F.lit(ORDER.index(k)).alias("i"), s["end"].alias("b"), F.lit(k).alias("k")))
            for k in ORDER
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["a"] - acc["at"], F.lit(0)))
        mark = F.concat(gap, F.lit("["), F.upper(s["k"]), F.lit("]"))
        out = F.when(s["a"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(mark)))
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), out.alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    masked = F.aggregate(F.array_sort(named), start, add, done)
    done_text = F.when(F.col("_hit"), masked).otherwise(F.col("_text"))
    out = _with_terms(base, terms, text)
    return out.select(*(done_text.alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns))
