"""How filters of a corpus overlap: what each removes, in every order they can be applied.

A document enters only as the set of filters it fails, a mask. Documents are counted per
part and mask, and each of these few cells is folded over all orders by higher-order SQL
functions, so the cost of the orders does not depend on the number of documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.llm.common import table_columns
from basinframe.llm.repeats import stored

#: Counts of one filter at one step of one order.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Rules on one text: A under 100 words, B under 80 % distinct words, C over 10 %
    capitals A-Z, D any of ``#$%&*|``. Words are runs of other than ASCII white space."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    capitals = F.length(text) - F.length(F.translate(text, letters, ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (id, part, mask) of every document: bit k of the mask is set if filter k of ABCDE fails.

    Filter E fails a text that also stands under a smaller id. The least id of a text is
    found by partial minima, and rows meet it by text and id together, so that a text
    which a third of all rows share is never one task. A null text is an empty one, a null
    part the empty string; a row without an id does not fail E and fails nobody else.
    """
    own = table_columns(docs, id=id_col, text=text_col, part=part_col)
    text = F.coalesce("text", F.lit(""))
    bits = sum((fails.cast("int") * (1 << k) for k, fails in enumerate(text_failures(text).values())), F.lit(0))
    rows = own.select(
        "id", F.coalesce("part", F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("key")
    )
    rows = stored(rows, "masks")
    first = rows.where("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["key", "id"], "left").select("id", "part", (F.col("mask") + again.cast("int") * 16).alias("mask"))


def order_audit(cells: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Rows (part, filter_order, step, measures, shapley) from counts per part and mask.

    ``cells`` has part, mask, n, good and toxic, one row per part and mask. Each cell is
    folded along every order: an aggregate carries whether its documents are still there,
    and appends one struct of weighted counts per step. The arrays of a part (at most one
    per mask) are summed element by element. ``shapley`` is what the step's filter removes
    in all orders together.
    """
    places = list(permutations(range(len(filters))))
    bits = [1 << k for k in range(len(filters))]
    orders = F.lit([[bits[k] for k in p] for p in places])
    names = F.lit(["".join(filters[k] for k in p) for p in places])

    def fold(order: Column) -> Column:
        def step(state: Column, bit: Column) -> Column:
            alive = state["alive"]
            fails = F.col("mask").bitwiseAND(bit) != 0
            gone = alive & fails
            one = lambda test, n: F.when(test, F.col(n)).otherwise(0).cast("long")
            counts = F.struct(
                bit.alias("bit"),
                one(alive & ~fails, "n").alias("kept"),
                one(gone, "n").alias("removed"),
                one(~alive & fails, "n").alias("redundant"),
                one(F.col("mask") == bit, "n").alias("unique_fails"),
                one(gone, "good").alias("good_lost"),
                one(gone, "toxic").alias("toxic_lost"),
            )
            return F.struct((alive & ~fails).alias("alive"), F.array_append(state["steps"], counts).alias("steps"))

        kinds = "bit:int," + ",".join(f"{m}:bigint" for m in MEASURES)
        start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<struct<{kinds}>>").alias("steps"))
        return F.aggregate(order, start, step, lambda s: s["steps"])

    def add(a: Column, b: Column) -> Column:
        return F.struct(a["bit"].alias("bit"), *((a[m] + b[m]).alias(m) for m in MEASURES))

    folded = cells.select("part", F.flatten(F.transform(orders, fold)).alias("steps"))
    total = folded.groupBy("part").agg(F.collect_list("steps").alias("all"))
    rest = F.slice("all", 2, F.size("all"))
    merged = total.select("part", F.aggregate(rest, F.col("all")[0], lambda a, b: F.zip_with(a, b, add)).alias("steps"))
    removed = lambda bit: F.aggregate(
        "steps", F.lit(0).cast("long"), lambda s, x: s + F.when(x["bit"] == bit, x["removed"]).otherwise(0)
    )
    merged = merged.withColumn("shapley", F.transform(F.lit(bits), removed))
    rows = merged.select("part", "shapley", F.posexplode("steps").alias("at", "own"))
    order = F.floor(F.col("at") / len(filters)).cast("int")
    return rows.select(
        "part",
        F.get(names, order).alias("filter_order"),
        (F.col("at") % len(filters) + 1).cast("int").alias("step"),
        *(F.col(f"own.{m}").alias(m) for m in MEASURES),
        F.element_at("shapley", F.array_position(F.lit(bits), F.col("own.bit")).cast("int")).alias("shapley"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Audit of the filters A to E over all documents, per part, order and step.

    ``labels`` (doc_id, quality, toxic) marks good and toxic documents; of several rows of
    one id any that marks it counts, and unlabelled documents are neither. Repeated rows
    count as often as they stand there; no documents give no rows; parts are whatever the
    column holds. Only ids, masks and digests of texts are shuffled, so long texts cost
    what reading them costs. Other columns are ignored.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failure_masks(docs, id_col, text_col, part_col).join(marks, "id", "left")
    cells = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )
    return order_audit(cells)
