"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only column functions are used. A document is repeated ``whole`` times, and once more when its seeded number is at
most the cut of its source (of its copies at the cut itself, a part). The cut is found from sums over 4,096 number ranges per source and then inside one range,
so a source with a third of all rows is never put in order by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.numbering import ranked
from foliant.session import written

#: Words are runs of characters other than blank and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_RANGE_BITS = 12


def word_count(text: Column) -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_number(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits that depend on the seed, the id and the text, so reruns and lost tasks take the same documents. Only rows
    that repeat a document in full have the same number."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add ``target``: shares of the total size by weight, none above ``max_epochs`` times its source's size.

    ``sources`` has size and weight, one row a source, and should be a stored table. A round clamps the sources whose
    share reaches the cap and shares what is left among the others; it ends when no further source is clamped. Each
    round brings one row of sums to the driver.
    """
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cap = F.col("size") * max_epochs
    left, weights, clamped = total, None, -1
    full = F.lit(False)
    while True:
        sums = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count(F.when(full, 1)),
        ).first()
        left, weights = total - sums[0], sums[1]
        if sums[2] == clamped or not weights:
            break
        clamped = sums[2]
        full = cap.cast("double") <= (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(weights))
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(share))


def mixing_plan(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row a source: source, source_size, target, whole, cut, rows and part.

    ``sized`` has source, size and number. Sources take ``weights`` in turn by code point, NULL last. The cut is the last number
    at which the words taken so far, counted to the middle of a document, do not pass what is wanted beyond the whole
    repetitions. ``rows`` documents have that number (they are copies of one another), and ``part`` of them are taken.
    """
    present = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("size"))
    keyed = present.withColumn("last", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit("")))
    turn = (F.col("rank") - 1) % len(weights) + 1
    in_turn = ranked(keyed, [], [F.col("last"), F.col("name")]).select(
        "source", "size", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), turn.cast("int")).alias("weight")
    )
    filled = water_fill(written(in_turn, "mix-sources"), max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("bigint")
    plan = filled.withColumn("whole", whole).withColumn("want", F.col("target") - F.col("whole") * F.col("size"))

    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    bucket = F.shiftright("number", 60 - _RANGE_BITS)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edge = written(
        plan.alias("a").join(placed.alias("b"), same).where("b.before <= a.want").groupBy("a.source").agg(
            F.max("bucket").alias("bucket"),
            F.max("before").alias("before"),
            F.first("size").alias("source_size"),
            F.first("target").alias("target"),
            F.first("whole").alias("whole"),
            F.first("want").alias("want"),
        ).select("a.source", "bucket", "before", "source_size", "target", "whole", "want"),
        "mix-edge",
    )
    units = (
        sized.withColumn("bucket", bucket).alias("a")
        .join(edge.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket")))
        .groupBy("a.source", "a.number")
        .agg(F.sum("a.size").alias("words"), F.count("*").alias("rows"), F.first("b.before").alias("before"), F.first("b.want").alias("want"))
        .select("source", "number", "words", "rows", "before", "want")
    )
    earlier = Window.partitionBy("source").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("start")
    reached = units.select("source", "number", "words", "rows", "want", start)
    # The j-th copy is taken when its middle, start + (j - 1/2) * words / rows, is not beyond what is wanted.
    middle = F.floor((F.col("want") - F.col("start")) * F.col("rows") / F.col("words") + 0.5)
    part = F.when(F.col("words") == 0, F.when(F.col("start") <= F.col("want"), F.col("rows")).otherwise(F.lit(0))).otherwise(F.least(middle, F.col("rows")))
    taken = reached.withColumn("part", part.cast("bigint")).where("part >= 1")
    cuts = taken.groupBy("source").agg(F.max("number").alias("cut"), F.max_by("rows", "number").alias("rows"), F.max_by("part", "number").alias("part"))
    below = F.shiftleft(F.col("a.bucket"), 60 - _RANGE_BITS) - 1
    return written(
        edge.alias("a").join(cuts.alias("b"), same, "left").select(
            "a.source", "a.source_size", "a.target", "a.whole", F.coalesce(F.col("b.cut"), below).alias("cut"),
            F.coalesce("b.rows", F.lit(0)).alias("rows"), F.coalesce("b.part", F.lit(0)).alias("part"),
        ),
        "mix-plan",
    )


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with __number and __row_source) and how often each is taken, as __copies."""
    joined = rows.join(
        plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns}), F.col("__row_source").eqNullSafe(F.col("__source"))
    )
    every = joined.withColumn("__copies", F.col("__whole") + (F.col("__number") <= F.col("__cut")).cast("bigint"))
    if plan.where("part < rows").isEmpty():  # one row a source
        return every
    # Copies of one document of which only a part is taken once more: any of them, so they are numbered as they come.
    split = (F.col("__number") == F.col("__cut")) & (F.col("__part") < F.col("__rows"))
    named = {"__none": F.col("__row_source").isNull(), "__name": F.coalesce("__row_source", F.lit("")), "__tie": F.monotonically_increasing_id()}
    copies = ranked(joined.where(split).withColumns(named), ["__none", "__name"], [F.col("__tie")], "__rank")
    some = copies.withColumn("__copies", F.col("__whole") + (F.col("__rank") <= F.col("__part")).cast("bigint")).select(*every.columns)
    return every.where(~split).unionByName(some)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source) and taken words.

    NULL or blank texts have size 0 and take nothing. NULL sources are one source. Repeated rows, and rows with a repeated or
    NULL id, are documents of their own; of rows that repeat a document in full it does not matter which are taken. Texts of
    any length are counted where they lie; other columns are not read. An empty table gives an empty result.
    """
    number = seeded_number(F.col("doc_id"), F.col("text"), seed)
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), number.alias("number")), "mix-sizes")
    plan = mixing_plan(sized, weights, max_epochs)
    rows = sized.withColumnsRenamed({"number": "__number", "source": "__row_source"})
    return _with_copies(rows, plan).select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with.

    Documents without words are part of no target; they stay once if their source is taken at all by its number, as
    any other document of it. Texts are read where they lie: only the plan, one row a source, is joined to them. Repeated
    rows are documents of their own. Columns whose names begin with two underscores are reserved; an empty table
    gives an empty result.
    """
    number = seeded_number(F.col("doc_id"), F.col("text"), seed)
    sized = written(docs.select("source", word_count(F.col("text")).alias("size"), number.alias("number")), "mix-sizes")
    plan = mixing_plan(sized, weights, max_epochs)
    taken = _with_copies(docs.withColumns({"__number": number, "__row_source": F.col("source")}), plan).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.expr("sequence(1, int(__copies))"))).select(*docs.columns)
