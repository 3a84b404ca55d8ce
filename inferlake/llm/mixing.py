"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Each source gets a share of a word budget in proportion to its weight. A source is
clamped at ``max_epochs`` times its own size, and what it cannot take is dealt again to
the others by weight, until no target is above its cap. A document of a source that is
repeated r times is taken floor(r) times whole; the fraction is filled with whole
documents in a seeded order, and the one document where the fraction ends is taken in
part, so that every source meets its target to the word.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of
its own, after all others; equal rows and equal ids are dealt one by one; an empty table
gives an empty plan; a budget above all caps stops at the caps. Extra columns are kept, whatever their names, but
for those that have the name of a column that the plan adds (``MIX_*`` below); ``mix`` keeps these, too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_name, staged

WORD = r"[^\x20\x09-\x0D]+"
#: A document's place in its source's order is a hash, cut into this many intervals:
#: only the interval in which a source's fraction ends is sorted row by row.
INTERVAL_DIGITS = 3
#: The columns that ``mixing_plan`` adds.
SIZE, SOURCE_SIZE, TARGET, WHOLE, PART = (
    "MIX_size", "MIX_source_size", "MIX_target", "MIX_whole", "MIX_part")
_KEY, _PLACE, _CUT, _EXTRA, _COPY = "MIX_source", "MIX_place", "MIX_cut", "MIX_extra", "MIX_copy"
_ADDED, _OWN = (SIZE, SOURCE_SIZE, TARGET, WHOLE, PART), (_KEY, _PLACE, _CUT, _EXTRA, _COPY)


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A source as a join key that tells null from every string; it sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))


def _aside(docs: DataFrame) -> dict[str, str]:
    """Other names for the input columns that have a name of this module."""
    names = {c.lower() for c in (*_ADDED, *_OWN)}
    return {c: free_name(docs, f"MIX_aside_{k}") for k, c in enumerate(docs.columns) if c.lower() in names}


def source_ranks(sizes: DataFrame) -> DataFrame:
    """Number the sources from 0 in key order, without bringing them all into one task."""
    parts = staged(
        sizes.repartitionByRange(F.col(_KEY)).sortWithinPartitions(_KEY)
        .withColumn("part", F.spark_partition_id()), "mix-sources")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(_KEY))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each range partition.
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parts.withColumn("inside", inside).join(before, "part").withColumn(
        "rank", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def _wide(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def water_fill(sources: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """Add ``TARGET`` to (source key, ``total``, ``weight``) rows.

    Each pass clamps every source whose share is above its cap; as shares only grow when
    others are clamped, a clamped source stays so. A pass reads two sums from the cluster.
    """
    clamped = F.lit(False)
    cap = F.col("total") * max_epochs
    whole = sources.agg(budget.alias("b")).first()["b"] or 0
    closed = -1
    while True:
        open_weight, taken, now = sources.agg(
            F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, cap)),
            F.count(F.when(clamped, 1))).first()
        if now == closed or not open_weight:
            break
        closed = now
        rest = whole - 2 * (taken or 0)
        clamped = _wide(F.lit(rest)) * F.col("weight") > _wide(cap) * F.lit(2 * open_weight)
    share = F.when(clamped, cap.cast("double")) if not open_weight else F.when(
        clamped, cap.cast("double")).otherwise(
        (F.lit(whole - 2 * (taken or 0)) * F.col("weight")).cast("double") / F.lit(2 * open_weight))
    return sources.withColumn(TARGET, F.coalesce(share, F.lit(0.0)))


def mixing_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                weights: Sequence[int] = (3, 1, 2), budget_halves: int = 3, max_epochs: int = 2,
                seed: str = "mix") -> DataFrame:
    """``docs`` with size, target and share of every row.

    ``weights`` are dealt to the sources in code-point order, repeating; the budget is
    ``budget_halves / 2`` times all sizes. ``MIX_whole`` counts whole copies, ``MIX_part``
    the first words of one more copy.
    """
    aside = _aside(docs)
    docs = docs.withColumnsRenamed(aside)
    text, source, doc_id = (aside.get(c, c) for c in (text, source, doc_id))
    sized = docs.withColumns({
        SIZE: word_count(text), _KEY: _key(source),
        _PLACE: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))})
    narrow = staged(sized.select(_KEY, _PLACE, SIZE, F.substring(_PLACE, 1, INTERVAL_DIGITS).alias("interval"))
                    .groupBy(_KEY, "interval").agg(F.sum(SIZE).alias("words")), "mix-intervals")
    ranked = source_ranks(narrow.groupBy(_KEY).agg(F.sum("words").alias("total")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = staged(water_fill(staged(ranked.withColumn("weight", weight.cast("long")), "mix-weights"),
                               F.sum("total") * budget_halves, max_epochs), "mix-targets")
    # Words of a source beyond its whole repetitions, and the interval in which they end.
    goal = F.floor(F.col(TARGET) + 0.5).cast("long")
    repeats = F.when(F.col("total") > 0, (goal - goal % F.col("total")) / F.col("total")).otherwise(0).cast("long")
    goals = filled.withColumn("repeats", repeats).withColumn("rest", goal - repeats * F.col("total"))
    upto = F.sum("words").over(Window.partitionBy(_KEY).orderBy("interval"))
    cuts = (narrow.withColumn("upto", upto).join(goals.select(_KEY, "rest"), _KEY)
            .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            .select(_KEY, F.col("interval").alias("cut"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left")))
    goals = staged(goals.join(cuts, _KEY, "left").select(
        _KEY, F.col("total").alias(SOURCE_SIZE), TARGET,
        F.struct("repeats", "cut", "left").alias(_CUT)), "mix-goals")
    dealt = sized.join(goals, _KEY)
    interval = F.substring(_PLACE, 1, INTERVAL_DIGITS)
    inside = interval == F.col(f"{_CUT}.cut")
    # Only the rows of the cut intervals are sorted; all others are decided where they lie.
    at_cut = dealt.filter(inside)
    order = Window.partitionBy(_KEY).orderBy(_PLACE, SIZE, F.col(doc_id))
    before = F.sum(SIZE).over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.col(f"{_CUT}.left") - F.coalesce(before, F.lit(0))
    extra = F.least(F.greatest(left, F.lit(0)), F.col(SIZE))
    sorted_rows = at_cut.withColumn(_EXTRA, extra)
    other = dealt.filter(~F.coalesce(inside, F.lit(False))).withColumn(
        _EXTRA, F.when(interval < F.col(f"{_CUT}.cut"), F.col(SIZE)).otherwise(0).cast("long"))
    full = (F.col(_EXTRA) == F.col(SIZE)) & (F.col(SIZE) > 0)
    both = other.unionByName(sorted_rows)
    added = {c.lower() for c in _ADDED}
    return both.withColumns({
        WHOLE: F.col(f"{_CUT}.repeats") + full.cast("long"),
        PART: F.when(full, F.lit(0)).otherwise(F.col(_EXTRA)).cast("long"),
    }).drop(_KEY, _PLACE, _CUT, _EXTRA, *(a for c, a in aside.items() if c.lower() in added)).withColumnsRenamed(
        {a: c for c, a in aside.items() if c.lower() not in added})


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed documents, each copy a row with its text as it was.

    The document at which a source's words run out is taken whole if at least half of it is
    within the target, and not at all otherwise, so a source misses its target by half a document at most.
    """
    last = ((F.col(PART) > 0) & (2 * F.col(PART) >= F.col(SIZE))).cast("int")
    copies = F.col(WHOLE).cast("int") + last
    aside = _aside(docs)
    text, source, doc_id = (aside.get(c, c) for c in (text, source, doc_id))
    plan = mixing_plan(docs.withColumnsRenamed(aside), text, source, doc_id, **options)
    return (plan.filter(copies > 0).withColumn(_COPY, F.explode(F.sequence(F.lit(1), copies)))
            .select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns)))


def taken() -> Column:
    """Words that the mix takes of a row of the plan."""
    return F.col(WHOLE) * F.col(SIZE) + F.col(PART)
