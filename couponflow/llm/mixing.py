"""Mix sources to target weights by capped water-filling.

Every source has a size (words) and a weight. A budget of words is shared out by weight; a source
whose share is over ``max_epochs`` times its size is clamped there, and what it cannot take is
shared out again by weight among the others, until no share is above its cap. With sources in
order of cap / weight, the clamped ones are a prefix, so the fixed point of the rounds is found
with one running sum over the table of sources: the highest level that any prefix gives.

A target of r times the size is met by floor(r) whole repetitions of all documents and one more
of a part of them. That part is the head of the source's documents in the order of a seeded
hash, cut where its words come nearest to what is missing. The cut is found on hash ranges:
first the range by sums per (source, range), then the row inside this one range, so no source is
ever sorted or held as a whole.

Cases: a null text has size 0; a null source is a source of its own (last in order); equal rows
each count; documents of size 0 take part in the order and add no words; an empty table gives an
empty mix. Extra columns are ignored by :func:`shares` and kept by :func:`materialize`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from couponflow.llm import words
from couponflow.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
#: Hash ranges per source. Hex digits of the hash that name the range: 16 ** 3.
RANGE_DIGITS = 3


def draw(doc_id: Column | str, seed: int) -> Column:
    """Seeded position of a document in its source's order: 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, draw`` of every document."""
    return docs.select(
        "doc_id", "source", words.count("text").alias("size"), draw("doc_id", seed).alias("draw")
    )


def targets(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """One row per source: ``source, source_size, target`` (words).

    The windows run over one row per source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    turn = ((F.row_number().over(in_order) - 1) % len(weights)).cast("int")
    sources = sources.select("source", "source_size", F.get(cycle, turn).alias("weight"))
    cap = F.col("source_size") * max_epochs
    everything = Window.partitionBy()
    # Sources that reach their cap at a lower water level come first.
    rising = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    from_here = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.col("clamped")) / F.col("open_weight")
    return (
        sources.withColumn("cap", cap)
        .withColumn("budget", F.sum("source_size").over(everything) * total_share)
        .withColumn("clamped", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(from_here))
        # With one source too few or too many clamped, the rest would get a lower level.
        .withColumn("level", F.max(level).over(everything))
        .withColumn(
            "target",
            F.least("cap", F.col("level") * F.col("weight")),
        )
        .select("source", "source_size", F.round("target", 6).alias("target"))
    )


def shares(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every document.

    ``copies`` is how often the mix repeats the document; 0 leaves it out.
    """
    rows = stage(sized(docs, seed), "mix-sizes")
    per_source = targets(rows, weights, total_share, max_epochs)
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    plan = per_source.withColumn("whole", whole.cast("long")).withColumn(
        "missing", F.col("target") - F.col("whole") * F.col("source_size")
    )
    plan = stage(plan, "mix-targets")
    bucket = F.substring("draw", 1, RANGE_DIGITS)
    ranges = (
        rows.groupBy("source", bucket.alias("range"))
        .agg(F.sum("size").alias("words"))
        .withColumn(
            "before",
            F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words"),
        )
    )
    # The range in which the running sum passes the missing words.
    cut = (
        ranges.join(plan, ranges.source.eqNullSafe(plan.source))
        .where((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("words") > F.col("missing")))
        .select(plan.source.alias("cut_source"), F.col("range").alias("cut_range"), "before", "missing")
    )
    inside = rows.join(
        cut, rows.source.eqNullSafe(cut.cut_source) & (bucket == F.col("cut_range"))
    ).select("cut_source", "cut_range", "before", "missing", "draw", "doc_id", "size")
    order = Window.partitionBy("cut_source").orderBy("draw", "doc_id", "size")
    last = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # A row is in if at least half of it still fits: the sum ends nearest to what is missing.
    fits = F.col("upto") - F.col("size") / 2.0 <= F.col("missing")
    edge = (
        inside.withColumn("upto", last)
        .groupBy("cut_source")
        .agg(
            F.first("cut_range").alias("cut_range"),
            F.max(F.when(fits, F.struct("draw", "doc_id", "size"))).alias("last_in"),
        )
    )
    edge = stage(edge, "mix-cuts")
    plan = plan.join(edge, plan.source.eqNullSafe(edge.cut_source), "left").drop("cut_source")
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(plan, rows.source.eqNullSafe(F.col("plan_source")), "left")
    at = F.struct("draw", "doc_id", "size")
    end = F.struct("last_in.draw", "last_in.doc_id", "last_in.size")
    extra = (
        # No cut at all: the missing words are the whole source, or none of it.
        F.when(F.col("cut_range").isNull(), F.col("missing") >= F.col("source_size"))
        .when(bucket < F.col("cut_range"), F.lit(True))
        .when(bucket > F.col("cut_range"), F.lit(False))
        .otherwise(F.coalesce(at <= end, F.lit(False)))
    )
    flagged = stage(
        joined.withColumn("extra", (F.col("missing") > 0) & extra).select(
            *("doc_id", "source", "size", "draw", "source_size", "target", "whole", "missing", "extra")
        ),
        "mix-flags",
    )
    swap = _swap(flagged)
    final = flagged.join(swap, flagged.source.eqNullSafe(swap.swap_source), "left")
    turned = F.coalesce(at.eqNullSafe(F.col("swap")), F.lit(False))
    copies = F.col("whole") + (F.col("extra") != turned).cast("long")
    return final.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def _swap(flagged: DataFrame) -> DataFrame:
    """``swap_source, swap``: the one document per source to add or leave out after the cut.

    The cut misses its target by up to half a document, and documents may be long. The document
    whose size is nearest to the miss makes up for it, if that brings the sum nearer.
    """
    taken = F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))
    misses = flagged.groupBy(F.col("source").alias("miss_source")).agg(
        (F.max("missing") - taken).alias("miss")
    )
    rows = flagged.join(misses, flagged.source.eqNullSafe(misses.miss_source))
    left = F.abs(F.abs("miss") - F.col("size"))
    usable = (F.col("extra") == (F.col("miss") < 0)) & (left < F.abs("miss"))
    nearest = F.min(F.struct(left.alias("left"), "draw", "doc_id", "size"))
    return (
        rows.where(usable)
        .groupBy(F.col("source").alias("swap_source"))
        .agg(nearest.alias("nearest"))
        .select("swap_source", F.struct("nearest.draw", "nearest.doc_id", "nearest.size").alias("swap"))
    )


def materialize(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as often as its ``copies`` says, with ``docs``' columns.

    The count follows from ``doc_id``, source and size, so equal rows are repeated alike.
    """
    columns = docs.columns
    rate = (
        shares(docs, **settings)
        .groupBy("doc_id", "source", F.col("size").alias("_size"))
        .agg(F.max("copies").alias("_copies"))
    )
    keyed = docs.withColumn("_size", words.count("text"))
    joined = keyed.alias("d").join(
        rate.alias("r"),
        F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
        & F.col("d.source").eqNullSafe(F.col("r.source"))
        & (F.col("d._size") == F.col("r._size")),
    )
    repeated = joined.where(F.col("r._copies") > 0).select(
        *[F.col(f"d.`{c}`") for c in columns],
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("r._copies"))).alias("_repetition"),
    )
    return repeated.drop("_repetition")
