"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate near 1 such that the words taken from its source meet the
target.  Minimising the relative entropy of the rates under one token constraint a source
and the bound ``rate <= most`` has a convex dual with one variable a source; its solution
tilts the rates exponentially with the size of the document::

    rate = min(most, exp(lambda_source * size / mean size of the source))

Newton steps on the dual, kept inside a bracket, need one aggregation each over the
counts of (source, size), not over the documents.  Sums are decimal, so reruns agree.

Rates become whole copies: a systematic rounding runs through each source by size, so that
the extra copies of neighbours of about equal size make up for each other.  Its running
sums are taken inside small buckets first and then over the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, stored

#: Shares of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: One more bin in each size class of a source for so many rows of the table, beyond the first 32.
ROWS_A_BIN = 1_000_000
#: Fractions of copies are counted in units of one part in a billion.
UNIT = 1_000_000_000


def word_count(text_col: str):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, WORD_BREAK))).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, total_share: float = 1.0) -> DataFrame:
    """source, rk, n_docs, source_size, weight and target of each source.

    Targets share the total by weight.  None passes ``most`` times its source's size; what
    is cut is shared again by weight.  The sources that end at their cap are a prefix in the
    order of cap over weight, so one pass over the sorted sources finds the share.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rk", rank).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rk") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", "rk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(total_share))
    per = per.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    per = per.withColumn("share", F.col("rest") / F.col("open"))
    # The first source, in this order, whose cap is not below its share sets the share of all after it.
    per = per.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "rk", "share"))).over(everything)["share"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "rk", "n_docs", "source_size", "weight", target.alias("target"))


def balance(counts: DataFrame, targets: DataFrame, most: int = 3, tolerance: float = 1e-4, steps: int = 40) -> DataFrame:
    """rk and lam (per word) of each source: the solution of the dual."""
    state = targets.where("source_size > 0").select("rk", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), (F.col("target") >= most * F.col("source_size")).alias("full"), F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(-1e6)).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"))
    state = stored(state.withColumn("done", F.col("full") | (F.col("target") <= 0)), "dual")
    scale = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("lam") * scale, F.log(F.lit(float(most)))))
    inside = F.col("lam") * scale < F.log(F.lit(float(most)))
    for _ in range(steps):
        if state.where("not done").limit(1).count() == 0:
            break
        words = (F.col("n") * F.col("size") * tilt).cast("decimal(30,6)")
        slope = F.when(inside, F.col("n") * F.col("size") * scale * tilt).otherwise(F.lit(0.0)).cast("decimal(30,6)")
        sums = counts.join(state, "rk").where("not done").groupBy("rk").agg(F.sum(words).cast("double").alias("words"), F.sum(slope).cast("double").alias("slope"))
        new = state.join(sums, "rk", "left")
        gap = F.col("words") - F.col("target")
        new = new.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        middle = F.when((F.col("low") > -1e6) & (F.col("high") < 1e6), (F.col("low") + F.col("high")) / 2).when(gap < 0, F.greatest(F.col("lam") * 2, F.lit(1.0))).otherwise(F.least(F.col("lam") * 2, F.lit(-1.0)))
        met = F.abs(gap) <= tolerance * F.col("target")
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        new = new.select("rk", "target", "mean", "full", F.when(F.col("done") | met, F.col("lam")).otherwise(step).alias("lam"), "low", "high", (F.col("done") | F.coalesce(met, F.lit(True))).alias("done"))
        state = stored(new, "dual")
    return state.select("rk", "mean", "full", "lam")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    seed: int = 0,
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, rate, source and text_hash, one row per row.

    A null text has size 0 and a null source is a source of its own, ranked last.  Documents
    of size 0 are taken once, with no words.  Repeated rows are rounded each.  Ties in the
    rounding order are broken by a seeded hash of id and text, then they do not matter: equal
    rows are interchangeable.  An empty table gives an empty result, and other columns of
    ``docs`` are ignored.  All documents of a source at its cap are taken ``most`` times.
    ``row_col``, a value of its own for each row, comes back as ``row``.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), *([F.col(row_col).alias("rid")] if row_col else []))
    sizes = stored(source if row_col else source.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    targets = stored(source_targets(sizes, weights, most), "targets")
    ranked = sizes.join(targets.withColumnRenamed("source", "source_of"), sizes["source"].eqNullSafe(F.col("source_of"))).drop("source_of")
    counts = stored(ranked.groupBy("rk", "size").agg(F.count(F.lit(1)).alias("n")).where("size > 0"), "counts")
    solved = balance(counts, targets, most)
    rated = ranked.join(solved, "rk", "left")
    cap = F.lit(float(most))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), cap).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.least(cap, F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(2.0 * most)))))
    units = F.round(rate * UNIT).cast("bigint")
    rated = rated.withColumn("rate", rate).withColumn("units", units).withColumn("frac", F.col("units") % UNIT)
    rated = rated.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int")).withColumn("order", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")))
    # A window has a size class and a bin of one source; bins grow with the rows.
    bins_a_class = max(32, sizes.count() // ROWS_A_BIN)
    rated = rated.withColumn("bin", F.pmod("order", F.lit(bins_a_class)).cast("int"))
    bins = rated.groupBy("rk", "class", "bin").agg(F.sum("frac").alias("inside"))
    before = Window.partitionBy("rk").orderBy("class", "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("rk", "class", "bin", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("base"))
    run = Window.partitionBy("rk", "class", "bin").orderBy("size", "order", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    rated = rated.join(bins, ["rk", "class", "bin"]).withColumn("upto", F.col("base") + F.sum("frac").over(run) + UNIT // 2)
    rated = rated.withColumn("copies", F.expr(f"units div {UNIT} + (upto div {UNIT} - (upto - frac) div {UNIT})"))
    rated = stored(rated.select("rid", "rk", "doc_id", "size", "source_size", "target", "copies", "rate", "source", "text_hash", "order"), "rated")
    change = evened(rated, most)
    copies = F.col("copies") + F.coalesce("change", F.lit(0))
    rated = rated.join(change, "rid", "left").withColumn("copies", copies)
    return rated.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rate", "source", "text_hash", *([F.col("rid").alias("row")] if row_col else []))


def evened(rated: DataFrame, most: int, passes: int = 8) -> DataFrame:
    """rid and change of the documents that get one copy more or less to meet the targets closely.

    Each pass changes one document a source: the largest that still fits into what its
    source has too much or too little.  So there are at most ``passes`` changes a source.
    """
    gaps = stored(rated.groupBy("rk").agg((F.sum(F.col("copies") * F.col("size")) - F.round(F.first("target"))).cast("bigint").alias("gap")), "gaps")
    changes = None
    for _ in range(passes):
        open_ = rated if changes is None else rated.join(changes.select("rid"), "rid", "left_anti")
        fits = open_.join(gaps, "rk").where((F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") > 0).otherwise(F.col("copies") < most))
        picked = fits.groupBy("rk").agg(F.max(F.struct("size", "order", "rid", "gap")).alias("p"))
        picked = stored(picked.select("rk", F.col("p.rid").alias("rid"), F.when(F.col("p.gap") > 0, -1).otherwise(1).alias("change"), F.col("p.size").alias("size")), "picked")
        if picked.limit(1).count() == 0:
            break
        changes = picked.select("rid", "change") if changes is None else changes.unionByName(picked.select("rid", "change"))
        gaps = stored(gaps.join(picked, "rk").select("rk", (F.col("gap") + F.col("change") * F.col("size")).alias("gap")), "gaps")
    if changes is None:
        return rated.select("rid", F.lit(0).alias("change")).limit(0)
    return changes
