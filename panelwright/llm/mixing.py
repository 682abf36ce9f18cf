"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

For each source the document rates r minimise the entropy sum r ln r - r under sum r * size = target and r <= cap.
The dual has one multiplier per source, r = min(cap, exp(x * size / scale)). Its Newton iterations are distributed rounds
over the counts of (source, size), for all sources at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.scratch import stored

WEIGHTS = (5.0, 2.0, 1.0)
NEWTON_STEPS = 60
CLOSE = 1e-9
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, none above ``cap`` times its source.

    Sources by code point, null last, take the weights in turn. The excess over a cap is dealt again by weight
    until no target is above, which is the water level m with sum min(cap * size, weight * m) = share * total.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("level", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy()
    per = per.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open": F.sum("weight").over(after), "all": F.sum(F.col("source_size").cast("double")).over(total)})
    # the level that would hold if exactly the sources before this one were full; the true one is the greatest
    per = per.withColumn("m", (share * F.col("all") - F.col("full")) / F.col("open"))
    target = F.least("most", F.col("weight") * F.max("m").over(total))
    return per.select("source", "source_size", target.alias("target"))


def of_source(df: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """``df`` with the facts of its source; null is a source as any other. Spark broadcasts them where they measure small."""
    return df.join(facts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def tilts(sizes: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """(source, scale, tilt): the dual solution of each source, by guarded Newton steps.

    Documents of equal size share a rate, so a source is handled as its counts of sizes. Each round sums the dual's
    gradient and curvature over the counts of all open sources, with partial sums where the counts lie, and moves every
    source's multiplier; a source is done when its words are within ``CLOSE`` of its target, after ``NEWTON_STEPS`` rounds at
    the latest. A target at its cap needs no tilt: null, every rate is ``cap``.
    """
    counts = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("double").alias("n")), "counts")
    scale = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    full = F.col("target") >= cap * F.col("source_size").cast("double") * (1 - 1e-12)
    begun = of_source(scale, targets, "inner").select("source", "scale", "target", F.when(~full, 0.0).alias("x"), F.lit(-1000.0).alias("lo"), F.lit(1000.0).alias("hi"), full.alias("done"))
    state = stored(begun, "multipliers")
    z = F.col("size") / F.col("scale")
    rate = F.exp(F.least(F.col("x") * z, F.lit(50.0)))
    words = F.col("size") * F.col("n")
    own = [F.any_value(c).alias(c) for c in ("scale", "target", "x", "lo", "hi")]
    miss = F.col("f") - F.col("target")
    for _ in range(NEWTON_STEPS):
        live = state.where("not done")
        if live.isEmpty():
            break
        sums = of_source(counts, live, "inner").groupBy("source").agg(*own, F.sum(words * F.least(rate, F.lit(cap))).alias("f"), F.sum(F.when(rate < cap, words * z * rate).otherwise(0.0)).alias("g"))
        # the dual's gradient rises with x: keep the bracket, take Newton's point where it lies inside
        sums = sums.withColumns({"low": F.when(miss < 0, F.col("x")).otherwise(F.col("lo")), "high": F.when(miss < 0, F.col("hi")).otherwise(F.col("x"))})
        sums = sums.withColumn("newton", F.when(F.col("g") > 0, F.col("x") - miss / F.col("g")))
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        close = F.abs(miss) <= CLOSE * F.col("target")
        to = F.when(close, F.col("x")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        moved = sums.select("source", "scale", "target", to.alias("x"), F.col("low").alias("lo"), F.col("high").alias("hi"), close.alias("done"))
        state = stored(state.where("done").unionByName(moved), "multipliers")
    return state.select("source", "scale", F.round("x", 10).alias("tilt"))  # sums may differ in their last bits from run to run


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, taken): how often each document enters the mix.

    The columns ``carry`` come along as ``carried_<name>``: they are neither stored nor shuffled, but for the rows at
    the cut. One row per row of ``docs``; repeated rows and rows without a key are dealt with one by one.

    Rates are rounded to whole copies by sequential Poisson sampling: a document's fraction f is rounded up in
    the order of u / f, u a hash of its key (of its text where it has none), until the source's words reach the target; the document at the
    cut goes to the nearer side. So a source's ``taken`` misses its target by half a document at most, reruns
    agree, and no document exceeds ``cap`` (a whole number) times its size. Null text has size 0, null sources
    are one source, sizeless documents get no copies; an empty table gives an empty table.

    The running sum is taken over ``BINS`` sums per source; only the bin at the cut is ordered row by row. Other columns of ``docs``
    aren't read, so their names may clash with any here; texts of any length are counted where they lie.
    """
    draw = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"), F.lit("mix"))).otherwise(F.xxhash64(F.col(text), F.lit("mix")))
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw.alias("draw"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    base = stored(rows.select("key", "source", "size", "draw"), "sizes")
    targets = stored(source_targets(base, weights, share, cap), "targets")
    per = stored(of_source(targets, tilts(base, targets, cap)), "tilts")

    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    u = (F.pmod("draw", F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    turn = F.when(F.col("f") > 1e-9, u / F.col("f"))

    def rated_rows(df: DataFrame) -> DataFrame:
        df = of_source(df, per).withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("f", F.col("rate") - F.col("whole"))
        # half of all turns lie below 1/2, so turn / (1 + turn) spreads them over the bins
        return df.withColumn("turn", turn).withColumn("bin", F.floor(BINS * F.col("turn") / (1 + F.col("turn"))).cast("int"))
    sums = rated_rows(base).groupBy("source", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).alias("up"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    own = Window.partitionBy("source")
    sums = sums.withColumn("need", F.col("target") - F.sum("sure").over(own)).where("bin is not null")
    sums = sums.withColumn("through", F.sum("up").over(own.orderBy("bin")))
    cut = sums.groupBy("source").agg(F.min(F.when(F.col("through") >= F.col("need"), F.col("bin"))).alias("cut"), F.max("need").alias("need"))
    below = sums.join(cut.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s"))).where("bin < cut").groupBy("source").agg(F.sum("up").alias("below"))
    cut = cut.join(below.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "cut", (F.col("need") - F.coalesce("below", F.lit(0))).alias("left"))
    rated = of_source(rated_rows(rows if carry else base), stored(cut, "cuts"))
    at = rated.where("bin = cut")
    ties = [F.xxhash64(*[f"carried_{c}" for c in carry])] if carry else []
    running = F.sum("size").over(own.orderBy(F.desc("size"), "turn", "key", *ties).rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumn("run", running).withColumn("extra", (F.col("run") - F.col("size") / 2.0) <= F.col("left"))
    plain = rated.where("bin is null or cut is null or bin <> cut").withColumn("extra", F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))))
    out = plain.unionByName(at.drop("run")).withColumn("copies", (F.col("whole") + F.col("extra").cast("long")).cast("long"))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[f"carried_{c}" for c in carry])
