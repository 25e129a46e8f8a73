"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the copies of it that the mix holds on average.
Among all rates between 0 and a limit whose tokens meet each source's target,
entropy balancing takes those of greatest entropy: the rate of a document of
size x in source s is limit * e^t / (1 + e^t) with t = l_s * x, where l_s is
the source's multiplier in the convex dual.  Newton steps, guarded by a
bracket, find all multipliers at once; each step is one aggregation over a
histogram of sizes, until every target is met.  Rates are rounded into copies
by carrying the remainder from size to size within a source, and what is still
missing or over is made up by copies of the best-fitting sizes until none fits.

Only DataFrame functions run here.  Documents are read once; everything but
the last step works on (source, size) counts, and copies of one size are dealt
out by hash buckets, so equal documents and large sources need no single task;
nor does any number of sources, which are numbered by a range sort and share
the mix by repeated sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.common import WORD, discard, stash, utf8

BUCKETS = 1024


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, null last; ``share`` is the mix over all sizes."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    limit: int = 2
    steps: int = 80


def _source_key(column: str = "source") -> Column:
    """A key that orders like the source with null last, and is never null."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(column).cast("string")))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(key, source_size, target) from (key, source_size): shares by weight, none above ``limit`` times its size.

    Sources whose shares stop leave the rest to the others; each round sums up
    what has stopped and finds the level of the others, until none is above.
    Two numbers a round reach the driver.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = stash(sizes.repartitionByRange("key").sortWithinPartitions("key").select("*", F.spark_partition_id().alias("part"), within.alias("at")))
    # One row a partition, whatever the number of sources.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    weight = F.element_at(weights, ((F.col("before") + F.col("at")) % len(mix.weights) + 1).cast("int"))
    most = F.col("source_size") * float(mix.limit)
    weighed = stash(ordered.join(F.broadcast(parts), "part").select("key", "source_size", weight.alias("weight"), most.alias("most")))
    discard(ordered)
    total = mix.share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, stops = 0.0, F.col("most") / F.col("weight")
    while True:
        stopped = stops < level
        held, rest = weighed.agg(F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        reached = (total - (held or 0.0)) / rest if rest else float("inf")
        if reached <= level:
            break
        level = reached
    return weighed.select("key", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _rate(multiplier: Column, x: Column, limit: int) -> Column:
    t = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), multiplier * x))
    return F.lit(float(limit)) / (1 + F.exp(-t))


def multipliers(histogram: DataFrame, goals: DataFrame, mix: Mix) -> DataFrame:
    """(key, multiplier, mean) that meet every target; the dual's Newton iteration, one aggregation a step.

    A target of the whole limit is met by no finite multiplier; it gets the
    upper end of the bracket at once, where rates are the limit to the last
    digit.  Raises RuntimeError if a target is not met after ``steps`` steps.
    """
    whole = F.col("target") >= F.col("source_size") * float(mix.limit) * (1 - 1e-9)
    words = F.col("size") * F.col("n")
    mean, longer = F.sum(words) / F.sum("n"), F.sum(F.col("size") * words) / F.sum(words)
    means = stash(histogram.groupBy("key").agg(mean.alias("mean"), (longer / mean).alias("usual")).filter("mean > 0"))
    # The first guess is right where all documents have the usual size.
    part = F.greatest(F.lit(1e-9), F.col("target") / (F.col("source_size") * float(mix.limit)))
    guess = F.when(whole, F.lit(1e6)).otherwise(F.log(part / (1 - part)) / F.col("usual"))
    state = stash(
        goals.join(means, "key").select(
            "key", "target", "source_size", guess.alias("multiplier"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), whole.alias("done")
        )
    )
    cells = stash(histogram.filter("size > 0").join(means, "key").withColumn("x", F.col("size") / F.col("mean")))
    steps = 0
    while left := state.filter("not done").count():
        if steps == mix.steps:
            raise RuntimeError(f"entropy balancing did not meet the targets of {left} sources in {steps} steps")
        steps += 1
        rate = _rate(F.col("multiplier"), F.col("x"), mix.limit)
        sums = (
            cells.join(state.filter("not done"), "key")
            .groupBy("key")
            .agg(F.sum(rate * words).alias("got"), F.sum(rate * (1 - rate / mix.limit) * F.col("x") * words).alias("slope"))
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("multiplier")), F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 1e-9, F.col("multiplier") - (F.col("got") - F.col("target")) / F.col("slope"))
        inside = (newton > F.col("new_low")) & (newton < F.col("new_high"))
        # Outside the bracket, halve it; while it is wide, by magnitude.
        wide = F.col("new_high") - F.col("new_low") > 64
        halfway = F.when(wide & (F.col("new_low") >= -1), F.col("new_low") + 8 + F.abs("new_low")).when(
            wide & (F.col("new_high") <= 1), F.col("new_high") - 8 - F.abs("new_high")
        ).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        met = F.abs(F.col("got") - F.col("target")) <= 1e-6 * F.col("target") + 1e-3
        moved = (
            state.join(sums, "key", "left")
            .withColumn("new_low", low)
            .withColumn("new_high", high)
            .withColumn("now_done", F.col("done") | F.coalesce(met, F.lit(True)))
        )
        later = stash(
            moved.select(
                "key", "target", "source_size",
                F.when(F.col("now_done"), F.col("multiplier")).when(inside, newton).otherwise(halfway).alias("multiplier"),
                F.when(F.col("now_done"), F.col("low")).otherwise(F.col("new_low")).alias("low"),
                F.when(F.col("now_done"), F.col("high")).otherwise(F.col("new_high")).alias("high"),
                F.col("now_done").alias("done"),
            )
        )
        discard(state)
        state = later
    solved = stash(state.select("key", "multiplier").join(means.select("key", "mean"), "key"))
    discard(state, means, cells)
    return solved


def _copies(histogram: DataFrame, goals: DataFrame, mix: Mix) -> DataFrame:
    """(key, size, n, copies) with the copies of all n documents of a size together."""
    solved = multipliers(histogram, goals, mix)
    rate = _rate(F.col("multiplier"), F.col("size") / F.col("mean"), mix.limit)
    order = Window.partitionBy("key").orderBy("size")
    expected = histogram.filter("size > 0").join(solved, "key").withColumn("run", F.sum(rate * F.col("n")).over(order))
    upto = F.floor(F.col("run") + 0.5)
    share = upto - F.coalesce(F.lag(upto).over(order), F.lit(0))
    cells = stash(expected.select("key", "size", "n", F.greatest(F.lit(0), F.least(F.col("n") * mix.limit, share)).cast("long").alias("copies")))
    discard(solved)
    while True:
        left = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("got")).join(goals.select("key", "target"), "key")
        left = left.select("key", (F.col("target") - F.col("got")).alias("gap"))
        # Of the sizes that fit into the gap, the largest first, as many as fit; what is left is smaller than one of them.
        # The first of them always fits, so every round narrows a gap or ends.
        room = F.when(F.col("gap") > 0, F.col("n") * mix.limit - F.col("copies")).otherwise(F.col("copies"))
        fitting = cells.join(left, "key").withColumn("room", room).filter((F.col("room") > 0) & (F.col("size") <= F.abs("gap")))
        before = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        times = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("gap") - used) / F.col("size"))))
        changes = fitting.select("key", "size", (times * F.signum("gap")).cast("long").alias("change")).filter("change <> 0")
        changes = stash(changes)
        if changes.isEmpty():
            discard(changes)
            return cells
        later = stash(
            cells.join(changes, ["key", "size"], "left").select(
                "key", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("long").alias("copies")
            )
        )
        discard(cells, changes)
        cells = later


def mixed(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, text_key) for every row of ``documents`` (doc_id, text, source).

    ``size`` counts words and is 0 for a null text; such rows are taken 0
    times.  The choice among documents of one source and size follows hashes of
    their ids and texts, so reruns agree; repeated rows are told apart only by
    their number.  A null source is one of its own, the last.  Other columns are
    ignored; no rows give no rows.
    """
    sized = stash(
        documents.select(
            "doc_id",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            "source",
            F.xxhash64(utf8("text")).alias("text_key"),
            _source_key().alias("key"),
            F.pmod(F.xxhash64("doc_id", utf8("text")), F.lit(BUCKETS)).cast("int").alias("bucket"),
        )
    )
    counts = stash(sized.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("here")))
    histogram = stash(counts.groupBy("key", "size").agg(F.sum("here").alias("n")))
    goals = stash(targets(histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), mix))
    cells = _copies(histogram, goals, mix)
    discard(histogram)
    # Of n documents with c copies, each gets c div n and c mod n get one more, dealt to buckets in proportion.
    order = Window.partitionBy("key", "size").orderBy("bucket")
    dealt = (
        counts.join(cells, ["key", "size"])
        .withColumn("each", F.floor(F.col("copies") / F.col("n")))
        .withColumn("more", F.col("copies") - F.col("each") * F.col("n"))
        .withColumn("run", F.sum("here").over(order))
    )
    upto, before = F.floor(F.col("run") * F.col("more") / F.col("n")), F.floor((F.col("run") - F.col("here")) * F.col("more") / F.col("n"))
    dealt = dealt.select("key", "size", "bucket", "each", (upto - before).alias("more"))
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "text_key"))
    out = (
        sized.withColumn("place", place)
        .join(dealt, ["key", "size", "bucket"], "left")
        .withColumn("copies", F.coalesce(F.col("each") + (F.col("place") <= F.col("more")).cast("int"), F.lit(0)).cast("int"))
    )
    return out.join(goals, "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies", "text_key"
    )


def mixture(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``documents`` with every row as often as the mix holds it, all columns as they are.

    No row comes more than ``limit`` times as often as before.  Rows with one
    id, text and source share their copies evenly, those that differ in other
    columns in the order of these.  Null and blank texts go; no rows give no rows.
    """
    names = [f"column{k}" for k in range(len(documents.columns))]
    at = dict(zip(documents.columns, names, strict=True))
    keyed = documents.toDF(*names).withColumn("text_key", F.xxhash64(utf8(at["text"]))).withColumn("source_key", _source_key(at["source"]))
    copies = mixed(documents, mix).groupBy(F.col("doc_id").alias("mixed_id"), F.col("text_key").alias("mixed_text"), _source_key().alias("mixed_source"))
    together = stash(copies.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0"))
    same = (
        keyed[at["doc_id"]].eqNullSafe(together["mixed_id"])
        & (keyed["text_key"] == together["mixed_text"])
        & (keyed["source_key"] == together["mixed_source"])
    )
    once = keyed.join(together.filter("rows = 1"), same).select(*names, "copies")
    # Repeated rows: as many of each kind as its share, by carrying the remainder from kind to kind.
    kinds = keyed.join(together.filter("rows > 1"), same).groupBy("text_key", "source_key", *names).agg(
        F.count(F.lit(1)).alias("here"), F.max("copies").alias("all"), F.max("rows").alias("rows")
    )
    kinds = kinds.withColumn("run", F.sum("here").over(Window.partitionBy(at["doc_id"], "text_key", "source_key").orderBy(*names)))
    upto, before = F.floor(F.col("run") * F.col("all") / F.col("rows")), F.floor((F.col("run") - F.col("here")) * F.col("all") / F.col("rows"))
    shared = kinds.select(*names, (upto - before).alias("copies")).filter("copies > 0")
    repeated = once.unionByName(shared).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    return repeated.select(*[F.col(n).alias(c) for c, n in at.items()])
