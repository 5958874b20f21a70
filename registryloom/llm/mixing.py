"""A mix of sources in wanted proportions, by pivotal rounding of copy numbers.

Each record of a source is wanted the same number of times, seldom a whole number. What is over
the whole part is a chance of one more copy. Pairs of records exchange chance, weighted by size,
until one of the two is certain; the other goes on to the next pair. Groups of records do so side
by side, and what each leaves over meets others in the next level of a tree, until each source
has one record left over. Words taken thus differ from the target by half a record's size at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registryloom.llm.common import saved, word_count

#: Records that one group pairs off; the tree has log(records) / log(GROUP) levels.
GROUP = 64
#: Chances nearer to 0 or 1 than this are certain.
EPSILON = 1e-9
#: Up to so many sources, their targets are broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """``source, source_size, n_rows, target`` from ``sizes(source, size)``.

    Sources in code point order, null last, take the weights in turn, again and again, and share
    ``share`` times all words by weight. No target exceeds ``most`` times its source's words; the
    excess is shared out again by weight. That ends at one level: each source gets
    ``level * weight`` or its limit. Sources sorted by limit per weight reach their limits in that
    order, so running sums give the level.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    numbered = _running(by_source, [F.col("source").asc_nulls_last()], {"at": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    limited = numbered.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    order = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = _running(limited, order, {"limit_before": F.col("limit"), "weight_before": F.col("weight")})
    words, weighed = before.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(words or 0) * share) - F.col("limit_before")) / (F.lit(float(weighed or 1)) - F.col("weight_before"))
    # The first source that its limit does not hold back sets the level; for those before it, it is no less.
    free = before.filter(level * F.col("weight") < F.col("limit"))
    place = F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    first = free.agg(F.min_by(level, place)).first()[0]
    target = F.col("limit") if first is None else F.least(F.lit(first) * F.col("weight"), F.col("limit"))
    return before.select("source", "source_size", "n_rows", target.alias("target"))


def _running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums over all rows before each in ``order``, without a task that sees them all.

    Rows are laid out in ranges of the order; sums within a range run inside its task, and what
    the ranges before it add up to is one number a range.
    """
    laid = saved(rows.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()))
    whole = laid.groupBy("cell").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("cell").collect()
    totals = {n: list(accumulate((r[n] for r in whole), initial=0 * whole[0][n] if whole else 0)) for n in sums}
    found = [(r["cell"], *(totals[n][i] for n in sums)) for i, r in enumerate(whole)]
    names, kinds = [f"{n}_base" for n in sums], {n: laid.select(F.sum(c)).schema[0].dataType for n, c in sums.items()}
    schema = ", ".join(["cell int", *(f"{b} {kinds[n].simpleString()}" for b, n in zip(names, sums))])
    bases = F.broadcast(rows.sparkSession.createDataFrame(found, schema))
    inside = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.lit(0).cast(kinds[n]) for n in sums}
    upto = {n: F.col(b) + F.coalesce(F.sum(c).over(inside), zero[n]) for (n, c), b in zip(sums.items(), names)}
    return laid.join(bases, "cell").withColumns(upto).drop("cell", *names)


def _random(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pair(a: Column, b: Column, u: Column) -> tuple[Column, Column]:
    """Chances of two records after one exchange that keeps their expected words.

    Either ``a`` gains as much as both allow, or ``b`` does; ``u`` picks one so that the expected
    chances stay the same.
    """
    up = F.least((1 - a["chance"]) * a["size"], b["chance"] * b["size"])  # words from b to a
    down = F.least(a["chance"] * a["size"], (1 - b["chance"]) * b["size"])
    words = F.when(u * (up + down) < down, up).otherwise(-down)
    return a["chance"] + words / a["size"], b["chance"] - words / b["size"]


def _settled(chance: Column) -> Column:
    return (chance <= EPSILON) | (chance >= 1 - EPSILON)


def _pair_off(units: Column, level: int) -> Column:
    """The units of one group with new chances: all settled but, at most, the last."""

    def step(state: Column, unit: Column) -> Column:
        left = state["left"]
        first, second = _pair(left, unit, _random(left["doc_id"], unit["doc_id"], F.lit(level)))
        a, b = left.withField("chance", first), unit.withField("chance", second)
        goes_on = F.when(_settled(first), b).otherwise(a)
        out = F.when(_settled(first), a).otherwise(b)
        return F.struct(goes_on.alias("left"), F.concat(state["done"], F.array(out)).alias("done"))

    begin = F.struct(units[0].alias("left"), F.slice(units, 1, 0).alias("done"))
    rest = F.slice(units, 2, F.size(units))
    return F.aggregate(rest, begin, step, lambda s: F.concat(s["done"], F.array(s["left"])))


def _level(units: DataFrame, level: int) -> DataFrame:
    """Pair off the open units of each source and bucket; small records last, so they are left."""
    members = [n for n in units.columns if n not in ("source", "bucket")]
    unit = F.struct((-F.col("size")).alias("order"), *members)
    groups = units.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    out = groups.select("source", "bucket", F.explode(_pair_off(F.col("units"), level)).alias("u"))
    return out.select("source", "bucket", *[F.col(f"u.{n}").alias(n) for n in members])


def mix(
    docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per row of ``docs``.

    Size is the number of words, 0 for a null text, which the mix then takes any number of times
    for no words. Rows that are alike count as one record with several rows: the sure part of
    their extra copies goes to as many of them, and the rest is one chance. A null source is a
    source like any other, null ids are allowed, other columns are ignored, an empty table gives
    no rows. Chances come from hashes, so the same rows give the same mix.
    """
    words = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = saved(words.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    weighed = rows.select("source", (F.col("size") * F.col("rows")).alias("size"))
    targets = saved(source_targets(weighed, weights, share, most))
    if not targets.isEmpty() and targets.count() <= MAX_BROADCAST_SOURCES:
        targets = F.broadcast(targets)

    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    wanted = rows.alias("d").join(targets.alias("t"), same).select("d.*", "source_size", "target", "n_rows")
    wanted = wanted.withColumn("whole", F.floor(ratio)).withColumn("over", ratio - F.floor(ratio))
    extra = F.col("over") * F.col("rows")
    buckets = F.ceil(F.col("n_rows") / GROUP)
    units = (
        wanted.withColumn("sure", F.floor(extra))
        .withColumn("chance", F.when(F.col("size") > 0, extra - F.floor(extra)).otherwise(0.0))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit("bucket")), buckets))
        .drop("n_rows", "over")
    )
    open_ = ~_settled(F.col("chance"))
    most_rows = targets.agg(F.max("n_rows")).first()[0] or 0
    done, level, span = [units.filter(~open_)], 0, -(-most_rows // GROUP)
    while True:
        paired = saved(_level(units.filter(open_), level))
        if span <= 1:
            break
        done.append(paired.filter(~open_))
        units = paired.withColumn("bucket", F.floor(F.col("bucket") / GROUP))
        level, span = level + 1, -(-span // GROUP)
    # The one record that each source has left over is rounded to its nearer side.
    settled = reduce(DataFrame.unionByName, [*done, paired])
    settled = settled.withColumn("more", F.col("chance") >= 0.5)
    each = settled.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    copies = F.col("whole") + (F.col("i") <= F.col("sure") + F.col("more").cast("bigint")).cast("bigint")
    each = each.withColumn("copies", copies)
    return each.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeat_rows(
    docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows alike in id, source and size share their copies as evenly as they can. The texts move
    once; only where such rows exist are they numbered, in a pass of their own.
    """
    record = ["doc_id", "source", "size"]
    copies = mix(docs, weights, share, most).groupBy(record)
    copies = saved(copies.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.struct(*columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    same = reduce(
        Column.__and__, [F.col(f"r.{n}").eqNullSafe(F.col(f"c.{n}")) for n in record]
    )

    def taken(found: DataFrame, own: Column) -> DataFrame:
        found = found.withColumn("own", own).filter(F.col("own") > 0)
        return found.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "own"))).select("row.*")

    single = rows.alias("r").join(copies.filter("rows = 1").alias("c"), same).select("r.*", "copies")
    out = taken(single, F.col("copies"))
    alike = copies.filter("rows > 1")
    if alike.isEmpty():
        return out
    found = rows.alias("r").join(alike.alias("c"), same).select("r.*", "copies", "rows")
    at = F.row_number().over(Window.partitionBy(record).orderBy(F.xxhash64("row.text")))
    each = F.floor(F.col("copies") / F.col("rows"))
    own = each + (at <= F.col("copies") - each * F.col("rows")).cast("bigint")
    return out.unionByName(taken(found, own))
