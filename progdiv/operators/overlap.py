"""Pairwise distances of sets from shared elements: only pairs that share one are ever joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def set_sizes(sets: DataFrame, keys: list[str], member: str) -> DataFrame:
    """size (distinct elements) and total (with repeats) of each member."""
    return sets.groupBy(*keys, member).agg(F.count("*").alias("size"), F.sum("c").alias("total"))


#: Members that hold an element above which its members meet in several tasks.
HOT = 1024


def shared(sets: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Rows (keys, a, b, shared) of pairs a < b with a common element.

    Members of an element that more than HOT hold are dealt into chunks, and each two chunks meet by themselves, so that no task
    squares a long list.
    """
    hot = sets.groupBy(*keys, "g").agg(F.count("*").alias("held")).where(F.col("held") > HOT).select(*keys, "g", F.ceil(F.col("held") / HOT).cast("int").alias("chunks"))
    rows = sets.select(*keys, "g", F.col(member).alias("m")).join(hot, [*keys, "g"], "left")
    rows = rows.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("m"), F.col("chunks")).cast("int"), F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    rows = rows.select(*keys, "g", "m", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    a, b = (rows.withColumnsRenamed({"m": side, "chunk": f"chunk_{side}"}) for side in ("a", "b"))
    met = a.join(b, [*keys, "g", "lo", "hi"]).where("a < b AND (lo = hi OR chunk_a <> chunk_b)")
    return met.groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))


def classes(sets: DataFrame, keys: list[str], member: str) -> tuple[DataFrame, DataFrame]:
    """One set of each class of members with equal sets, and the classes: keys, member, size, total, w (members)."""
    each = sets.groupBy(*keys, member).agg(F.count("*").alias("size"), F.sum("c").alias("total"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y"))
    found = each.groupBy(*keys, "size", "x", "y").agg(F.min(member).alias(member), F.first("total").alias("total"), F.count("*").alias("w"))
    found = found.select(*keys, member, "size", "total", "w")
    return sets.join(found.select(*keys, member), [*keys, member], "left_semi"), found


def alike(sets: DataFrame, keys: list[str], member: str) -> DataFrame:
    """n (members) and alike (sum over pairs of shared / all elements) by group.

    Pairs are of classes of equal sets, weighted by their members; members of one class are alike by 1. Elements that all classes
    of a group hold make no pairs: what a pair has by them alone follows from both sizes, so it is summed over the numbers of
    members by size, and pairs that share more correct it.
    """
    some, found = classes(sets, keys, member)
    in_all = found.groupBy(*keys).agg(F.count("*").alias("held"))
    common = some.groupBy(*keys, "g").agg(F.count("*").alias("held")).join(in_all, [*keys, "held"]).where("held > 1").select(*keys, "g")
    rest = some.join(common, [*keys, "g"], "left_anti")
    u = common.groupBy(*keys).agg(F.count("*").alias("u"))
    a = found.select(*keys, F.col(member).alias("a"), F.col("size").alias("sa"), F.col("w").alias("wa"))
    b = found.select(*keys, F.col(member).alias("b"), F.col("size").alias("sb"), F.col("w").alias("wb"))
    near = shared(rest, keys, member).join(a, [*keys, "a"]).join(b, [*keys, "b"]).join(u, keys, "left").fillna(0, ["u"])
    share = lambda s: s / (F.col("sa") + F.col("sb") - s)
    across = near.groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb") * (share(F.col("shared") + F.col("u")) - share(F.col("u")))).alias("across"))
    sizes = found.groupBy(*keys, "size").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("own")).join(u, keys)
    x, y = sizes.withColumnsRenamed({"size": "sa", "w": "wa"}), sizes.drop("u").withColumnsRenamed({"size": "sb", "w": "wb", "own": "own_b"})
    weight = F.when(F.col("sa") == F.col("sb"), (F.col("wa") * F.col("wa") - F.col("own")) / 2).otherwise(F.col("wa") * F.col("wb"))
    by_size = x.join(y, keys).where("sa <= sb").groupBy(*keys).agg(F.sum(weight * share(F.col("u"))).alias("by_size"))
    own = found.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("within"))
    out = own.join(across, keys, "left").join(by_size, keys, "left")
    return out.select(*keys, "n", (F.coalesce("across", F.lit(0.0)) + F.coalesce("by_size", F.lit(0.0)) + F.col("within")).alias("alike"))


def mean_pair_distance(sets: DataFrame, keys: list[str], member: str) -> DataFrame:
    """jaccard: mean over all pairs of 1 - shared / all, from the pairs that share anything."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return alike(sets, keys, member).select(*keys, "n", F.when(F.col("n") > 1, 1 - F.col("alike") / pairs).alias("jaccard"))


#: Members of a group above which their ranks are counted in several tasks, and in how many.
RANKED, PARTS = 1 << 16, 1024


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt into as many parts as a shuffle has. Spark joins small parts by their compressed bytes; where rows compress well and
    are sorted or multiplied next, a few tasks would hold them all."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def positions(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Rows (keys, member, pos, n): ranks from 0 within each group of members, each being there once, and the group's number.

    Numbers of a group of more than RANKED members are parted at approximate quantiles; a rank is what all parts before hold and
    the rank within its own."""
    n = members.groupBy(*keys).agg(F.count("*").alias("n"))
    few = lambda frame: frame.hint("shuffle_hash")  # noqa: E731 - a row a group or a part: rows go past it unsorted
    rows = members.join(few(n), keys)
    if isinstance(members.schema[member].dataType, NumericType):
        marks = [F.lit(i / PARTS) for i in range(1, PARTS)]
        cuts = rows.where(F.col("n") > RANKED).groupBy(*keys).agg(F.percentile_approx(member, F.array(*marks), 20 * PARTS).alias("cuts"))
        rows = rows.join(few(cuts), keys, "left").withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(member))), F.lit(0))).drop("cuts")
        rows = rows.withColumn("part", F.greatest("part", F.lit(0)))  # without cuts the size is -1 in some settings
    else:
        rows = rows.withColumn("part", F.lit(0))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "part").agg(F.count("*").alias("c")).select(*keys, "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    rows = dealt(rows, *keys, "part").withColumn("own", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(member)) - 1)
    return rows.join(few(parts), [*keys, "part"]).select(*keys, member, (F.col("before") + F.col("own")).alias("pos"), "n")


def drawn_pairs(sets: DataFrame, keys: list[str], member: str, draws: list[tuple[int, int, float]]) -> DataFrame:
    """Rows (keys, it, total, distinct, common) of pairs drawn with replacement, draws being (iteration, slot, uniform): elements
    with repeats, distinct ones and shared ones. A draw picks the member at floor(u * n) in order.

    Members are drawn first and only their elements are met, so the work follows the draws and not the pairs of a group. A member
    of one row with null g is one without elements.
    """
    members = positions(sets.select(*keys, member).distinct(), keys, member)
    groups = members.select(*keys, "n").distinct().where("n >= 2")
    picks = groups.withColumn("d", F.explode(F.array(*(F.struct(F.lit(it).alias("it"), F.lit(1 << slot).alias("side"), F.lit(u).alias("u")) for it, slot, u in draws))))
    # Picks are as many as draws, so they are hashed, and members and sets go past them unsorted.
    picks = picks.select(*keys, "d.it", "d.side", F.floor(F.col("d.u") * F.col("n")).alias("pos")).hint("shuffle_hash")
    picks = members.select(*keys, "pos", member).join(picks, [*keys, "pos"]).drop("pos")
    met = sets.select(*keys, member, "g", "c").join(picks.hint("shuffle_hash"), [*keys, member])
    each = met.groupBy(*keys, "it", "g").agg(F.bit_or("side").alias("sides"), F.sum("c").alias("c"))
    real = F.col("g").isNotNull()
    return each.groupBy(*keys, "it").agg(F.sum(F.when(real, F.col("c")).otherwise(0)).alias("total"), F.count("g").alias("distinct"), F.sum(F.when(real & (F.col("sides") == 3), 1).otherwise(0)).alias("common"))


def bootstrap_pairs(sets: DataFrame, keys: list[str], member: str, draws: list[tuple[int, int, float]]) -> DataFrame:
    """Mean distinct share of the elements of two drawn members; pairs with at most one element don't count."""
    pairs = drawn_pairs(sets, keys, member, draws)
    return pairs.groupBy(*keys).agg(F.avg(F.when(F.col("total") > 1, F.col("distinct") / F.col("total"))).alias("bootstrap_distinct"))


def sampled_pairs(sets: DataFrame, keys: list[str], member: str, draws: list[tuple[int, int, float]]) -> DataFrame:
    """Mean over drawn pairs of 1 - shared / all distinct elements; pairs without any don't count."""
    pairs = drawn_pairs(sets, keys, member, draws)
    return pairs.groupBy(*keys).agg(F.avg(1 - F.try_divide("common", "distinct")).alias("sampled_jaccard"))
