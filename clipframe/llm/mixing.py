"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws the key -ln(u) / w, u from a hash of seed and id, w its quality weight.  Within a source
the documents of smallest key are chosen until the part of the target that remains after complete epochs is
full.  Null texts have size 0, a null source is a source of its own and comes last, null ids draw as the text
'null'; rows of equal keys stand by id and a hash of the row, and of rows that are wholly equal as many are taken as
fit.  Texts may be of any length; a size-0 document is never taken.  Empty tables give empty tables; extra columns are kept, but for any with the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a source that are sorted together, on average, around the last document that is taken.
ROWS_A_SLOT = 20_000
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """A document's quality weight in [0.1, 1]: it falls with the share of symbols among its code points."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    symbols = n - F.char_length(F.translate(t, SYMBOLS, ""))
    return F.lit(1.0) - F.least(F.lit(0.9), F.lit(9.0) * symbols / F.greatest(n, F.lit(1)))


def draw(seed: int, *parts: Column) -> Column:
    """u in (0, 1) from 48 bits of an MD5: the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of each source: the budget dealt out by weight, none above ``most`` times its size.

    ``sizes`` has (source, source_size), one row a source.  The sources are filled in the order in which
    they reach their caps: source k is below its cap if the level that it would have with all before it
    capped doesn't exceed its own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.when(F.col("left") / F.col("open") * F.col("weight") <= F.col("cap"), F.col("left") / F.col("open")))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select("source", "source_size", "weight", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    quality=quality_weight,
    slots: int | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size`` (long), ``target`` (double), ``epochs`` and ``taken`` (long).

    Sources by code point get ``weights`` in turn and share ``share`` times all words.  A document is taken once
    for each complete epoch, and once more if it is chosen for the rest; ``taken`` is its size times that.

    Only counts and sums by (source, slot of keys) shuffle; the one slot of each source in which the rest ends is
    sorted, so that no task gets a whole source.
    """
    text = F.col(text_col)
    size = common.n_words(text)
    own = docs.select("*", size.alias("__size"), F.col(source_col).alias("__source"))
    own = own.withColumn("__key", -F.ln(draw(seed, F.col(id_col))) / quality(text))
    if slots is None:
        slots = max(64, (docs.count() // ROWS_A_SLOT) * 4)
    slot = F.floor(F.lit(slots) * (F.lit(1.0) - F.exp(-F.col("__key") * F.lit(0.7)))).cast("bigint")

    keyed = own.select("__source", slot.alias("slot"), "__size")
    by_slot = common.stored(keyed.groupBy("__source", "slot").agg(F.sum("__size").alias("words")), "slots")
    sizes = by_slot.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, weights, share, most)
    goals = goals.withColumn("epochs", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("bigint"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    before = Window.partitionBy("__source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = by_slot.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = ends.join(goals.select(F.col("source").alias("__s"), "rest"), F.expr("__source <=> __s")).drop("__s")
    ends = ends.where("before < rest AND before + words >= rest").groupBy("__source").agg(F.min_by(F.struct("slot", "before"), "slot").alias("end"))
    goals = common.stored(goals.join(ends.select(F.col("__source").alias("__s"), "end"), F.expr("source <=> __s"), "left").drop("__s"), "goals")

    # the last slot of each source: the prefix sum within it decides which of its documents are taken; rows that are
    # wholly equal are counted before they are sorted
    mark = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    small = goals.select(F.col("source").alias("__s"), "source_size", "target", "epochs", "rest", F.col("end.slot").alias("end_slot"), F.col("end.before").alias("end_before"))
    at = F.struct(F.col("__key").alias("__key"), F.col(id_col).alias("__id"), mark.alias("__mark"))
    few = _few(goals)  # then words are counted behind the join, only in the last slots
    edge = own.select("__source", at.alias("at"), (text if few else F.col("__size")).alias("__size"), slot.alias("slot"))
    edge = edge.join(F.broadcast(small) if few else small, F.expr("__source <=> __s AND slot = end_slot"))
    edge = (edge.withColumn("__size", common.n_words(F.col("__size"))) if few else edge).where("__size > least(0, epochs)")  # over 0, said so that it isn't moved before the join
    edge = edge.groupBy("__source", "at", "__size", "rest", "end_before").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("__source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("end_before") + F.coalesce(F.sum(F.col("__size") * F.col("copies")).over(before), F.lit(0))
    # nearest to the rest: a document that crosses it is taken if at least half of it fits
    fits = F.floor((F.col("rest") - upto) / F.col("__size") + 0.5)
    edge = edge.withColumn("fits", F.least(F.greatest(fits, F.lit(0)), F.col("copies")).cast("bigint"))
    last = edge.where("fits > 0").groupBy("__source").agg(F.max(F.struct("at", "fits", "copies")).alias("end"))
    last = last.select(F.col("__source").alias("__t"), F.col("end.at").alias("last"), F.col("end.fits").alias("fits"), F.col("end.copies").alias("copies"))
    small = common.stored(small.join(last, F.expr("__s <=> __t"), "left").drop("__t"), "lasts")

    small = small.toDF(*[c if c.startswith("__") else f"__{c}" for c in small.columns])  # apart from any column of docs
    out = own.withColumn("__slot", slot)
    out = out.join(F.broadcast(small) if _few(small) else small, F.expr("__source <=> __s"), "left")
    cut = (F.col("__slot") == F.col("__end_slot")) & (F.col("__size") > 0) & F.coalesce(at == F.col("__last"), F.lit(False))
    chosen = F.when(F.col("__end_slot").isNull(), F.col("__rest") > 0).otherwise((F.col("__slot") < F.col("__end_slot")) | ((F.col("__slot") == F.col("__end_slot")) & F.coalesce(at <= F.col("__last"), F.lit(False))))
    out = out.withColumn("__chosen", chosen)
    if small.where("__fits < __copies").limit(1).count():  # of rows that are wholly equal only some fit
        split = cut & (F.col("__fits") < F.col("__copies"))
        out = out.where(~F.coalesce(split, F.lit(False))).unionByName(_some_of_equal(out.where(split), own.columns))
    epochs = F.when(F.col("__size") > 0, F.col("__epochs") + F.when(F.col("__chosen"), 1).otherwise(0)).otherwise(0)
    results = {
        "size": F.col("__size"),
        "source_size": F.col("__source_size"),
        "target": F.col("__target"),
        "epochs": epochs.cast("bigint"),
        "taken": (epochs * F.col("__size")).cast("bigint"),
    }
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], *[v.alias(k) for k, v in results.items()])


def _some_of_equal(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` again, of which as many of each group of equal ones are chosen as fit; copies are made by many tasks."""
    rest = [c for c in rows.columns if c not in columns and c != "__chosen"]
    one = rows.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in rest])
    chunks = one.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / F.lit(ROWS_A_SLOT)))))
    chunks = chunks.repartition("__chunk")
    number = F.explode(F.sequence(F.col("__chunk") * ROWS_A_SLOT + 1, F.least((F.col("__chunk") + 1) * ROWS_A_SLOT, F.col("__n"))))
    return chunks.withColumn("__i", number).withColumn("__chosen", F.col("__i") <= F.col("__fits")).drop("__i", "__chunk", "__n")


def _few(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether the table with a row for each source is small enough to broadcast; otherwise Spark joins by shuffle."""
    return sources.count() <= most
