"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. Prefix
sums of the expected copies run over the source's documents; a random offset
in [0, 1) per source shifts them, and a document is emitted once for each
integer boundary that its step crosses. Documents are ordered by size class
first, so that each size class contributes its share and the words taken stay
near the target even when some documents are very long.

No source passes through one task: documents fall into (source, size class,
slice) bins, bins are counted with partial aggregation, and the prefix sum of
a document is its bin's offset plus its rank inside the bin.

Defined cases: null text has size 0 (it may be taken, it adds no words); a
null source is a source of its own, after all others; repeated rows count
each for themselves; an empty table gives an empty result; when every size is
0 all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import WORD, saved, uniform

# Fixed values of the contract: weights in source order, total and cap.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): its target in words.

    Targets are ``min(most * size, level * weight)``: handing the excess of
    capped sources to the others by weight, until none is above its cap, ends
    at the one level at which the targets add up to the total. The sources
    are ordered by cap / weight; the level is the first one, so computed,
    that the next source's cap does not undercut. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("weight"))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    t = t.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    # levels fall along the order: the first that lifts its source no higher
    # than the cap is the largest such level
    free = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return t.select("source", "source_size", "weight",
                    F.least(F.col("cap"), F.coalesce(free * F.col("weight"), F.col("cap"))).alias("target"))


def size_class(size: str) -> Column:
    """Sixteen classes per doubling of the column ``size`` (exact in integers)."""
    return F.expr(f"CAST(IF({size} < 16, {size}, 16 * length(bin({size})) "
                  f"+ (shiftright({size}, length(bin({size})) - 5) & 15)) AS int)")


#: Rows of one size class of one source that a task should rank at most.
SLICE_ROWS = 200_000


def slices_for(rows: int) -> int:
    """Leading key characters that split even a single size class of ``rows``
    rows into bins of about ``SLICE_ROWS``; the result does not depend on it."""
    n = 1
    while n < 8 and rows > SLICE_ROWS * 16 ** n:
        n += 1
    return n


def mix(docs: DataFrame, key: Column | None = None, slice_chars: int | None = None, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, key, source, size, source_size,
    target, copies, taken. ``key`` is a lower-case hex string that orders the
    rows of a size class (default: MD5 of the id); its first ``slice_chars``
    characters (default: by the number of rows) split a class of a source into
    16 ** slice_chars bins.
    """
    if key is None:
        key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("_key"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # texts are read once, for the sizes; bins, targets and ranks read these rows
    d = saved(d, "mix-sizes")
    slice_chars = slice_chars or slices_for(d.count())
    d = (d.withColumn("_class", size_class("size"))
         .withColumn("_slice", F.substring("_key", 1, slice_chars)))
    bins = d.groupBy("source", "_class", "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("_size").alias("source_size")))
    order = (Window.partitionBy("source").orderBy("_class", "_slice")
             .rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("source", "_class", "_slice",
                       F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    t = targets.select(F.col("source").alias("_src"), "source_size", "target")
    bins = bins.join(t, F.col("source").eqNullSafe(F.col("_src")))
    b = bins.select(F.col("source").alias("_bsrc"), F.col("_class").alias("_bclass"),
                    F.col("_slice").alias("_bslice"), "_before", "source_size", "target")
    inside = Window.partitionBy("source", "_class", "_slice").orderBy("_key", "doc_id", "size")
    d = d.withColumn("_rank", F.row_number().over(inside))
    d = d.join(b, F.col("source").eqNullSafe(F.col("_bsrc")) & (F.col("_class") == F.col("_bclass"))
               & (F.col("_slice") == F.col("_bslice")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = uniform(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n"))))
    at = F.col("_before") + F.col("_rank")
    copies = F.least(F.floor(start + rate * at) - F.floor(start + rate * (at - 1)), F.lit(int(MOST)))
    d = d.withColumn("copies", copies.cast("long"))
    return d.select("doc_id", F.col("_key").alias("key"), "source", "size", "source_size", "target",
                    "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken,
    with the number of the copy in ``copy`` (1 and up; ``mix_copy`` where the
    input has a ``copy``). Rows equal in every column share their copies."""
    names = docs.columns
    # maps cannot be hashed: their text stands for them (equal maps in another
    # order then count as different rows, none is lost)
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
            for f in docs.schema.fields]
    flags = [c.isNull() for c in cols]
    # 128 bits: rows that differ do not share a key
    halves = [F.xxhash64(*cols, *flags), F.xxhash64(F.lit(1), *cols, *flags)]
    key = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves])
    m = mix(docs, key=key, **kw).where("copies > 0").groupBy(F.col("key").alias("_mkey")).agg(
        F.sum("copies").cast("int").alias("_copies"))
    rows = (docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key.alias("_key"))
            .dropDuplicates(["_key"]))
    copy = "copy" if "copy" not in names else "mix_copy"
    return (rows.join(m, F.col("_key") == F.col("_mkey"))
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
            .select("_row.*", F.col("_copy").alias(copy)))
