"""Filter interaction audit: how an ordered chain of filters shares its
removals, for every order of the filters.

One pass over the documents gives each its failure mask (one bit per filter);
documents are counted by part and mask, with those labelled good and toxic.
Per part, a count-weighted decision diagram is built over the masks: a level
per filter, a *pass* and a *fail* edge per node, equal sub-diagrams merged, and
every node carries the summed counts below it. Swapping two adjacent levels
rebuilds those two levels only. A walk over all orders by adjacent swaps visits
every order once, and the all-pass path of each gives its steps: what the fail
edge of a node carries is removed there.

Only narrow rows are shuffled (digest, id, flags), never texts. A text that a
third of all rows share is counted by partial aggregates; its window holds one
row per part and label only. A part's diagram has at most 2**filters masks, so
the group handed to a task is bounded.

Defined cases: null text counts as empty, null lang as part ``''``; a document
without words fails A and passes B; an empty text passes C; rows with a null
id neither repeat others nor are repeated; repeated rows with one id do not
repeat each other (only a smaller id counts); several label rows of an id: any
of them marks it; ids without a label are neither good nor toxic; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import words

# The filters of the audit, in bit order.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"

STEP = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long")


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at the text alone (A to D)."""
    w = words(text)
    n = F.size(w)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < MIN_WORDS,
             F.size(F.array_distinct(w)) * F.lit(100).cast("long") < n * F.lit(MIN_DISTINCT_PCT).cast("long"),
             capitals * F.lit(100).cast("long") > F.length(text) * F.lit(MAX_CAPITALS_PCT).cast("long"),
             text.rlike(SYMBOLS)]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by (part, mask): n, good, toxic.

    The repeat filter (E) needs the least id of equal texts table-wide. Rows
    are reduced per (text digest, part, labels) to their count, their least id
    and the count at it; only these meet under a digest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                    F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("own"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_lid")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("_ls", F.lit(0))
    # rows without an id match no label: they are spread over the join's tasks
    d = d.withColumn("_s", F.when(F.col("_id").isNull(), F.hash("digest")).otherwise(0))
    d = d.join(marks, (F.col("_id") == F.col("_lid")) & (F.col("_s") == F.col("_ls")), "left")
    d = d.select("_id", "digest", "part", "own", F.coalesce("good", F.lit(False)).alias("good"),
                 F.coalesce("toxic", F.lit(False)).alias("toxic"))
    group = ["digest", "part", "own", "good", "toxic"]
    per_id = d.groupBy(*group, "_id").agg(F.count(F.lit(1)).alias("c"))
    g = per_id.groupBy(*group).agg(
        F.sum("c").alias("n"), F.min("_id").alias("first"), F.min_by("c", "_id").alias("at_first"),
        F.sum(F.when(F.col("_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"))
    least = F.min("first").over(Window.partitionBy("digest"))
    firsts = F.col("nameless") + F.when(F.col("first") == least, F.col("at_first")).otherwise(0)
    g = g.withColumn("firsts", firsts)
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("firsts").alias("n")),
                             F.struct(F.col("own").bitwiseOR(16).alias("mask"),
                                      (F.col("n") - F.col("firsts")).alias("n"))))
    g = g.select("part", "good", "toxic", both.alias("m")).where("m.n > 0")
    return g.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.when(F.col("good"), F.col("m.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("m.n")).otherwise(0)).alias("toxic"))


class Diagram:
    """Count-weighted decision diagram over failure masks.

    ``levels[i]`` lists the nodes of level i as (pass, fail) pairs of node
    numbers one level below; the last level lists the distinct count triples.
    ``weights[i]`` holds each node's summed counts. Nodes of a level differ in
    their pairs; node 0 of level 0 is the root.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], names: str = FILTERS):
        m = len(names)
        self.order = list(names)
        zero = (0, 0, 0)
        row = [tuple(counts.get(mask, zero)) for mask in self._leaf_masks(m)]
        found: dict = {}
        row = [found.setdefault(w, len(found)) for w in row]
        self.levels: list[list] = [[] for _ in range(m)] + [list(found)]
        self.weights: list[list] = [[] for _ in range(m)] + [list(found)]
        for i in range(m - 1, -1, -1):
            found = {}
            row = [found.setdefault(pair, len(found)) for pair in zip(row[::2], row[1::2])]
            self.levels[i] = list(found)
            self._weigh(i)

    @staticmethod
    def _leaf_masks(m: int) -> Iterator[int]:
        """Masks in leaf order: the first filter decides the topmost branch."""
        for leaf in range(1 << m):
            yield sum(1 << k for k in range(m) if leaf >> (m - 1 - k) & 1)

    def _weigh(self, i: int) -> None:
        below = self.weights[i + 1]
        self.weights[i] = [tuple(a + b for a, b in zip(below[p], below[f])) for p, f in self.levels[i]]

    def swap(self, i: int) -> None:
        """Exchange the filters of levels i and i + 1."""
        lower, found = self.levels[i + 1], {}

        def node(p, f):
            return found.setdefault((p, f), len(found))

        self.levels[i] = [(node(lower[p][0], lower[f][0]), node(lower[p][1], lower[f][1])) for p, f in self.levels[i]]
        self.levels[i + 1] = list(found)
        self._weigh(i + 1)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> list[tuple[tuple, tuple]]:
        """(kept, removed) count triples along the all-pass path."""
        out, at = [], 0
        for i in range(len(self.order)):
            p, f = self.levels[i][at]
            out.append((self.weights[i + 1][p], self.weights[i + 1][f]))
            at = p
        return out


def adjacent_swaps(m: int) -> Iterator[int]:
    """Positions of the adjacent swaps that lead through all m! orders: the
    last item sweeps through the orders of the others, left and right in turn."""
    if m < 2:
        return
    inner, left = adjacent_swaps(m - 1), True
    while True:
        yield from (range(m - 2, -1, -1) if left else range(m - 1))
        step = next(inner, None)
        if step is None:
            return
        # the sweeping item stands first after a left sweep, last after a right one
        yield step + 1 if left else step
        left = not left


def audit_rows(part: str, counts: dict[int, tuple[int, ...]], names: str = FILTERS) -> list[tuple]:
    """All rows of a part: every order, every step."""
    d = Diagram(counts, names)
    walks = [("".join(d.order), d.steps())]
    for i in adjacent_swaps(len(names)):
        d.swap(i)
        walks.append(("".join(d.order), d.steps()))
    fails, alone, total = {}, {}, dict.fromkeys(names, 0)
    for order, steps in walks:
        fails[order[0]] = steps[0][1][0]     # in front, a filter removes all that fail it
        alone[order[-1]] = steps[-1][1][0]   # at the end, only what no other filter removes
        for name, (_, removed) in zip(order, steps):
            total[name] += removed[0]
    return [(part, order, k + 1, kept[0], removed[0], fails[order[k]] - removed[0], alone[order[k]],
             removed[1], removed[2], total[order[k]])
            for order, steps in walks for k, (kept, removed) in enumerate(steps)]


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """Steps of every order per part from (part, mask, n, good, toxic) rows:
    part, filter_order, step, kept, removed, redundant (failing the filter,
    removed earlier), unique_fails (failing no other), good_lost, toxic_lost,
    shapley (the filter's removals summed over all orders)."""
    columns = [c.split()[0] for c in STEP.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in group.itertuples()}
        return pd.DataFrame(audit_rows(group["part"].iloc[0], counts, names), columns=columns)

    return masks.groupBy("part").applyInPandas(run, STEP)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text, lang) with
    ``labels`` (doc_id, quality, toxic)."""
    return audit(failure_masks(docs, labels))
