"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

A document's set holds its distinct n-word shingles (64-bit hashes). Shingles
are ordered rarest first by a count sketch over all documents (``2 **
SKETCH_BITS`` sums; any fixed order is exact, rarity makes prefixes
selective). Two sets can only reach the threshold if they share a shingle
among their first few: documents join on these prefix shingles, under the
length filter and the positional filter (what is left after the shared
shingle must suffice). Candidate pairs, once each, pass the suffix filter
(the shingles in which two sets differ are at least the bits in which their
marks do, see :func:`odd_marks`) and are then verified on the full sets.

Documents with equal sets form one class first and join as one. Groups of
many similar texts are not expanded into all pairs: in a first round every
prefix shingle links its documents to the one in whose order it stands
earliest; after components of the verified links are known, the second round
only joins documents of different components under a shingle, the largest
component of a shingle entering on one side only. Every link of the full join
runs inside a component or is verified, so the components are exact.

Defined cases: null and blank texts have an empty set and link with nothing
(the component is the document's own id); shorter texts than a shingle are one
shingle; repeated rows are linked; with a null id a document takes part, and
the component takes the smallest id that is not null; ids repeated for
different texts stay apart unless the texts link.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm import textvec as tv
from retentio.llm.common import WORD, drop_saved, row_key, saved, sized
from retentio.llm.components import components

SKETCH_BITS = 20
#: Least bits of a set's marks; longer sets have a bit for each shingle.
MARK_BITS = 512
#: Row keys up to this count are broadcast to select texts; more are joined.
MAX_BROADCAST = 500_000


def shingle_sets(texts: list, size: int):
    """Sorted distinct shingle hashes of each UTF-8 text (A-Z folded)."""
    data = [t or b"" for t in texts]
    steps = [np.uint64(pow(tv.BASE, 3 * k + 1, 1 << 64)) for k in range(size)]
    for part in tv.chunks(data):
        h, at = tv.word_hashes(data[part], lower=True)
        s = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for k in range(size):
            s += h[k:k + len(s)] * steps[k]
        s = tv.mix(s)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= size:
                yield np.unique(s[a:b - size + 1])
            elif b > a:  # all words as one shingle, apart from longer ones
                short = sum((int(x) * int(steps[k]) for k, x in enumerate(h[a:b])), int(b - a))
                yield tv.mix(np.array([short & tv.MASK], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_class(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes()).digest() if len(s) else None


def odd_marks(s: np.ndarray) -> np.ndarray:
    """A power of two of bits, as 64-bit words: whether an odd number of the
    set's hashes falls on the bit. Shingles that two sets share cancel out in
    the XOR of their marks, so its bits count at most those that differ; for
    sets without much in common, that is about half of all bits."""
    width = max(MARK_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


SETS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()),
                  ("marks", pa.list_(pa.int64())), ("block", pa.int32()), ("seen", pa.binary())])
#: Sums of the sketch that travel in one row.
SKETCH_BLOCK = 1 << 14


def describe_sets(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """One row per document (key, doc_id, n, cls, marks: see
    :func:`odd_marks`) and, with a block number, the task's part of the sketch
    (seen: SKETCH_BLOCK compressed 32-bit counts)."""
    def run(batches):
        seen = np.zeros(1 << bits, np.uint32)
        for rb in batches:
            n, cls, marks, held = [], [], [], []
            for s in shingle_sets(rb.column("text").to_pylist(), size):
                n.append(len(s))
                cls.append(set_class(s))
                marks.append(odd_marks(s) if len(s) else None)
                held.append((s >> np.uint64(64 - bits)).astype(np.int32))
                if len(held) == 2000:
                    np.add(seen, np.bincount(np.concatenate(held), minlength=1 << bits), out=seen, casting="unsafe")
                    held = []
            if held:
                np.add(seen, np.bincount(np.concatenate(held), minlength=1 << bits), out=seen, casting="unsafe")
            yield pa.RecordBatch.from_arrays(
                [rb.column("key"), rb.column("doc_id"), pa.array(n, pa.int32()), pa.array(cls, pa.binary()),
                 pa.array(marks, pa.list_(pa.int64())), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                schema=SETS)
        for b, part in enumerate(seen.reshape(-1, min(SKETCH_BLOCK, 1 << bits))):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
                     pa.nulls(1, pa.list_(pa.int64())), pa.array([b], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])],
                    schema=SETS)

    return docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
                       ).mapInArrow(run, "key long, doc_id long, n int, cls binary, marks array<bigint>, block int, seen binary")


def sketch(described: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch, ``2 ** bits`` counts: tasks add up the blocks that
    reach them one by one, the driver gets one row per block."""
    width = min(SKETCH_BLOCK, 1 << bits)

    def run(batches):
        sums = {}
        for rb in batches:
            for b, seen in zip(rb.column("block").to_pylist(), rb.column("seen").to_pylist()):
                part = np.frombuffer(zlib.decompress(seen), np.uint32)
                sums[b] = sums[b] + part if b in sums else part.astype(np.int64)
        most = np.iinfo(np.uint32).max
        rows = [np.minimum(v, most).astype(np.uint32).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["block", "seen"])

    out = np.zeros(1 << bits, np.uint32)
    parts = described.where("block IS NOT NULL").select("block", "seen").repartition("block")
    # 2 ** bits sums in all, one row per block
    for r in parts.mapInArrow(run, "block int, seen binary").collect():
        out[r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(r["seen"], np.uint32)
    return out


def prefix_rows(docs: DataFrame, order: np.ndarray, size: int, pct: int) -> DataFrame:
    """(cls, n, tokens): the rarest-first prefix of every set; a task gives
    each class once."""
    bits = len(order).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        counts, given = shared.value, set()
        for rb in batches:
            cls, n, tokens = [], [], []
            for s in shingle_sets(rb.column("text").to_pylist(), size):
                c = set_class(s)
                if c is not None and c not in given:
                    given.add(c)
                    rank = np.lexsort((s, counts[(s >> np.uint64(64 - bits)).astype(np.int64)]))
                    keep = len(s) - (-(-pct * len(s) // 100)) + 1
                    cls.append(c)
                    n.append(len(s))
                    tokens.append(s[rank[:keep]].view(np.int64))
            ends = np.cumsum([0] + [len(t) for t in tokens], dtype=np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls, pa.binary()), pa.array(n, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["cls", "n", "tokens"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "cls binary, n int, tokens array<bigint>")


def _ceil(x: Column, d: int) -> Column:
    return F.floor((x + F.lit(d - 1)) / F.lit(d))


def needed(a: Column, b: Column, pct: int) -> Column:
    """Least intersection of two sets of these sizes that reach the threshold."""
    return _ceil((a + b) * F.lit(pct), 100 + pct)


def can_link(x, y, pct: int) -> Column:
    """Length, index-prefix and positional filter of two prefix rows."""
    n1, p1, n2, p2 = x("n"), x("pos"), y("n"), y("pos")
    first = (n1 < n2) | ((n1 == n2) & (x("cls") < y("cls")))
    short_n, short_p = F.when(first, n1).otherwise(n2), F.when(first, p1).otherwise(p2)
    index = short_n - _ceil(short_n * F.lit(2 * pct), 100 + pct) + 1
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * F.lit(pct)) & (short_p < index)
            & (F.least(n1 - p1, n2 - p2) >= needed(n1, n2, pct)))


def _as(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{mark}_{c}") for c in df.columns])


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()


def _side(mark: str):
    return lambda c: F.col(f"{mark}_{c}")


def live_rows(prefixes: DataFrame, pct: int) -> DataFrame:
    """(token, cls, n, pos, lead), one row per class: the prefix rows that can
    meet a partner, that is under shingles of two classes or more, where the
    rest of the set can suffice for the smallest set under the shingle; lead
    is the shingle's earliest row. The rows are shuffled once, by shingle."""
    same = Window.partitionBy("token")
    p = prefixes.select("cls", "n", F.posexplode("tokens").alias("pos", "token"))
    r = p.select("token", "cls", "n", "pos", F.min("cls").over(same).alias("lo"), F.max("cls").over(same).alias("hi"),
                 F.min("n").over(same).alias("least")).where("lo < hi")
    other = F.greatest(F.col("least"), _ceil(F.col("n") * F.lit(pct), 100))
    r = r.where(F.col("n") - F.col("pos") >= needed(F.col("n"), other, pct))
    r = r.groupBy("token", "cls").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    return r.withColumn("lead", F.min(F.struct("pos", "n", "cls")).over(same))


def leader_pairs(p: DataFrame, pct: int) -> DataFrame:
    """Round one: each row with the earliest row of its shingle."""
    j = p.select(*[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "pos")],
                 *[F.col(f"lead.{c}").alias(f"y_{c}") for c in ("cls", "n", "pos")])
    return _pairs(j.where((F.col("x_cls") != F.col("y_cls")) & can_link(_side("x"), _side("y"), pct)))


def cross_pairs(p: DataFrame, comp: DataFrame, pct: int) -> DataFrame:
    """Round two: rows of different components under a shingle."""
    c = comp.select(F.col("node").alias("k"), "component")
    p = p.join(c, F.col("cls") == F.col("k"), "left").select(
        "token", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp"))
    same = Window.partitionBy("token")
    # one shuffle by shingle serves the counts and their greatest
    p = p.repartition("token").withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("token", "comp")))
    p = p.withColumn("m", F.max(F.struct("s", "comp")).over(same)).withColumn("least", F.min("comp").over(same)).withColumn(
        "most", F.max("comp").over(same)).where("least < most")
    p = saved(p.select("token", "cls", "n", "pos", "comp", (F.col("comp") == F.col("m.comp")).alias("main")), "prefix-cross")
    # x leaves out the shingle's largest component; pairs inside x come once
    x = _as(p.where("NOT main").drop("main"), "x")
    y = _as(p, "y")
    j = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_comp") != F.col("y_comp"))
               & (F.col("y_main") | (F.col("x_cls") < F.col("y_cls")))
               & can_link(_side("x"), _side("y"), pct))
    return _pairs(j)


def differing(x: Column, y: Column) -> Column:
    """Bits in which two marks differ, the longer folded to the shorter: at
    most the shingles in which the sets do. Marks of more than twice the
    other's length are not compared (0)."""
    longer, shorter = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    m = F.size(shorter)

    def xor(s, t):
        return s.bitwiseXOR(t)

    folded = F.when(F.size(longer) == m, longer).otherwise(
        F.zip_with(F.slice(longer, 1, m), F.slice(longer, m + 1, m), xor))
    bits = F.aggregate(F.zip_with(folded, shorter, xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    return F.when(F.size(longer) <= 2 * m, bits).otherwise(F.lit(0))


def may_reach(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """Suffix filter: the pairs whose sets may differ in so few shingles that
    the others reach the threshold. Reads marks, no sets."""
    c = classes.select("cls", "n", "marks")
    p = pairs.join(_as(c, "x"), F.col("a") == F.col("x_cls")).join(_as(c, "y"), F.col("b") == F.col("y_cls"))
    both = F.col("x_n") + F.col("y_n")
    return p.where(both - differing(F.col("x_marks"), F.col("y_marks"))
                   >= 2 * needed(F.col("x_n"), F.col("y_n"), pct)).select("a", "b")


def pack(s: np.ndarray) -> bytes:
    """The leading 48 bits of sorted hashes: enough to tell the shingles of
    one pair apart, and a quarter less to ship."""
    return (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view("<u8")


def set_rows(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(cls, members) of the classes of the given row keys, from their text.

    One row of a class has the key; only rows repeated in every column share
    it, and a task gives each class once. What is still there twice doubles a
    verified pair, no more, so the sets are not shuffled to drop it."""
    def run(batches):
        given = set()
        for rb in batches:
            new = {set_class(s): s for s in shingle_sets(rb.column("text").to_pylist(), size) if len(s)}
            new = {c: s for c, s in new.items() if c not in given}
            given.update(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.binary()), pa.array([pack(s) for s in new.values()], pa.binary())],
                ["cls", "members"])

    chosen = docs.join(sized(keys.select(F.col("key").alias("k")), MAX_BROADCAST), F.col("key") == F.col("k"), "left_semi")
    return chosen.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "cls binary, members binary")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, pct: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold: the suffix filter
    first, then the whole sets of the pairs that are left, once per pair."""
    pairs = saved(may_reach(pairs, classes, pct), "near")
    cls = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    keys = cls.join(classes.select("cls", "key"), F.col("c") == F.col("cls")).select("key")
    full = saved(set_rows(docs, keys, size), "members")
    p = pairs.join(_as(full, "x"), F.col("a") == F.col("x_cls")).join(_as(full, "y"), F.col("b") == F.col("y_cls"))

    def run(batches):
        for rb in batches:
            ok = []
            for x, y in zip(rb.column("x_members"), rb.column("y_members")):
                s, t = unpack(x.as_buffer()), unpack(y.as_buffer())
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                ok.append(100 * both >= pct * (len(s) + len(t) - both))
            yield rb.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = p.select("a", "b", "x_members", "y_members").mapInArrow(run, "a binary, b binary")
    links = saved(links.distinct(), "verified")
    drop_saved(full)
    return links


def jaccard_components(docs: DataFrame, size: int = 5, pct: int = 80, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of ``docs``: key (see :func:`common.row_key`), doc_id,
    n_shingles, cls (class of equal sets), component_id."""
    d = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    described = saved(describe_sets(d, size, bits), "sets")
    rows = described.where("block IS NULL").select("key", "doc_id", "n", "cls")
    order = sketch(described, bits)
    # one row stands for each class of equal sets
    classes = saved(described.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("key", "n", "marks")).alias("m"))
                    .select("cls", "m.key", "m.n", "m.marks"), "classes")
    prefixes = saved(prefix_rows(d, order, size, pct), "prefixes")
    live = saved(live_rows(prefixes, pct), "live")
    drop_saved(prefixes)
    first = saved(leader_pairs(live, pct), "pairs")
    links = verified(first, d, classes, size, pct)
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    second = cross_pairs(live, comp, pct).join(first, ["a", "b"], "left_anti")
    more = verified(second, d, classes, size, pct)
    whole = components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    r = rows.join(whole.withColumnRenamed("node", "u"), F.col("cls") == F.col("u"), "left").select(
        "key", "doc_id", "n", "cls", F.coalesce("component", "cls").alias("group"))
    least = r.where("group IS NOT NULL").groupBy("group").agg(
        F.min("doc_id").alias("component_id")).withColumnRenamed("group", "g")
    return r.join(least, F.col("group") == F.col("g"), "left").select(
        "key", "doc_id", F.col("n").cast("long").alias("n_shingles"), "cls", "group",
        F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, size: int = 5, pct: int = 80, **kw) -> DataFrame:
    """One row of each group of near copies: the smallest id (nulls last),
    then the smallest key; of equal rows one. Rows without words all stay."""
    g = jaccard_components(docs, size, pct, **kw).where("group IS NOT NULL")
    best = g.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("m"))
    best = best.select(F.col("m.key").alias("_best"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    d = docs.select(row, row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.col("text").alias("_text"))
    worded = F.coalesce(F.col("_text").rlike(WORD), F.lit(False))
    one = (d.where(worded).join(best, F.col("_key") == F.col("_best"), "left_semi")
           .groupBy("_key").agg(F.first("_row").alias("_row")))
    return one.select("_row.*").unionByName(d.where(~worded).select("_row.*"))
