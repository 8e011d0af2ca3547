"""Removal of repeated word passages through a sparse de Bruijn graph.

Nodes are sampled token k-mers: the least hashed ``K``-gram of each window of
``width`` words (equal windows sample the same one). The edge at an
occurrence of a node is the token string of all windows that sampled it, from
the first word of the first to the last word of the last; consecutive edges
of a document overlap by all but one window. Edges found in several documents
are joined with the smallest of these; runs of such edges through nodes that
do not branch (one successor and one predecessor edge, same smallest
document) are compacted into paths, whose occurrences are the long repeated
spans. Where an edge's text is new but its node occurs in a smaller document
with other neighbours (the rim of a passage), windows are verified one by one
by their source coordinates: exact window hashes are joined with the smallest
document that holds them.

A word goes if a window that covers it also starts in a document with a
smaller id. All counts are pre-aggregated by hash; a passage that a third of
all documents share is one node row per distinct neighbourhood.

Defined cases: null and blank texts have no words; texts with fewer words than
``width`` lose nothing; documents with a null id count as larger than all;
rows with equal ids never make each other go; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from retentio.llm import textvec as tv
from retentio.llm.common import by_lists, row_key, saved

WIDTH = 50
K = 8
MAX_BROADCAST = 500_000
NO_ID = (1 << 63) - 1


def word_sums(texts: list[bytes]):
    """Per text: prefix sums over its word hashes."""
    for part in tv.chunks(texts):
        h, at = tv.word_hashes(texts[part])
        for a, b in zip(at[:-1], at[1:]):
            yield tv.prefix_sums(h[a:b])


def edges(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(doc, id, idx, a, b, node, edge, next): every edge occurrence; a and b
    are the first and last window start, next the following edge (0: none)."""
    names = ["doc", "id", "idx", "a", "b", "node", "edge", "next"]

    def run(batches):
        for rb in batches:
            cols = [[] for _ in names]
            keys, ids = rb.column("doc").to_pylist(), rb.column("id").to_pylist()
            for doc, id_, sums in zip(keys, ids, word_sums(rb.column("text").to_pylist())):
                if len(sums) <= width:
                    continue
                p, a, b = tv.anchors(sums, width, k)
                node = tv.stretches(sums, p, p + k)
                edge = tv.mix(tv.stretches(sums, a, b + width) + (p - a).astype(np.uint64)).view(np.int64)
                after = np.concatenate([edge[1:], [0]])
                for c, v in zip(cols, (np.full(len(a), doc), np.full(len(a), id_), np.arange(len(a)), a, b,
                                       node.view(np.int64), edge, after)):
                    c.append(v)
            flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names)

    return docs.select("doc", "id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def compacted(rows: DataFrame) -> DataFrame:
    """Nonbranching runs of repeated edges: (doc, id, a, b, least).

    ``rows`` are occurrences of edges in several documents, with the smallest
    (``least``). An occurrence continues the path of the one before it in its
    document if that edge has one successor, this one has one predecessor, and
    both share the smallest document."""
    links = rows.where("next <> 0").groupBy("edge", "next").agg(F.max("least").alias("l"))
    out = links.groupBy("edge").agg(F.count(F.lit(1)).alias("o")).where("o = 1").select(F.col("edge").alias("e1"))
    into = links.groupBy("next").agg(F.count(F.lit(1)).alias("i")).where("i = 1").select(F.col("next").alias("e2"))
    through = links.join(out, F.col("edge") == F.col("e1")).join(into, F.col("next") == F.col("e2"))
    through = through.select(F.col("edge").alias("f"), F.col("next").alias("t"))
    r = rows.join(through, (F.col("edge") == F.col("f")) & (F.col("next") == F.col("t")), "left")
    w = Window.partitionBy("doc").orderBy("idx")
    start = ~F.coalesce((F.lag("idx").over(w) == F.col("idx") - 1) & F.lag(F.col("f").isNotNull()).over(w)
                        & (F.lag("least").over(w) == F.col("least")), F.lit(False))
    r = r.withColumn("_start", start.cast("int"))
    r = r.withColumn("_path", F.sum("_start").over(w))
    return r.groupBy("doc", "_path").agg(F.min("id").alias("id"), F.min("a").alias("a"), F.max("b").alias("b"),
                                         F.min("least").alias("least")).drop("_path")


def window_rows(open_: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(window, id, doc, at): the window hashes of the open (doc, a, b)."""
    lists = saved(open_.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("open")), "open")
    d = by_lists(docs, lists, MAX_BROADCAST)[0].dropDuplicates(["doc"])
    names = ["window", "id", "doc", "at"]

    def run(batches):
        for rb in batches:
            cols = [[] for _ in names]
            lists = rb.column("open").to_pylist()
            keys, ids = rb.column("doc").to_pylist(), rb.column("id").to_pylist()
            for doc, id_, open_, sums in zip(keys, ids, lists, word_sums(rb.column("text").to_pylist())):
                at = np.unique(np.concatenate([np.arange(r["a"], r["b"] + 1) for r in open_]))
                h = tv.stretches(sums, at, at + width).view(np.int64)
                for c, v in zip(cols, (h, np.full(len(at), id_), np.full(len(at), doc), at)):
                    c.append(v)
            flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names)

    return d.select("doc", "id", "text", "open").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_spans(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc, a, b): first and last start of windows that a smaller id holds."""
    e = saved(edges(docs, width, k), "edges")
    kinds = e.groupBy("node", "edge").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    nodes = kinds.groupBy("node").agg(F.count(F.lit(1)).alias("kinds"), F.min("least").alias("first"),
                                      F.max("most").alias("last")).where("first < last")
    kinds = saved(kinds.join(nodes, "node").select(
        F.col("node").alias("n2"), F.col("edge").alias("e2"), "least", "most", "kinds", "first"), "kinds")
    r = e.join(kinds, (F.col("node") == F.col("n2")) & (F.col("edge") == F.col("e2"))).drop("n2", "e2")
    r = saved(r, "shared")
    paths = compacted(r.where("least < most"))
    settled = paths.where("least < id").select("doc", "a", "b")
    # the smallest document's edges under a node with several kinds stay open
    open_ = r.where("kinds > 1 AND id = least").select("doc", "a", "b")
    w = saved(window_rows(open_, docs, width), "windows")
    least = w.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(
        F.col("window").alias("w2"), "least")
    found = w.join(least, F.col("window") == F.col("w2")).where("least < id").select(
        "doc", F.col("at").alias("a"), F.col("at").alias("b"))
    return settled.unionByName(found)


def cut_words(text: bytes, starts: list[tuple[int, int]], width: int) -> tuple[list[bytes], int]:
    """The words that no window covers, and the number of words."""
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in starts:
        gone[a] += 1
        gone[b + width] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep) if k], len(words)


def strip(docs: DataFrame, width: int = WIDTH, k: int = K, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256
    and, with ``texts``, kept (the kept words, joined by one space)."""
    d = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id",
                    F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                    F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    spans = saved(repeated_spans(d, width, k).groupBy("doc").agg(
        F.collect_set(F.struct("a", "b")).alias("open")), "spans")
    touched, others = by_lists(d, spans, MAX_BROADCAST)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary"

    def run(batches):
        for rb in batches:
            n, gone, sha, kept = [], [], [], []
            lists = rb.column("open").to_pylist() if "open" in rb.schema.names else [[]] * rb.num_rows
            for text, open_ in zip(rb.column("text").to_pylist(), lists):
                words, total = cut_words(text, [(r["a"], r["b"]) for r in open_], width) if open_ else (text.split(), None)
                rest = b" ".join(words)
                total = len(words) if total is None else total
                for c, v in zip((n, gone, sha, kept), (total, total - len(words), hashlib.sha256(rest).hexdigest(),
                                                       rest if texts else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = (touched.select("doc_id", "text", "open").mapInArrow(run, schema)
           .unionByName(others.select("doc_id", "text").mapInArrow(run, schema)))
    return out if texts else out.drop("kept")
