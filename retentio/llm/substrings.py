"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes if a ``width``-byte string that covers it starts anywhere else,
too. Two steps keep the sorted suffixes few and the blocks small:

1. Every suffix start belongs to the least hashed 64-byte window among its
   ``width`` bytes (its anchor) at a distance, in blocks. The
   bytes that all starts of such a part have in common (the core) key the
   part: equal strings have equal keys. A part alone under its key repeats
   nothing; parts with the same bytes as a whole repeat wholly; both are
   settled by counting hashes, without text.
2. For keys with several different parts, one part of each kind ships its
   bytes to the key's task: the suffixes of these parts are the buckets of the
   suffix array. Buckets are sorted block by block: by their first ``PERIOD``
   bytes, longer ties by the ranks of a difference-cover sample, computed
   beforehand within the block. For any two suffixes some shift below
   ``PERIOD`` takes both to sample positions, so one comparison of ranks
   settles a tie however long. Neighbours that agree in ``width`` bytes are
   repeats.

A key with more than ``MAX_KINDS`` different parts (the rim of a passage that
many documents hold) is not sorted: its parts, one of each kind, are cut into
shorter blocks of starts, whose cores and keys are longer, and go through step
1 again (``BLOCKS``). Blocks of one start have the whole ``width`` bytes as
their key, so that counting settles what no shorter core told apart.

Memory is bounded by ``BLOCK_BYTES`` and ``MAX_KINDS`` parts, however many
documents share a passage. Hot passages are one kind with a count; counting
pre-aggregates. No text is shuffled but that of open parts, of documents with
parts under a key of too many kinds, and of documents with removals.

Defined cases: null text is empty; texts shorter than ``width`` repeat
nothing; repeated rows repeat each other; matches never cross documents.
64-bit hashes stand for byte strings (a collision needs about 2**32 of them
under one key).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm import textvec as tv
from retentio.llm.common import by_lists, row_key, saved

WIDTH = 400
ANCHOR = 64
#: Starts of a part, and of the parts that one is cut into; the last must be 1.
BLOCKS = (128, 16, 1)
BLOCK_BYTES = 1 << 20
#: Different parts under one key that are sorted together.
MAX_KINDS = 2_000
#: Document keys up to this count are broadcast to select texts.
MAX_BROADCAST = 500_000
# A perfect difference set; every residue is a difference of two.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)


def shift_table() -> np.ndarray:
    """For residues (i, j): the least shift from 1 to PERIOD that takes both
    into the cover."""
    inside = np.isin(np.arange(2 * PERIOD + 1) % PERIOD, COVER)
    t = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            t[i, j] = 1 + np.flatnonzero(inside[i + 1:i + PERIOD + 1] & inside[j + 1:j + PERIOD + 1])[0]
    return t


def parts(docs: DataFrame, width: int, size: int = BLOCKS[0]) -> DataFrame:
    """(doc, a, b, key, whole) of all parts of (doc, text) rows, texts in bytes;
    a and b are the first and last start. ``size`` is the most starts of a
    part. With a column ``open`` of (a, b), only the parts inside these."""
    inside = "open" in docs.columns

    def run(batches):
        for rb in batches:
            cols = [[], [], [], [], []]
            opens = rb.column("open").to_pylist() if inside else [None] * rb.num_rows
            for doc, text, open_ in zip(rb.column("doc").to_pylist(), rb.column("text").to_pylist(), opens):
                if text is None or len(text) < width:
                    continue
                sums = tv.prefix_sums(np.frombuffer(text, np.uint8).astype(np.uint64))
                p, a, b = tv.anchors(sums, width, ANCHOR, size)
                if inside:
                    # parts of a shorter block lie in one part of a longer block
                    lo, hi = np.array(sorted((r["a"], r["b"]) for r in open_), np.int64).T
                    at = np.searchsorted(lo, a, side="right") - 1
                    held = (at >= 0) & (a <= hi[at])
                    p, a, b = p[held], a[held], b[held]
                block = (p - a) // size
                core = p - size * block  # the latest start that the block allows
                key = tv.mix(tv.stretches(sums, core, core - size + 1 + width) + block.astype(np.uint64))
                whole = tv.mix(tv.stretches(sums, a, b + width) + (core - a).astype(np.uint64))
                for c, v in zip(cols, (np.full(len(a), doc), a, b, key.view(np.int64), whole.view(np.int64))):
                    c.append(v)
            flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], ["doc", "a", "b", "key", "whole"])

    return docs.select("doc", "text", *["open"] * inside).mapInArrow(
        run, "doc long, a long, b long, key long, whole long")


def cover_ranks(block: np.ndarray, left: np.ndarray, periods: int) -> np.ndarray:
    """Ranks of the strings of ``periods`` * PERIOD bytes at the cover's
    positions of a block (0 elsewhere), by doubling. ``left`` is the number of
    bytes from a position to its row's end."""
    at = np.flatnonzero(np.isin(np.arange(len(block)) % PERIOD, COVER))

    def joined(x, n, y, m):
        out = np.zeros(len(block), np.int64)
        fit = at[left[at] >= (n + m) * PERIOD]
        out[fit] = pair_ranks(x[fit], y[fit + n * PERIOD])
        return out

    power = np.zeros(len(block), np.int64)
    fit = at[left[at] >= PERIOD]
    power[fit] = period_ranks(block, fit)
    out, done, size = None, 0, 1
    while done < periods:
        if periods & size:
            out = power if out is None else joined(out, done, power, size)
            done += size
        if done < periods:
            power = joined(power, size, power, size)
            size *= 2
    return out


def pair_ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.unique(x << np.int64(32) | y, return_inverse=True)[1] + 1


def period_ranks(block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lexicographic ranks (from 1, equals equal) of PERIOD bytes at ``at``."""
    padded = np.concatenate([block, np.zeros(16, np.uint8)])
    rank = np.zeros(len(at), np.int64)
    for k in range(0, PERIOD, 4):
        word = np.zeros(len(at), np.int64)
        for j in range(k, k + 4):
            word = word << np.int64(8) | (padded[at + j].astype(np.int64) if j < PERIOD else 0)
        rank = np.unique(rank << np.int64(32) | word, return_inverse=True)[1]
        if len(rank) and rank.max() == len(rank) - 1:
            # all differ already: later bytes change nothing
            break
    return rank + 1


def sort_bucket(block: np.ndarray, left: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the first ``width`` bytes of the suffixes at ``starts``, equal
    ranks for equal bytes. Suffixes are sorted by their first PERIOD bytes;
    ties go by the cover's ranks at the shift of the two residues, and, where
    these tie as well, by the last bytes of the width."""
    periods = width // PERIOD - 1
    ranks = cover_ranks(block, left, periods)
    tails = [t for t in (width - 2 * PERIOD, width - PERIOD) if t > 1 + (periods - 1) * PERIOD]
    last = [period_ranks(block, starts + t) for t in tails]
    shift = shift_table()
    group = period_ranks(block, starts) * 3
    todo = np.flatnonzero(_several(group))
    while len(todo):
        # three-way partition of every open group around its first suffix
        order = todo[np.argsort(group[todo], kind="stable")]
        g = group[order]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        pivot = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        i, j = starts[order], starts[pivot]
        s = shift[i % PERIOD, j % PERIOD]
        side = np.sign(ranks[i + s] - ranks[j + s])
        for r in last:
            side = np.where(side == 0, np.sign(r[order] - r[pivot]), side)
        group[order] = g + side
        group = np.unique(group, return_inverse=True)[1] * 3
        # a pivot's equals are done; larger and smaller suffixes go on
        todo = order[side != 0]
        todo = todo[_several(group[todo])] if len(todo) else todo
    return group // 3


def _several(g: np.ndarray) -> np.ndarray:
    _, inverse, n = np.unique(g, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def repeated_starts(texts: list[bytes], many: list[bool], width: int):
    """For each part's bytes (starts per part, and the parts): starts whose ``width`` bytes also occur in
    another part of the block (``many``: the part itself occurs repeatedly)."""
    block = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(block))
    starts = np.flatnonzero(left >= width)
    owner = np.searchsorted(ends, starts, side="right")
    hit = _several(sort_bucket(block, left, starts, width)) & ~np.array(many, bool)[owner]
    at, who = starts[hit], owner[hit]
    rows, cut = np.unique(who, return_index=True)
    return [x - ends[k] + lens[k] for k, x in zip(rows, np.split(at, cut[1:]))], rows


def open_parts(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(key, doc, a, many, part): the bytes of the given (doc, a, b, key, many)."""
    lists = saved(rows.groupBy("doc").agg(F.collect_list(F.struct("a", "b", "key", "many")).alias("open")), "open")
    # a repeated row ships its parts once
    d = by_lists(docs, lists, MAX_BROADCAST)[0].dropDuplicates(["doc"])

    def run(batches):
        for rb in batches:
            out = [[], [], [], [], []]
            for doc, text, open_ in zip(*(rb.column(c).to_pylist() for c in ("doc", "text", "open"))):
                for r in open_:
                    for c, v in zip(out, (r["key"], doc, r["a"], r["many"], text[r["a"]:r["b"] + width])):
                        c.append(v)
                if len(out[0]) >= 20_000:
                    yield batch(out)
                    out = [[], [], [], [], []]
            yield batch(out)

    def batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                          ["key", "doc", "a", "many", "part"])

    return d.select("doc", "text", "open").mapInArrow(run, "key long, doc long, a long, many boolean, part binary")


def sorted_blocks(open_: DataFrame, width: int) -> DataFrame:
    """(doc, a, b): repeated starts of the open parts, bucket by bucket."""
    def run(batches):
        held, size = [], 0

        def flush():
            hits, rows = repeated_starts([h[4] for h in held], [h[3] for h in held], width)
            doc, a, b = [], [], []
            for k, s in zip(rows, hits):
                cut = np.flatnonzero(np.diff(s) != 1)
                first = s[np.concatenate([[0], cut + 1])]
                last = s[np.concatenate([cut, [len(s) - 1]])]
                doc += [held[k][1]] * len(first)
                a += list(first + held[k][2])
                b += list(last + held[k][2])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, a, b)], ["doc", "a", "b"])

        for rb in batches:
            for row in zip(*(rb.column(c).to_pylist() for c in ("key", "doc", "a", "many", "part"))):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    dealt = open_.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc long, a long, b long")


def shared_parts(p: DataFrame) -> DataFrame:
    """The parts (doc, a, b, key, whole) that are not alone under their key,
    with n (parts of the same bytes), kinds (different parts under the key)
    and first (one document that has the part)."""
    kinds = p.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    per_key = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    kinds = saved(kinds.join(per_key, "key").select(
        F.col("key").alias("k"), F.col("whole").alias("w"), "n", F.col("doc").alias("first"), "kinds"), "kinds")
    r = p.join(kinds, (F.col("key") == F.col("k")) & (F.col("whole") == F.col("w")))
    return saved(r.select("doc", "a", "b", "key", "whole", "n", "kinds", "first"), "shared")


def one_of_each(r: DataFrame) -> DataFrame:
    """(doc, a, b, key, many): one part of each kind."""
    one = r.where("doc = first").groupBy("key", "whole").agg(
        F.min("a").alias("a"), F.min(F.col("b") - F.col("a")).alias("long"), F.first("doc").alias("doc"),
        F.max(F.col("n") > 1).alias("many"))
    return one.select("doc", "a", (F.col("a") + F.col("long")).alias("b"), "key", "many")


def repeated_spans(docs: DataFrame, width: int = WIDTH, max_kinds: int = MAX_KINDS) -> DataFrame:
    """(doc, a, b): runs of starts whose ``width`` bytes occur elsewhere."""
    found, p = [], parts(docs, width)
    for size, shorter in zip(BLOCKS, (*BLOCKS[1:], None)):
        r = shared_parts(saved(p, "parts"))
        found.append(r.where("n > 1").select("doc", "a", "b"))
        if shorter is None:  # a key is the whole part
            break
        # one part of each kind under a key with several kinds stays open
        found.append(sorted_blocks(open_parts(
            one_of_each(r.where(F.col("kinds").between(2, max_kinds))), docs, width), width))
        hot = r.where(F.col("kinds") > max_kinds)
        if hot.isEmpty():
            break
        lists = saved(one_of_each(hot).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("open")), "hot")
        p = parts(by_lists(docs, lists, MAX_BROADCAST)[0].dropDuplicates(["doc"]), width, shorter)
    return functools.reduce(DataFrame.unionByName, found)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the sorted [start, end) spans, bytes removed, runs."""
    out, at, removed, runs, begin = [], 0, 0, 0, -1
    for a, b in spans:
        if a > at or begin < 0:
            out.append(text[at:a])
            runs, begin = runs + 1, a
            removed, at = removed + b - a, b
        elif b > at:
            removed, at = removed + b - at, b
    out.append(text[at:])
    return b"".join(out), removed, runs


def strip(docs: DataFrame, width: int = WIDTH, texts: bool = True, max_kinds: int = MAX_KINDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, with ``texts``, kept (the remaining bytes)."""
    d = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id",
                    F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    spans = saved(repeated_spans(d, width, max_kinds).groupBy("doc").agg(
        F.collect_set(F.struct("a", "b")).alias("open")), "spans")
    touched, others = by_lists(d, spans, MAX_BROADCAST)

    def run(batches):
        for rb in batches:
            n, gone, runs, sha, kept = [], [], [], [], []
            for text, open_ in zip(rb.column("text").to_pylist(), rb.column("open").to_pylist()):
                rest, removed, count = cut(text, sorted((r["a"], r["b"] + width) for r in open_))
                for c, v in zip((n, gone, runs, sha, kept), (len(text), removed, count, hashlib.sha256(rest).hexdigest(),
                                                             rest if texts else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    done = touched.select("doc_id", "text", "open").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                          F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
                          F.col("text").alias("kept"))
    out = done.unionByName(whole)
    return out if texts else out.drop("kept")
