"""Phrase collocation mining: exact counts of frequent phrases by sampling
with a negative border, and scores of their weakest cut.

A phrase is a run of 1 to 3 words inside a piece of a text; it is frequent
with ``min_count`` occurrences or more. Occurrence counts only fall when a
phrase grows, so every part of a frequent phrase is frequent, too.

1. A sample of the documents (one in ``sample``, by hash) proposes words and
   two-word phrases: those found ``proposed_at`` times or more in it, a
   threshold below the corpus threshold times the sampling rate.
2. One full pass counts exactly the proposals and their negative border:
   every word, every two words that are both proposed, every three words
   whose two halves are both proposed. What the sample proposed and what it
   did not (the border) are counted alike.
3. A frequent phrase that was not proposed is a border failure: phrases that
   contain it have not been counted. Failures are added to the proposals and
   an expansion pass counts only what they newly allow, until a pass finds no
   failure. A wrong sample costs passes, never a phrase; results are exact.

The proposals travel as bitmaps of ``bits`` hash slots per length (bounded: 2 x
``bits`` / 8 bytes, and the ones of the pass before). Two proposals in one slot
only make a pass count a few more phrases. A pass tells what earlier passes
counted by testing their bitmaps, so every phrase is counted in one pass.

Inside a task, words are encoded by Arrow's dictionary per language and
stretch of text, phrases are numbers made of word codes, and each stretch
emits its distinct phrases with counts; Spark sums them per (language, phrase)
with partial aggregation. Texts are never shuffled, and no group is gathered:
a frequent word or a hot language is a handful of partial sums per task. A
long text is cut into stretches that look two words ahead.

Defined cases: null text counts as empty, null lang as ``und``; texts without
words count nothing; repeated rows count every time; extra columns are ignored;
an empty table, or one without a frequent phrase, gives no rows; equal scores
and counts are ordered by phrase (UTF-8 bytes).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import arrow_rows, saved, sized
from retentio.llm.textvec import mix, prefix_sums, stretches

# Delimiters of pieces and of words, lengths, thresholds.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
MIN_COUNT, TOP, COVERED_PCT = 10, 2000, 50
#: Bytes of text that a task encodes at once (at most 2**21 words would fit the codes).
STRETCH = 1 << 20
#: Rows per batch between Spark and Python, in and out.
ROWS_IN, ROWS_OUT = 1_000, 1 << 15
#: Slots of a proposal bitmap.
BITS = 1 << 25
SAMPLE, PROPOSED_AT = 8, 2
#: Frequent words or phrases up to which a join side is broadcast.
SMALL = 200_000

_ends = np.zeros(256, bool)
_ends[list(PIECE_ENDS)] = True
_gap = _ends.copy()
_gap[list(BLANKS)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_AHEAD = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,2}")
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_CODE = 21
_LOW = (1 << _CODE) - 1


def pieces_of(raw: bytes, limit: int = STRETCH) -> Iterator[tuple[bytes, int]]:
    """Stretches of about ``limit`` bytes that end between words, each with up
    to two words more to look ahead at, and the length without these."""
    a = 0
    while a < len(raw):
        b = min(a + limit, len(raw))
        if b < len(raw):
            near = max(raw.rfind(bytes([c]), a + 1, b) for c in BLANKS + PIECE_ENDS)
            if near < 0:  # a word longer than the stretch
                m = _GAP.search(raw, b)
                near = m.start() if m else len(raw)
            b = near
        yield raw[a:_AHEAD.match(raw, b).end()], b - a
        a = b


def encode_words(raw: bytes, own: int):
    """Word codes of a stretch, the dictionary of its words, which words are
    followed by the next in their piece, and how many belong to the stretch."""
    b = np.frombuffer(raw + b" ", np.uint8)
    gap = _gap[b]
    edge = np.diff(gap.view(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, bool), 0
    ends = np.cumsum(_ends[b], dtype=np.int32)
    joined = np.append(ends[start[1:]] == ends[start[:-1]], False)
    # words one after another, a blank behind each
    after = np.zeros(len(b), bool)
    after[end] = True
    packed = _lower[b]
    packed[after] = 0x20
    packed = packed[~gap | after]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start + 1, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            pc.binary_slice(coded.dictionary, 0, -1), joined, int(np.searchsorted(start, own)))


def word_slots(words: pa.Array, lang: str) -> np.ndarray:
    """64-bit hashes of the words of a language."""
    data = b"".join(words.to_pylist())
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), out=offsets[1:])
    h = stretches(prefix_sums(np.frombuffer(data, np.uint8).astype(np.uint64)), offsets[:-1], offsets[1:])
    name = lang.encode("utf-8", "surrogatepass")
    seed = stretches(prefix_sums(np.frombuffer(name, np.uint8).astype(np.uint64)), np.array([0]), np.array([len(name)]))
    return mix(h ^ seed)


def pair_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of two-word phrases from those of their words."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


class Proposals:
    """Bitmaps of the proposed words and two-word phrases."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.words, self.pairs = words, pairs
        self.mask = np.uint64(8 * len(words) - 1)

    @classmethod
    def none(cls, bits: int) -> Proposals:
        return cls(np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8))

    def has(self, bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
        at = slots & self.mask
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def __or__(self, other: Proposals) -> Proposals:
        return Proposals(self.words | other.words, self.pairs | other.pairs)

    def same(self, other: Proposals) -> bool:
        return bool((self.words == other.words).all() and (self.pairs == other.pairs).all())


def count_stretch(raw: bytes, own: int, lang: str, old: Proposals | None, new: Proposals | None):
    """Yields (phrases, counts) of a stretch. Without proposals (the sample):
    all words and all two-word phrases. With ``new``: the phrases that it
    allows and ``old`` (None: nothing was counted before) does not; words, and
    their number as the phrase without words, in the first pass only. Phrases
    come as one key: language, line feed (in no phrase), words."""
    ids, words, joined, own = encode_words(raw, own)
    if not own:
        return
    mark = lang.encode("utf-8", "surrogatepass") + b"\n"
    marked = pc.binary_join_element_wise(mark, words, b"")
    two = np.flatnonzero(joined[:own])
    three = two[joined[two + 1]] if len(two) else two
    if new is not None:
        h = word_slots(words, lang)

        def both(p):
            """Positions whose pair of words is proposed; pairs that are."""
            known = p.has(p.words, h)[ids]
            pair_known = np.zeros(len(ids), bool)
            at = np.flatnonzero(joined)
            at = at[known[at] & known[at + 1]]
            pair_known[at] = p.has(p.pairs, pair_slots(h[ids[at]], h[ids[at + 1]]))
            return known, pair_known

        known, pairs = both(new)
        take2, take3 = known[two] & known[two + 1], pairs[three] & pairs[three + 1]
        if old is not None:
            known, pairs = both(old)
            take2 &= ~(known[two] & known[two + 1])
            take3 &= ~(pairs[three] & pairs[three + 1])
        two, three = two[take2], three[take3]
    else:
        three = three[:0]
    if old is None:
        n = np.bincount(ids[:own], minlength=len(words))
        yield marked, n
        yield pa.array([mark], pa.binary()), np.array([own])
    for at, size in ((two, 2), (three, 3)):
        if not len(at):
            continue
        key = ids[at]
        for k in range(1, size):
            key = key << _CODE | ids[at + k]
        seen = pa.array(key).value_counts()
        value = seen.field(0).to_numpy()
        parts = [(words if k else marked).take(pa.array(value >> (_CODE * (size - 1 - k)) & _LOW)) for k in range(size)]
        yield pc.binary_join_element_wise(*parts, b" "), seen.field(1).to_numpy()


def phrase_counts(docs: DataFrame, old: Proposals | None, new: Proposals | None) -> DataFrame:
    """(lang, phrase, f) summed over ``docs`` (_lang, _text): see
    :func:`count_stretch`."""
    shared = docs.sparkSession.sparkContext.broadcast((old, new))

    def rows(raw, lang):
        for stretch, own in pieces_of(raw):
            for phrases, n in count_stretch(stretch, own, lang, *shared.value):
                live = n > 0
                if not live.all():
                    phrases, n = phrases.filter(pa.array(live)), n[live]
                for a in range(0, len(n), ROWS_OUT):
                    yield pa.RecordBatch.from_arrays(
                        [phrases.slice(a, ROWS_OUT).cast(pa.string()), pa.array(n[a:a + ROWS_OUT], pa.int64())], ["key", "f"])

    def run(batches):
        # texts of a language gather until they fill a stretch
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for rb in batches:
            for lang, text in zip(rb.column("_lang").to_pylist(), rb.column("_text").to_pylist()):
                text = text.encode("utf-8", "surrogatepass")
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= STRETCH:
                    yield from rows(b"\n".join(waiting.pop(lang)) + b"\n", lang)
                    del size[lang]
            while sum(size.values()) > 4 * STRETCH:  # many languages: the fullest goes first
                lang = max(size, key=size.get)
                yield from rows(b"\n".join(waiting.pop(lang)) + b"\n", lang)
                del size[lang]
        for lang, texts in waiting.items():
            yield from rows(b"\n".join(texts) + b"\n", lang)

    sums = docs.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    return sums.select(F.left("key", F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f")


def bitmaps(phrases: DataFrame, bits: int) -> Proposals:
    """The bitmaps of (lang, phrase) rows of one or two words."""
    def run(batches):
        for rb in batches:
            coded = rb.column("lang").dictionary_encode()
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                text = rb.column("phrase").filter(pc.equal(coded.indices, k)).to_pylist()
                parts = [t.encode("utf-8", "surrogatepass").split(b" ") for t in text]
                for size in (1, 2):
                    rows = [p for p in parts if len(p) == size]
                    h = [word_slots(pa.array([p[i] for p in rows], pa.binary()), lang) for i in range(size)]
                    h = pair_slots(*h) if size == 2 else h[0]
                    slot = (h & np.uint64(bits - 1)).astype(np.int64) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size)), pa.array(slot)], ["size", "slot"])

    got = (phrases.select("lang", "phrase").mapInArrow(run, "size long, slot long")
           .groupBy("size", F.bitmap_bucket_number("slot").alias("bucket"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map")).collect())
    out = Proposals.none(bits)
    for r in got:
        a = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["map"]), np.uint8)[:bits // 8]
        (out.words if r["size"] == 1 else out.pairs)[a:a + 4096] |= part
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample: int = SAMPLE,
                     proposed_at: int = PROPOSED_AT, bits: int = BITS) -> DataFrame:
    """Exact (lang, phrase, size, f) of every phrase of 1 to 3 words with f of
    ``min_count`` or more, and per language the row of size 0 with the number
    of all words. Written tables; one full pass plus the expansion passes."""
    with arrow_rows(docs.sparkSession, ROWS_IN):
        return _frequent(docs, min_count, sample, proposed_at, bits)


def _frequent(docs: DataFrame, min_count: int, sample: int, proposed_at: int, bits: int) -> DataFrame:
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("_lang"),
                    F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.col("doc_id").cast("string").alias("_id"))
    chosen = F.pmod(F.xxhash64("_id", "_text"), F.lit(sample)) == 0
    d = d.where(F.col("_text") != "")
    proposed = phrase_counts(d.where(chosen).select("_lang", "_text"), None, None).where(
        (F.col("f") >= proposed_at) & (F.col("phrase") != ""))
    old, new = None, bitmaps(proposed, bits)  # the first job
    d = d.select("_lang", "_text")
    words = F.length("phrase") - F.length(F.replace(F.col("phrase"), F.lit(" "))) + 1
    counted = None
    while True:
        got = phrase_counts(d, old, new).where((F.col("f") >= min_count) | (F.col("phrase") == ""))
        got = saved(got.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(words).alias("size"), "f"),
                    "phrases")
        counted = got if counted is None else counted.unionByName(got)
        grown = new | bitmaps(got.where("size IN (1, 2)"), bits)
        if grown.same(new):  # no frequent phrase outside the proposals: nothing is left uncounted
            return counted
        old, new = new, grown


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates (2 or 3 words) with their lowest-scoring cut: lang, phrase,
    size, a, l, r, score. Parts are looked up by equi-joins."""
    w = F.split("phrase", " ")
    c = frequent.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), w.alias("w"))
    cuts = F.filter(F.array(
        F.struct(F.lit(1).alias("k"), F.get("w", F.lit(0)).alias("head"),
                 F.array_join(F.slice("w", 2, 2), " ").alias("tail")),
        F.struct(F.lit(2).alias("k"), F.array_join(F.slice("w", 1, 2), " ").alias("head"),
                 F.get("w", F.lit(2)).alias("tail"))), lambda x: x["k"] < F.col("size"))
    c = c.select("lang", "phrase", "size", "a", F.explode(cuts).alias("cut")).select(
        "lang", "phrase", "size", "a", "cut.*")
    parts = frequent.where("size IN (1, 2)")
    left = sized(parts.select(F.col("lang").alias("hl"), F.col("phrase").alias("hp"), F.col("f").alias("l")), SMALL)
    right = sized(parts.select(F.col("lang").alias("tl"), F.col("phrase").alias("tp"), F.col("f").alias("r")), SMALL)
    c = c.join(left, (F.col("lang") == F.col("hl")) & (F.col("head") == F.col("hp")))
    c = c.join(right, (F.col("lang") == F.col("tl")) & (F.col("tail") == F.col("tp")))
    a, both = F.col("a").cast("decimal(16,0)"), F.col("l").cast("decimal(16,0)") * F.col("r").cast("decimal(16,0)")
    # a * a <= l * r, so the quotient is at most a million; 38 digits hold all products
    million = (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    c = c.withColumn("_num", million.cast("decimal(38,0)")).withColumn("_den", both.cast("decimal(38,0)"))
    c = c.withColumn("score", F.expr("_num div _den"))
    least = F.min(F.struct("score", "k", "l", "r"))
    c = c.groupBy("lang", "phrase", "size", "a").agg(least.alias("m"))
    return c.select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def uncovered(candidates: DataFrame, pct: int = COVERED_PCT) -> DataFrame:
    """Candidates that no longer candidate holds in ``pct`` % of their
    occurrences or more."""
    w = F.split("phrase", " ")
    inner = F.explode(F.array_distinct(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " "))))
    longer = candidates.where("size = 3").select(F.col("lang").alias("ol"), inner.alias("op"), F.col("a").alias("oa"))
    longer = longer.groupBy("ol", "op").agg(F.max("oa").alias("oa"))
    c = candidates.join(longer, (F.col("lang") == F.col("ol")) & (F.col("phrase") == F.col("op")), "left")
    held = (F.col("size") == 2) & (F.col("oa").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * pct)
    return c.where(~F.coalesce(held, F.lit(False))).select(*candidates.columns)


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, **kw) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r,
    n, score."""
    frequent = frequent_phrases(docs, min_count, **kw)
    total = frequent.where("size = 0").select(F.col("lang").alias("nl"), F.col("f").alias("n"))
    # written: ranked and covered candidates both come from it
    kept = uncovered(saved(scored(frequent), "collocations"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    kept = kept.join(total, F.col("lang") == F.col("nl"))
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
