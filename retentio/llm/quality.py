"""Quality rules: hashed n-gram log-likelihood ratios with plain base rules.

Two multinomials over ``buckets`` hash buckets of token unigrams and bigrams
(lower case, letters apart from punctuation) are estimated with add-one smoothing: the trusted target from
documents whose label says so, the raw corpus from every document. A
document's score is the mean over its n-grams of
``log(p_target / p_raw)``; it is kept when it passes the base rules, the
score is at least ``threshold`` and its toxic peak is below ``peak``, fixed
numbers, so every document's verdict depends on its own text and the models
only.

The mean cannot show a few bad words in much good prose. The toxic peak can:
the same ratio between documents labelled toxic and the trusted ones, over
windows of one token, and the highest window counts. Its multinomials count
the documents that hold a token, so that one text cannot make a word toxic by
repeating it; a token is judged by the lesser ratio of two hash buckets, so
that a harmless word which shares a bucket with a bad one is not taken for it.
Ratios below ``FLOOR`` count as 0.

The labelled sets are a classifier's training samples: the ``max_trusted`` good
ids (and as many toxic ones) with the smallest id hash (documented bound: their
ids are broadcast, so no text is shuffled). The raw model counts all documents.
The raw model is a row of ``buckets`` doubles, the toxic one two tables of at
most ``TOXIC_BUCKETS`` rows that are joined by broadcast. Counting and scoring explode the tokens inside one stage and sum at once, so only sums
are shuffled.

Defined cases: null, empty and blank texts have no words and fail the base
rules (scores null); without any trusted document all scores are 0, and
without any toxic one all peaks; an empty table gives an empty result;
repeated rows are judged alike, each in its row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import WORD, row_key, saved, words

BUCKETS = 8192
# runs of letters (any character beyond ASCII counts as one) and digits, or of punctuation
TOKEN = r"[a-z0-9\x{80}-\x{10FFFF}]+|[^a-z0-9\x{80}-\x{10FFFF}\s]+"
#: Bound of the labelled sample behind the trusted model.
MAX_TRUSTED = 20_000
#: Mean log ratio per n-gram below which a text is unlike the trusted set.
THRESHOLD = -0.35
#: Buckets of either hash of the toxic model, and the log ratio of a token from
#: which a document is toxic.
TOXIC_BUCKETS = 1 << 16
PEAK = 2.75
#: Log ratios below this count as 0 in the toxic peak.
FLOOR = 1.0


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and runs of anything else."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def ngrams(df: DataFrame, buckets: int) -> DataFrame:
    """One row per token of the array ``_k``: the other columns, the token's
    hash (``_x``), its bucket (``_b1``) and that of it with the next (``_b2``,
    null at the end)."""
    d = df.select("*", F.posexplode("_k").alias("_p", "_t"))
    nxt = F.get("_k", F.col("_p") + 1)
    return d.select(*[c for c in df.columns if c != "_k"], F.xxhash64("_t").alias("_x"),
                    _bucket(F.col("_t"), buckets=buckets).alias("_b1"),
                    F.when(nxt.isNotNull(), _bucket(F.col("_t"), nxt, buckets=buckets)).alias("_b2"))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids of the trusted sample: good quality, not toxic."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
    return (good.select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted))


def _packed(counts: DataFrame, by: list[str], bucket: str):
    """Counts per bucket for the driver, 4,096 buckets as one text: yields
    (values of ``by``, buckets, counts)."""
    cell = F.concat_ws(":", F.col(bucket).cast("string"), F.col("count").cast("string"))
    rows = counts.groupBy(*by, F.shiftright(bucket, 12).alias("_part")).agg(F.array_join(F.collect_list(cell), ",").alias("_cells"))
    for r in rows.collect():
        cells = np.array([x.split(":") for x in r["_cells"].split(",")], np.int64)
        yield tuple(r[c] for c in by), cells[:, 0], cells[:, 1]


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
               max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """The model: ``log(p_target / p_raw)`` per bucket. One pass over all
    documents, partial counts per task; ``2 * buckets`` sums reach the driver."""
    ids = trusted_ids(labels, max_trusted).select(F.col("doc_id").alias("_tid"))
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    d = d.join(F.broadcast(ids), F.col("_id") == F.col("_tid"), "left")
    grams = ngrams(d.select(F.col("_tid").isNotNull().alias("trusted"), tokens(F.col("_text")).alias("_k")), buckets)
    grams = grams.select("trusted", F.explode(F.array("_b1", "_b2")).alias("bucket")).where("bucket IS NOT NULL")
    counts = np.zeros((2, buckets))
    for (trusted,), at, n in _packed(grams.groupBy("trusted", "bucket").count(), ["trusted"], "bucket"):
        counts[int(trusted), at] += n
    target, raw = counts[1], counts.sum(axis=0)  # the raw corpus holds the trusted texts too
    if not target.sum():
        return np.zeros(buckets)
    return (np.log((target + 1.0) / (target.sum() + buckets))
            - np.log((raw + 1.0) / (raw.sum() + buckets)))


def toxic_buckets(x: Column) -> list[Column]:
    """The two buckets of a token's hash in the toxic model."""
    low = F.lit(TOXIC_BUCKETS - 1)
    return [x.bitwiseAND(low).cast("int"), F.shiftrightunsigned(x, 32).bitwiseAND(low).cast("int")]


def toxic_ratios(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """``log(p_toxic / p_trusted)`` per bucket of either hash, over documents
    that hold a token. Reads the labelled samples only; at most
    4 x ``TOXIC_BUCKETS`` counts reach the driver."""
    bad = labels.where("toxic = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    bad = bad.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    ids = trusted_ids(labels, max_trusted).select("doc_id", F.lit(0).alias("cls")).unionByName(
        bad.select("doc_id", F.lit(1).alias("cls"))).groupBy("doc_id").agg(F.max("cls").alias("_cls"))
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(
        F.broadcast(ids.withColumnRenamed("doc_id", "_lid")), F.col("_id") == F.col("_lid"))
    x = d.select("_cls", F.explode(F.array_distinct(tokens(F.col("_text")))).alias("_t")).select("_cls", F.xxhash64("_t").alias("_x"))
    cells = x.select("_cls", F.posexplode(F.array(*toxic_buckets(F.col("_x")))).alias("_hash", "_bucket"))
    counts = np.zeros((2, 2, TOXIC_BUCKETS))
    for (cls, k), at, n in _packed(cells.groupBy("_cls", "_hash", "_bucket").count(), ["_cls", "_hash"], "_bucket"):
        counts[cls, k, at] = n
    total = counts.sum(axis=2, keepdims=True)
    if not total.all():
        return np.zeros((2, TOXIC_BUCKETS))
    log = np.log((counts + 1.0) / (total + TOXIC_BUCKETS))
    return log[1] - log[0]


def scores(docs: DataFrame, model: np.ndarray, toxic: np.ndarray) -> DataFrame:
    """Per row key (``_key``) of a text with tokens: the mean log ratio of its
    n-grams and the highest toxic log ratio of its tokens."""
    # the text of the model becomes one array literal when the plan is built
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    d = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), tokens(F.col("text")).alias("_k"))
    part = F.get(ratios, F.col("_b1")) + F.coalesce(F.get(ratios, F.col("_b2")), F.lit(0.0))
    grams = F.sum(F.lit(1) + F.col("_b2").isNotNull().cast("int"))
    d = ngrams(d, len(model)).select("_key", "_b2", part.alias("_part"),
                                     *[t.alias(f"_t{k}") for k, t in enumerate(toxic_buckets(F.col("_x")))])
    high = []
    for k, row in enumerate(toxic):
        # few buckets reach the floor: small tables, joined by broadcast
        at = np.flatnonzero(row >= FLOOR)
        table = docs.sparkSession.createDataFrame([(int(i), float(row[i])) for i in at], f"_i{k} int, _r{k} double")
        d = d.join(F.broadcast(table), F.col(f"_t{k}") == F.col(f"_i{k}"), "left")
        high.append(F.coalesce(f"_r{k}", F.lit(0.0)))
    return d.groupBy("_key").agg((F.sum("_part") / grams).alias("score"), F.max(F.least(*high)).alias("toxic_peak"))


def windows(w: Column) -> Column:
    """Hashes of the 3-word windows of an array."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                       lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def near_repeats(h: Column) -> Column:
    """The hashes of an array sorted by their low 36 bits, each with its
    position in the low 28 bits; null where all are distinct."""
    packed = F.transform(h, lambda x, i: F.shiftleft(x, 28).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(packed))


def repeats(s: Column, h: Column) -> Column:
    """Those among the sorted neighbours that share their 36 bits, as sorted
    pairs of (whole hash, position)."""
    def equal(x, y):
        return F.shiftrightunsigned(x.bitwiseXOR(y), 28) == 0

    shared = F.filter(s, lambda x, i: equal(x, F.get(s, i + 1)) | ((i > 0) & equal(x, F.get(s, i - 1))))
    at = F.transform(shared, lambda x: x.bitwiseAND(F.lit((1 << 28) - 1)).cast("int"))
    return F.array_sort(F.transform(at, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("i"))))


def repeat_cover(grams: Column) -> Column:
    """Words covered by windows found twice or more, from the sorted pairs.

    Equal neighbours are repeats; their sorted positions cover
    ``min(3, distance to the next)`` words each.
    """
    dup = F.transform(grams, lambda x, k: F.when(
        ((k > 0) & (F.get(grams, k - 1)["h"] == x["h"])) | (F.get(grams, k + 1)["h"] == x["h"]), x["i"]))
    at = F.sort_array(F.filter(dup, lambda x: x.isNotNull()))
    steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.when(grams.isNotNull(), F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)).otherwise(F.lit(0))


def base_rules(docs: DataFrame) -> DataFrame:
    """Per row: _key, doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), "doc_id", F.col("text").alias("_text"))
    d = d.select("_key", "doc_id", "_text", words(F.col("_text")).alias("_w"))
    d = d.select("_key", "doc_id", F.size("_w").cast("long").alias("n_words"),
                 F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                 F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 lines.alias("_lines"), windows(F.col("_w")).alias("_h"))
    d = d.withColumn("_s", near_repeats(F.col("_h")))
    d = d.withColumn("_grams", repeats(F.col("_s"), F.col("_h")))
    return d.select("_key", "doc_id", "n_words", "word_chars", "n_symbols",
                    (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                    repeat_cover(F.col("_grams")).cast("long").alias("n_repeat_words"))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD,
            max_trusted: int = MAX_TRUSTED, peak: float = PEAK) -> DataFrame:
    """One row per row of ``docs``: _key, doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, score, toxic_peak, base_failed,
    kept."""
    models = log_ratios(docs, labels, buckets, max_trusted), toxic_ratios(docs, labels, max_trusted)
    s = scores(docs, *models).withColumnRenamed("_key", "_k")
    # written first: a later filter on the counts would otherwise be pushed into
    # the projections and repeat them inside their own array functions
    d = saved(base_rules(docs), "quality-rows")
    d = d.join(s, F.col("_key") == F.col("_k"), "left").drop("_k")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    d = d.withColumn("base_failed", failed)
    passes = (F.col("score") >= F.lit(threshold)) & (F.col("toxic_peak") < F.lit(peak))
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(passes, F.lit(False)))


def keep(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that pass."""
    good = quality(docs, labels, **kw).where("kept").select(F.col("_key").alias("_good")).distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                    row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    return d.join(good, F.col("_key") == F.col("_good"), "left_semi").select("_row.*")
