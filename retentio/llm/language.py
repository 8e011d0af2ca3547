"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Learning counts the n-grams (1 to ``max(ORDERS)`` code points, lower case,
hashed into ``features`` buckets) of every labelled text per language, in
numpy inside each task; summed counts become a languages x features matrix of
log probabilities. It is broadcast in blocks of languages of at most
``max_matrix_bytes``: all known languages fit one block; with more, a pass per
block carries the best language and the sum of the posteriors along with each
row. The number of features never depends on that of the languages. Prediction
counts the n-grams of a batch sparsely (text, bucket) and multiplies the counts
into the matrix. Batches are cut into pieces of ``PIECE`` code points, so that
memory does not grow with the length of a text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any learned language everything is ``und``; equal log probabilities
go to the language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import saved

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
PIECE = 1 << 19
MAX_MATRIX_BYTES = 64 << 20
SMOOTH = 0.5


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(texts: list[str], features: int):
    """Yields (text numbers, buckets, counts): sparse n-gram counts, one entry
    per text and bucket and piece."""
    steps = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
    shift = np.uint64(64 - (features.bit_length() - 1))

    def count(part: list[tuple[int, str, int]]):
        codes = np.frombuffer("".join(t for _, t, _ in part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lens = np.array([len(t) for _, t, _ in part])
        owner = np.repeat(np.arange(len(part), dtype=np.int64), lens)
        # the code points that a piece repeats end no n-gram of it
        fresh = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens) >= np.array([r for _, _, r in part])[owner]
        h = np.zeros(len(codes), np.uint64)
        total = np.zeros(len(part) * features, np.int32)
        for k in range(max(ORDERS)):
            m = len(codes) - k
            if m <= 0:
                break
            h = (h[:m] ^ codes[k:]) * steps[k]
            h ^= h >> np.uint64(29)
            if k + 1 in ORDERS:
                inside = (owner[:m] == owner[k:]) & fresh[k:]
                bucket = ((h * steps[0]) >> shift).astype(np.int64) + owner[:m] * features
                total += np.bincount(bucket[inside], minlength=len(total)).astype(np.int32)
        at = np.flatnonzero(total)
        numbers = np.array([i for i, _, _ in part])
        return numbers[at // features], at % features, total[at]

    part, size = [], 0
    overlap = max(ORDERS) - 1
    for i, t in enumerate(texts):
        for a in range(0, max(len(t), 1), PIECE):
            # a piece begins with the last code points of the one before
            again = min(a, overlap)
            piece = t[a - again:a + PIECE]
            if part and (size + len(piece) > PIECE or len(part) >= 512):
                yield count(part)
                part, size = [], 0
            part.append((i, piece, again))
            size += len(piece)
    if part:
        yield count(part)


def fit(docs: DataFrame, features: int = FEATURES):
    """(languages, log prior, log probabilities) from (text, lang) rows; rows
    without text or language are not used."""
    d = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    n_docs = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    langs = sorted(n_docs)
    if not langs:
        return [], np.zeros(0), np.zeros((0, features))
    place = {x: i for i, x in enumerate(langs)}

    def run(batches):
        seen = np.zeros(len(langs) * features, np.int64)
        for rb in batches:
            row = np.array([place[x] for x in rb.column("lang").to_pylist()], np.int64)
            for who, bucket, n in gram_counts([t.lower() for t in rb.column("text").to_pylist()], features):
                seen += np.bincount(row[who] * features + bucket, weights=n, minlength=len(seen)).astype(np.int64)
        at = np.flatnonzero(seen)
        for a in range(0, len(at), 10_000):
            k = at[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], ["cell", "n"])

    counts = np.zeros(len(langs) * features)
    for r in d.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(len(langs), features) + SMOOTH
    prior = np.array([n_docs[x] for x in langs], float)
    return langs, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True))


def _pass(docs: DataFrame, block) -> DataFrame:
    """``docs`` (text, _best, _top, _sum and any other columns) after a block of
    languages: the best language so far, its log probability, and the sum of
    all languages' probabilities relative to it."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    shared = docs.sparkSession.sparkContext.broadcast(block)
    state = ["_best", "_top", "_sum"]
    keep = [f for f in docs.schema.fields if f.name not in state]

    def run(batches):
        langs, prior, table = shared.value
        for rb in batches:
            texts = rb.column("text").to_pylist()
            worth = np.array([t is not None and has_letter(t) for t in texts], bool)
            score = np.tile(prior, (len(texts), 1))
            for who, bucket, n in gram_counts([t.lower() if w else "" for t, w in zip(texts, worth)], table.shape[0]):
                part = table[bucket] * n[:, None]
                for k in range(len(langs)):
                    score[:, k] += np.bincount(who, weights=part[:, k], minlength=len(texts))
            here = score.argmax(axis=1)
            top = score.max(axis=1)
            total = np.exp(score - top[:, None]).sum(axis=1)
            best = [langs[k] for k in here]
            old = rb.column("_top").to_numpy(zero_copy_only=False)
            if not np.isnan(old).all():  # languages come in order: of equals, the earlier one stays
                stays = old >= top
                most = np.maximum(old, top)
                total = total * np.exp(top - most) + rb.column("_sum").to_numpy(zero_copy_only=False) * np.exp(old - most)
                best = [b if s else x for s, b, x in zip(stays, rb.column("_best").to_pylist(), best)]
                top = most
            yield pa.RecordBatch.from_arrays(
                [rb.column(f.name) for f in keep]
                + [pa.array([b if w else "und" for b, w in zip(best, worth)], pa.string()), pa.array(top, pa.float64()),
                   pa.array(total, pa.float64(), mask=~worth)], [f.name for f in keep] + state)

    out = StructType([*keep, StructField("_best", StringType()), StructField("_top", DoubleType()), StructField("_sum", DoubleType())])
    return docs.mapInArrow(run, out)


def predict(docs: DataFrame, model, max_matrix_bytes: int = MAX_MATRIX_BYTES) -> DataFrame:
    """``docs`` (text and any other columns) with lang_pred and score: the
    most probable language and its posterior probability."""
    langs, prior, logp = model
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    d = docs.select(row.alias("_row"), "text", F.lit("und").alias("_best"), F.lit(float("nan")).alias("_top"), F.lit(1.0).alias("_sum"))
    size = max(1, max_matrix_bytes // max(1, 8 * logp.shape[1]))
    for a in range(0, len(langs), size):
        if a:
            d = saved(d, "languages")
        d = _pass(d, (langs[a:a + size], prior[a:a + size], np.ascontiguousarray(logp[a:a + size].T)))
    score = F.coalesce(1 / F.col("_sum"), F.lit(0.0)) if langs else F.lit(0.0)
    return d.select(*(["_row.*"] if kept else []), F.col("_best").alias("lang_pred"), score.alias("score"))
