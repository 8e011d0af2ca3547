"""Token counts from flat token files by a separator scan.

A token file is a plain sequence of 16-bit little-endian token ids: documents
end with the end-of-document id, and nothing says where. Files are cut into
blocks; numpy finds the separators of a block in one comparison. A document
may begin in one block and end in a later one: the first separator of each
block goes through a suffix minimum over the blocks of a file (narrow rows),
and every document takes its end from its own block or from that scan.

Writing: texts are encoded in tasks (the tokenizer's file travels as bytes)
and written by Spark's text writer as raw bytes with the separator as line
end, so any file system of the cluster will do. Each document starts with its
id in ``HEADER`` tokens; files without such headers are read with header 0.

Defined cases: null and empty texts have 0 tokens; a null id comes back as
null; an empty table gives no files and no rows; repeated rows count each.
Files of up to ``WHOLE_BYTES`` are read whole by one task each. Longer ones are
read in ranges by Spark's text reader with the separator as line end; a line
end at an odd byte is no separator but the halves of two tokens, which the
lines' offsets (a prefix sum over the ranges of a file) tell. Both ways count
alike. A separator of two equal bytes cannot be told apart that way: its files
are read whole, up to 2 GB. Tokens after a file's last separator belong to no
document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import saved
from retentio.session import scratch_path

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the tokenizer: its end-of-text id (never the id of a text's
# piece) and the lowest id that may stand in a header.
EOD = 2
LOWEST = 3
#: Tokens of a document's header, each holding 13 bits of the id.
HEADER = 5
DIGIT = 13
NULL_DIGIT = 0xFFFF
BLOCK_TOKENS = 1 << 19
ROW_BYTES = 4 << 20
#: Files above this size are read in ranges.
WHOLE_BYTES = 64 << 20


def header_of(doc_id: int | None) -> list[int]:
    if doc_id is None:
        return [NULL_DIGIT] * HEADER
    raw = doc_id & 0xFFFFFFFFFFFFFFFF
    return [LOWEST + (raw >> DIGIT * k & (1 << DIGIT) - 1) for k in range(HEADER)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Encode (doc_id, text) rows into flat token files under ``path``."""
    with open(tokenizer, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        end = np.array([EOD], "<u2").tobytes()
        for rb in batches:
            ids, texts = rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()
            row, size = [], 0
            for a in range(0, len(texts), 64):
                coded = encoder.encode([t or "" for t in texts[a:a + 64]], num_threads=1)
                for doc_id, tokens in zip(ids[a:a + 64], coded):
                    row.append(np.array(header_of(doc_id) + tokens, "<u2").tobytes())
                    size += len(row[-1])
                if size >= ROW_BYTES:  # the writer ends each row with the separator
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(row)], pa.binary())], ["flat"])
                    row, size = [], 0
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([end.join(row)], pa.binary())], ["flat"])

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "flat binary")
    separator = np.array([EOD], "<u2").tobytes().decode("utf-8")
    flat.select(F.col("flat").cast("string")).write.option("lineSep", separator).option("compression", "none").text(path)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, header: int = 0,
           whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, block, bytes, size): the blocks of the files under ``path`` that
    are read whole, each with the ``header`` tokens after it."""
    files = token_files(spark, path).where(F.col("length").between(1, whole_bytes))
    step = 2 * block_tokens
    b = files.select("path", "content", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.lit(step)))).alias("block"))
    return b.select("path", "block", F.substring("content", (F.col("block") * step + 1).cast("int"), F.lit(step + 2 * header)
                                                 ).alias("bytes"),
                    F.least(F.lit(step), F.length("content") - F.col("block") * step).cast("int").alias("size"))


def id_of(tokens: np.ndarray, header: int) -> int | None:
    """The id that a document's header tokens hold."""
    digits = tokens.astype(np.int64).tolist()
    if not header or len(digits) < header or digits[0] == NULL_DIGIT:
        return None
    raw = sum((d - LOWEST) << DIGIT * k for k, d in enumerate(digits)) & 0xFFFFFFFFFFFFFFFF
    return raw - (1 << 64) if raw >> 63 else raw


def separators(b: DataFrame, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, header: int = 0) -> DataFrame:
    """(path, block, marks): the separators of each block, as token positions
    in the file with the id of the document that begins after; the file's
    start is a separator at -1."""
    def run(batches):
        for rb in batches:
            marks = []
            for block, raw, size in zip(*(rb.column(c).to_pylist() for c in ("block", "bytes", "size"))):
                t = np.frombuffer(raw, "<u2")
                at = np.flatnonzero(t[:size // 2] == eod)
                if block == 0:
                    at = np.concatenate([[-1], at])
                marks.append([{"at": int(x) + block * block_tokens, "id": id_at(t, x + 1)} for x in at])
            yield pa.RecordBatch.from_arrays(
                [rb.column("path"), rb.column("block"), pa.array(marks, pa.list_(pa.struct(
                    [("at", pa.int64()), ("id", pa.int64())])))], ["path", "block", "marks"])

    def id_at(t, x):
        return id_of(t[x:x + header], header)

    return b.mapInArrow(run, "path string, block long, marks array<struct<at:long,id:long>>")


def token_counts(spark: SparkSession, path: str, eod: int = EOD, header: int = 0,
                 block_tokens: int = BLOCK_TOKENS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One row per document of the files: path, start (token position),
    doc_id (with a header), n_tokens."""
    if eod >> 8 == eod & 255:
        whole_bytes = (1 << 31) - 1
    counts = _block_counts(spark, path, eod, header, block_tokens, whole_bytes)
    long = [r["path"] for r in token_files(spark, path).where(F.col("length") > whole_bytes).select("path").collect()]
    return counts.unionByName(range_counts(spark, long, eod, header)) if long else counts


def range_counts(spark: SparkSession, paths: list[str], eod: int = EOD, header: int = 0) -> DataFrame:
    """The documents of files of any size, read in ranges: see the module."""
    mark = np.array([eod], "<u2").tobytes()
    kind = "path string, block long, size long, rel long, len long, head binary"
    lines = spark.read.option("lineSep", mark.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("raw"))

    def place(batches):
        """Offsets of the lines in their range, in the order of reading."""
        at, rel = None, 0
        for rb in batches:
            n = pc.binary_length(rb.column("raw")).to_numpy(zero_copy_only=False).astype(np.int64)
            own = list(zip(rb.column("path").to_pylist(), rb.column("block").to_pylist()))
            rels = np.zeros(len(n), np.int64)
            for i, key in enumerate(own):
                at, rel = (at, rel) if key == at else (key, 0)
                rels[i] = rel
                rel += int(n[i]) + len(mark)
            head = pc.binary_slice(rb.column("raw"), 0, max(2 * header, 1))
            yield pa.RecordBatch.from_arrays([rb.column("path"), rb.column("block"), rb.column("size"), pa.array(rels),
                                              pa.array(n), head], ["path", "block", "size", "rel", "len", "head"])

    lines = saved(lines.mapInArrow(place, kind), "token-lines")
    ranges = lines.groupBy("path", "block").agg(F.sum(F.col("len") + 2).alias("total"), F.max("size").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = saved(ranges.withColumn("first", F.coalesce(F.sum("total").over(before), F.lit(0))), "token-ranges")
    # the lines of a file and their ends are its bytes; a last line may lack its end
    wrong = ranges.groupBy("path").agg(F.sum("total").alias("t"), F.max("size").alias("size")).where(
        ~(F.col("t") - F.col("size")).isin(0, 2)).first()
    if wrong:
        raise ValueError(f"the lines of {wrong['path']} hold {wrong['t']} bytes, the file {wrong['size']}")
    d = lines.join(ranges.select(F.col("path").alias("rp"), F.col("block").alias("rb"), "first"),
                   (F.col("path") == F.col("rp")) & (F.col("block") == F.col("rb")))
    d = d.withColumn("begin", F.col("first") + F.col("rel")).withColumn("end", F.col("begin") + F.col("len"))
    real = (F.col("end") % 2 == 0) & (F.col("end") + 2 <= F.col("size"))
    d = d.select("path", "block", "begin", "head", F.when(real, F.col("end")).alias("end"))
    # a line's document begins after the last separator before it: in its range, or in one before
    inside = Window.partitionBy("path", "block").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    last = d.groupBy("path", "block").agg(F.max("end").alias("e"))
    last = last.select(F.col("path").alias("lp"), F.col("block").alias("lb"), F.max("e").over(
        Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    d = d.withColumn("own", F.max("end").over(inside)).join(
        last, (F.col("path") == F.col("lp")) & (F.col("block") == F.col("lb")))
    start = F.coalesce(F.col("own"), F.col("earlier"), F.lit(-2)) + 2
    d = d.select("path", "begin", "head", "end", start.alias("start"))
    first = F.col("begin") - F.col("start") < max(2 * header, 1)
    d = d.where(F.col("end").isNotNull() | first).groupBy("path", "start").agg(
        F.max("end").alias("end"), F.array_sort(F.collect_list(F.when(first, F.struct("begin", "head")))).alias("heads"))

    def ids(batches):
        for rb in batches:
            out = []
            for heads, a, b in zip(*(rb.column(c).to_pylist() for c in ("heads", "start", "end"))):
                # lines inside a header end with the halves of two of its tokens
                raw = (mark.join(h["head"] for h in heads) + mark)[:min(2 * header, b - a)]
                out.append(id_of(np.frombuffer(raw, "<u2"), header))
            yield pa.RecordBatch.from_arrays([rb.column("path"), rb.column("start"), pa.array(out, pa.int64()), rb.column("end")],
                                             ["path", "start", "doc_id", "end"])

    d = d.where(F.col("end").isNotNull()).select("path", "start", "heads", "end").mapInArrow(
        ids, "path string, start long, doc_id long, end long")
    return d.select("path", (F.col("start") / 2).cast("long").alias("start"), "doc_id",
                    ((F.col("end") - F.col("start")) / 2 - header).cast("long").alias("n_tokens"))


def _block_counts(spark: SparkSession, path: str, eod: int, header: int, block_tokens: int, whole_bytes: int) -> DataFrame:
    s = separators(blocks(spark, path, block_tokens, header, whole_bytes), eod, block_tokens, header)
    first = s.select("path", "block", F.get(F.filter("marks", lambda m: m["at"] >= 0), F.lit(0))["at"].alias("first"))
    later = Window.partitionBy("path").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    ends = first.select(F.col("path").alias("p"), F.col("block").alias("b"), F.min("first").over(later).alias("next"))
    d = s.join(ends, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    d = d.select("path", "next", "marks", F.posexplode("marks").alias("k", "m"))
    end = F.coalesce(F.get("marks", F.col("k") + 1)["at"], F.col("next"))
    return d.where(end.isNotNull()).select(
        "path", (F.col("m.at") + 1).alias("start"), F.col("m.id").alias("doc_id"),
        (end - F.col("m.at") - 1 - header).alias("n_tokens"))


def document_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every document, by way of token files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    return token_counts(spark, path, header=HEADER).select("doc_id", "n_tokens")
