"""Small inputs for the operators of retentio.llm."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, **cols):
    """(doc_id, text) rows, or texts numbered from 0, as a documents table."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    full = [(i, t, cols.get("lang", "en"), cols.get("source", f"s{k % 3}"), None if t is None else len(t))
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows."""
    rng = random.Random(5)
    vocab = [f"w{k}x" for k in range(400)]
    long = " ".join(rng.choice(vocab) for _ in range(60_000))
    plain = " ".join(rng.choice(vocab) for _ in range(120))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, plain), (6, plain), (5, plain), (None, plain), (None, None),
            (7, "one"), (8, "one two"), (9, "x" * 5000), (10, "a@" * 3000), (11, "1" * 4000 + "." * 50), (12, "é \U0001F600 ß"),
            (4, "another text under an id that is taken"), (13, "!!! ???")]


def odd_docs(spark):
    """The odd rows, with extra columns whose names operators use inside."""
    d = docs_frame(spark, odd_rows())
    for name in ("_key", "key", "doc", "_row", "n", "cls", "kept", "score", "copy", "size", "spans", "id", "_text", "_k", "group"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(rng, n, vocab=800):
    return " ".join(f"v{rng.randrange(vocab)}" for _ in range(n))
