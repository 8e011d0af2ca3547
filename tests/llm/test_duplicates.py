"""Jaccard join, components, repeated bytes, repeated words."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import debruijn, jaccard, substrings
from retentio.llm.components import components
from tests.llm.fixtures import docs_frame, empty_docs, odd_docs, odd_rows, prose


def find_groups(nodes, links):
    best = {n: n for n in nodes}

    def root(x):
        while best[x] != x:
            x = best[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        best[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, shape):
    rng = random.Random(8)
    n = 150
    links = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(110)],
             "path": [(i, i + 1) for i in range(n - 1) if i % 50 != 49],
             "star": [(140, i) for i in range(n) if i != 140]}[shape]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = find_groups(range(n), links)
    inside = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in inside}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(texts, size, pct):
    sets = [shingles(t, size) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j])]
    return sets, find_groups(range(len(sets)), links)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size,pct", [(3, 90), (5, 80)])
def test_jaccard_components_match_brute_force(spark, size, pct):
    rng = random.Random(9)
    bases = [prose(rng, n) for n in (60, 61, 90, 150)]
    shared = prose(rng, 30)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(20)]
    for b in bases:  # many near copies around each, with zero to eight edits
        texts += [edited(rng, b, rng.randint(0, 8)) for _ in range(45)]
    texts += [prose(rng, 25) + " " + shared for _ in range(20)] + ["a", "A", "a b", "a B", "", " ", None]
    rng.shuffle(texts)
    sets, want = brute_components(texts, size, pct)
    rows = jaccard.jaccard_components(docs_frame(spark, texts), size, pct, bits=10).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {
        i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert len(set(want.values())) < len(texts) - 30


def test_long_sets_without_much_in_common_do_not_become_candidates(spark):
    rng = random.Random(19)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) for n in (40, 500, 520, 3000, 3000, 3050, 9000, 9000)]
    texts += [" ".join(t.split()[: -len(t.split()) // 20]) for t in texts]  # 95 %: 520 and 494 words on either side of 512
    d = docs_frame(spark, texts).withColumn("key", F.col("doc_id").cast("long"))
    rows = jaccard.describe_sets(d, 3, 10).where("cls IS NOT NULL").drop("block", "seen").cache()
    pairs = rows.select("key", "n", F.col("cls").alias("a")).crossJoin(
        rows.select(F.col("key").alias("k"), F.col("n").alias("m"), F.col("cls").alias("b")))
    pairs = pairs.where("key < k AND 100 * least(n, m) >= 90 * greatest(n, m)").select("a", "b")
    ids = {bytes(r["cls"]): r["key"] for r in rows.collect()}
    got = {tuple(sorted((ids[bytes(r["a"])], ids[bytes(r["b"])]))) for r in jaccard.may_reach(pairs, rows, 90).collect()}
    half = len(texts) // 2
    assert got == {(i, i + half) for i in range(half)}


@pytest.mark.parametrize("sizes", [(30, 30), (500, 530), (530, 500), (1020, 1030), (5, 4000)])
def test_marks_differ_in_no_more_bits_than_sets_in_shingles(spark, sizes):
    rng = np.random.default_rng(20)
    shared = rng.integers(0, 1 << 63, min(sizes), np.uint64)
    rows, want = [], []
    for kept in (0, min(sizes) // 2, min(sizes)):
        x, y = (np.unique(np.concatenate([shared[:kept], rng.integers(0, 1 << 63, n - kept, np.uint64)])) for n in sizes)
        rows.append((jaccard.odd_marks(x).tolist(), jaccard.odd_marks(y).tolist()))
        want.append(len(np.setxor1d(x, y)))
    d = spark.createDataFrame(rows, "x array<long>, y array<long>").coalesce(1)
    got = [r["n"] for r in d.select(jaccard.differing(F.col("x"), F.col("y")).alias("n")).collect()]
    assert all(g <= w for g, w in zip(got, want)) and got[2] >= want[2] // 4 * (max(sizes) < 4000)


def test_deduplicate_keeps_one_of_each_group(spark):
    rng = random.Random(10)
    base = prose(rng, 120)
    texts = [(5, base), (3, edited(rng, base, 1)), (9, base), (9, base), (1, prose(rng, 50)), (2, ""), (4, None), (4, None)]
    rows = jaccard.deduplicate(docs_frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 4]


def brute_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        cover = np.cumsum(gone[:-1]) > 0
        rest = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()),
                    hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("width", [400, 171])
def test_repeated_bytes_match_brute_force(spark, width):
    rng = random.Random(11)
    passages = [prose(rng, 90), prose(rng, 140), "ab" * 300, "x" * 900, "é" * 350]
    texts = []
    for _ in range(70):
        p = rng.choice(passages)
        a, b = sorted(rng.sample(range(len(p)), 2))
        texts.append(prose(rng, rng.randint(0, 30)) + p[a:b] + prose(rng, rng.randint(0, 30)) + rng.choice(["", rng.choice(passages)]))
    texts += [None, "", "x" * (width - 1), "x" * width]
    rows = substrings.strip(docs_frame(spark, texts), width).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == dict(enumerate(brute_bytes(texts, width)))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)


def test_keys_of_many_different_parts_are_not_sorted_together(spark, monkeypatch):
    rng = random.Random(21)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (350, 520, 900)]
    rims = ["".join(rng.choice("uvwxyz") for _ in range(60)) for _ in range(6)]
    texts = [prose(rng, 20) + rng.choice(rims + [""]) + rng.choice(passages) + rng.choice(rims + [""]) + prose(rng, 20)
             for _ in range(90)]
    texts += texts[:3]
    most, sort = [], substrings.sorted_blocks

    def spy(open_, width):
        most.append(open_.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
        return sort(open_, width)

    monkeypatch.setattr(substrings, "sorted_blocks", spy)
    rows = substrings.strip(docs_frame(spark, texts), 400, max_kinds=6).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == dict(enumerate(brute_bytes(texts, 400)))
    assert len(most) == 2 and max(most) <= 6


def test_difference_cover_and_suffix_order():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))
    rng = random.Random(12)
    for width in (114, 150, 171, 400):
        base = [bytes(rng.choice(b"ab") for _ in range(width + 60)) for _ in range(3)]
        texts = []
        for _ in range(8):
            x = bytearray(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = rng.choice(b"abc")
            texts.append(bytes(x[rng.randint(0, 20):]))
        block = np.frombuffer(b"".join(texts), np.uint8)
        lens = np.array([len(t) for t in texts])
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(block))
        starts = np.flatnonzero(left >= width)
        flat = block.tobytes()
        order = {s: k for k, s in enumerate(sorted({flat[i:i + width] for i in starts}))}
        assert list(substrings.sort_bucket(block, left, starts, width)) == [order[flat[i:i + width]] for i in starts]


def brute_words(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key, rank = tuple(w[k:k + width]), debruijn.NO_ID if i is None else i
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < (debruijn.NO_ID if i is None else i):
                gone |= set(range(k, k + width))
        rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_repeated_words_match_brute_force(spark):
    rng = random.Random(13)
    passages = [prose(rng, 70), prose(rng, 200), " ".join(["la"] * 130), prose(rng, 55)]
    rows = []
    for i in range(90):
        p = rng.choice(passages).split()
        a = rng.randint(0, len(p) // 2)
        b = rng.randint(a, len(p))
        rows.append((rng.choice([i, i, 7, None]), " ".join([prose(rng, rng.randint(1, 30)), *p[a:b], prose(rng, rng.randint(1, 30)),
                                                          *rng.choice([[], passages[rng.randrange(4)].split()])])))
    rows += [(200, None), (201, ""), (202, " \n "), (203, passages[3])]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.strip(docs_frame(spark, rows)).collect()), key=str)
    assert got == brute_words(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_odd_rows(spark):
    d, n = odd_docs(spark), len(odd_rows())
    rows = jaccard.jaccard_components(d).collect()
    assert len(rows) == n and all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert jaccard.deduplicate(d).columns == d.columns
    assert substrings.strip(d).count() == n
    assert debruijn.strip(d).count() == n


def test_empty_tables(spark):
    d = empty_docs(spark)
    assert jaccard.jaccard_components(d).count() == 0
    assert jaccard.deduplicate(d).count() == 0
    assert substrings.strip(d).count() == 0
    assert debruijn.strip(d).count() == 0
