"""Filter audit, collocations and secret scan against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retentio.llm import audit, collocations, secret_scan
from tests.conftest import SF0001
from tests.llm.fixtures import docs_frame, empty_docs, labels, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ------------------------------------------------------------------------

def steps_by_counting(part, counts, names="ABCDE"):
    """All rows of a part, each counted over the masks."""
    bit = {x: 1 << k for k, x in enumerate(names)}
    rows, shapley = [], Counter()
    for order in permutations(names):
        before = 0
        for k, x in enumerate(order):
            own = bit[x]
            lost = [c for m, c in counts.items() if m & own and not m & before]
            rows.append([part, "".join(order), k + 1,
                         sum(c[0] for m, c in counts.items() if not m & (before | own)), sum(c[0] for c in lost),
                         sum(c[0] for m, c in counts.items() if m & own and m & before),
                         sum(c[0] for m, c in counts.items() if m == own), sum(c[1] for c in lost), sum(c[2] for c in lost), x])
            shapley[x] += sum(c[0] for c in lost)
            before |= own
    return sorted(tuple(r[:9]) + (shapley[r[9]],) for r in rows)


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_adjacent_swaps_visit_every_order_once(m):
    order, seen = list(range(m)), {tuple(range(m))}
    for i in audit.adjacent_swaps(m):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(m)


def test_diagram_steps_equal_counting_over_masks():
    rng = random.Random(3)
    for share in (0.1, 0.5, 1.0):
        counts = {m: (rng.randrange(9), rng.randrange(3), rng.randrange(3)) for m in range(32) if rng.random() < share}
        assert sorted(audit.audit_rows("x", counts)) == steps_by_counting("x", counts)
    three = {m: (m + 1, 1, 0) for m in range(8)}
    assert sorted(audit.audit_rows("", three, "ABC")) == steps_by_counting("", three, "ABC")


def test_swaps_keep_the_diagram_reduced():
    d = audit.Diagram({m: (1, 0, 0) for m in range(32)})
    for i in audit.adjacent_swaps(5):
        d.swap(i)
        assert all(len(level) == 1 for level in d.levels)  # all sub-diagrams are equal
        assert d.weights[0][0] == (32, 0, 0)


def masks_by_hand(rows, marks):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = Counter()
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        m = ((len(w) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
             + 8 * bool(re.search(r"[#$%&*|]", t)) + 16 * (i is not None and i > least[t]))
        good = any(a == i is not None and q == 1 for a, q, _ in marks)
        toxic = any(a == i is not None and x == 1 for a, _, x in marks)
        out[(lang or "", m)] += np.array([1, good, toxic])
    return {k: tuple(int(x) for x in v) for k, v in out.items()}


def test_failure_masks_match_brute_force_on_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in odd_rows()]
    base = " ".join(f"w{k}" for k in range(120))
    rows += [(i, base if i % 3 else base + " #A", rng.choice(["en", None])) for i in range(30, 60)]
    rows += [(None, base, "en"), (29, "A B C" * 50, "en"), (20, base + "X" * 90, "fr")]
    marks = [(5, 1, None), (5, 0, 1), (31, 1, 0), (33, 0, 1), (None, 1, 1), (40, None, None), (41, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("clash"))
    got = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"])
           for r in audit.failure_masks(docs, labels(spark, marks)).collect()}
    assert got == masks_by_hand(rows, marks)
    out = audit.filter_audit(docs, labels(spark, marks)).collect()
    assert len(out) == 600 * len({p for p, _ in got})
    for part in {p for p, _ in got}:
        counts = {m: c for (p, m), c in got.items() if p == part}
        assert sorted(tuple(r) for r in out if r["part"] == part) == steps_by_counting(part, counts)


def test_audit_of_empty_tables(spark):
    assert audit.filter_audit(empty_docs(spark), labels(spark, [])).count() == 0
    assert audit.filter_audit(odd_docs(spark), labels(spark, [])).count() == 600


# --- collocations ------------------------------------------------------------------------

def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def phrases_by_hand(rows, least):
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f.update((lang or "und", " ".join(w[i:i + size]), size) for i in range(len(w) - size + 1))
    n = Counter()
    for (lang, _, size), c in f.items():
        n[lang] += c * (size == 1)
    return {k: c for k, c in f.items() if c >= least}, n


def collocations_by_hand(rows, least, top):
    f, n = phrases_by_hand(rows, least)
    c = []
    for (lang, p, size), a in f.items():
        if size < 2:
            continue
        w = p.split(" ")
        longer = [x for (g, q, s), x in f.items() if g == lang and s == 3 and size == 2 and p in (" ".join(q.split(" ")[:2]), " ".join(q.split(" ")[1:]))]
        if any(100 * x >= 50 * a for x in longer):
            continue
        cuts = []
        for k in range(1, size):
            left, right = f[(lang, " ".join(w[:k]), k)], f[(lang, " ".join(w[k:]), size - k)]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        c.append((lang, -s, -a, p.encode(), p, a, left, right, s))
    out = []
    for lang in {x[0] for x in c}:
        for rank, x in enumerate(sorted(y for y in c if y[0] == lang)[:top], 1):
            out.append((lang, rank, x[4], x[5], x[6], x[7], n[lang], x[8]))
    return sorted(out)


def phrase_rows(seed, n=160):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "é", "EAU", "ß", "x", "un\U0001F600"] + [f"w{k}" for k in range(12)]
    gaps = [" ", " ", " ", "  ", "\t", " \t ", ", ", ".", "\n", "!", "\r\n", " : "]
    rows = [("".join(rng.choice(vocab) + rng.choice(gaps) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None]))
            for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \t\n", "de"), ("single", "en"), (rows[0][0], rows[0][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("kw", [{}, {"sample": 1, "proposed_at": 1}, {"sample": 10 ** 9}, {"sample": 2, "bits": 1 << 15},
                                {"sample": 3, "proposed_at": 4}])
def test_phrase_counts_are_exact_whatever_the_sample_proposes(spark, kw):
    rows = phrase_rows(1)
    want, n = phrases_by_hand(rows, 10)
    got = collocations.frequent_phrases(frame(spark, rows), **kw).collect()
    assert len(got) == len(want) + len(n)  # every phrase is counted in one pass
    assert {(r["lang"], r["phrase"], r["size"]): r["f"] for r in got if r["size"]} == want
    assert {r["lang"]: r["f"] for r in got if not r["size"]} == n


@pytest.mark.parametrize("seed,top", [(1, 2000), (2, 7), (3, 2000)])
def test_collocations_match_brute_force(spark, seed, top):
    rows = phrase_rows(seed)
    got = collocations.collocations(frame(spark, rows), top=top).collect()
    assert sorted(tuple(r) for r in got) == collocations_by_hand(rows, 10, top)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 9
    f = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big)],
                              "lang string, phrase string, size int, f long")
    r = collocations.scored(f).first()
    assert r["score"] == 1_000_000 * big * big // ((big + 7) * (big + 1)) == 999_999


def test_ties_of_cuts_go_to_the_first(spark):
    rows = [("a b c", "en")] * 10
    r = [x for x in collocations.collocations(frame(spark, rows)).collect()]
    assert [(x["phrase"], x["score"], x["l"], x["r"]) for x in r] == [("a b c", 1_000_000, 10, 10)]


def test_stretches_of_a_long_text_count_like_the_whole():
    rng = random.Random(5)
    raw = "".join(rng.choice(["a", "bb", "é", "c" * 90]) + rng.choice([" ", "  ", "\t", ". ", "\n"]) for _ in range(900)).encode()

    def total(limit):
        f = Counter()
        for stretch, own in collocations.pieces_of(raw, limit):
            ids, words, joined, own = collocations.encode_words(stretch, own)
            w = [x.decode() for x in words.to_pylist()]
            for i in range(own):
                f[w[ids[i]]] += 1
                if joined[i]:
                    f[w[ids[i]], w[ids[i + 1]]] += 1
                    if joined[i + 1]:
                        f[w[ids[i]], w[ids[i + 1]], w[ids[i + 2]]] += 1
        return f

    whole = total(1 << 20)
    assert whole == total(50) == total(333) == total(64)
    assert sum(c for k, c in whole.items() if isinstance(k, str)) == 900


def test_collocations_of_odd_and_empty_tables(spark):
    rows = odd_rows()
    got = collocations.collocations(odd_docs(spark)).collect()
    assert sorted(tuple(r) for r in got) == collocations_by_hand([(t, "en") for _, t in rows], 10, 2000)
    assert collocations.collocations(empty_docs(spark)).count() == 0


# --- secrets -----------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_by_hand(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def spans_by_hand(t):
    base = base_by_hand(t)
    found = []
    allowed = [re.compile(p.decode(), re.S) for p in secret_scan.ALLOWED]
    for k, (_, chars, width, least) in enumerate(secret_scan.CLASSES):
        taken = base + found
        new = []
        for m in re.finditer("[" + re.escape(chars.decode()) + "]+", t):
            run, cover = m[0], set()
            for i in range(len(run) - width + 1):
                w = run[i:i + width]
                if entropy(w) >= least - 1e-9 and re.search("[0-9]", w) and re.search("[A-Za-z]", w):
                    cover |= set(range(i, i + width))
            step = [ord(b) - ord(a) for a, b in zip(run, run[1:])]
            seq = step and max(step.count(1), step.count(-1)) >= 0.8 * len(step)
            if any(p.fullmatch(run) for p in allowed) or seq:
                continue
            for i in sorted(cover):
                if i - 1 not in cover:
                    j = i
                    while j in cover:
                        j += 1
                    a, b = m.start() + i, m.start() + j
                    if not any(a < y and x < b for x, _, y in taken):
                        new.append((a, 3 + k, b))
        found += new
    return sorted(base + found)


def secret_texts():
    rng = random.Random(11)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    parts = [lambda: pick(b64, rng.randrange(10, 70)), lambda: pick("0123456789abcdef", rng.randrange(15, 45)),
             lambda: pick("0123456789ABCDEF", rng.randrange(15, 45)), lambda: "AKIA" + pick("ABCXYZ0123456789", rng.randrange(10, 25)),
             lambda: rng.choice(["token", "Api_Key", "APIKEY", "passwd", "SECRET", "password"]) + rng.choice(["", "'", '"']) + rng.choice([" = ", ":", "==", "  "])
             + rng.choice(["", '"', "'"]) + pick(b64, rng.randrange(3, 12)),
             lambda: "éß\U0001F600", lambda: "plain words here", lambda: pick("ab", 60), lambda: "src/main/python/file-2021/of/a/longer/path/name",
             lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "abcdefghijklmnopqrstuvwxyz0123456789", lambda: "EXAMPLE" + pick(b64, 30),
             lambda: pick(b64, 700)]
    texts = ["".join(rng.choice(parts)() + rng.choice([" ", "\n", ".", '"', ""]) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    return texts + ["token", "token = ", "token=abcdef", "tokentoken:123456", "ſecret=1234567", "secret = token = 1234567", "AKIA", "AKIA" + "A" * 16, None, ""]


def test_spans_match_brute_force(spark):
    texts = secret_texts()
    rows = {r["doc_id"]: r for r in secret_scan.secrets(docs_frame(spark, texts)).collect()}
    seen = Counter()
    for i, t in enumerate(texts):
        t = t or ""
        base, every = base_by_hand(t), spans_by_hand(t)
        text = lambda s: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
        r = rows[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3)), t
        assert r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest(), t
        assert r["spans"] == text(every), t
        assert r["n_found"] == len(every) - len(base)
        seen.update(k for _, k, _ in every)
    assert all(seen[k] > 10 for k in range(5))


def test_running_entropy_equals_counting_each_window():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 7, (9, 60))
    lengths = np.array([60, 60, 59, 40, 24, 23, 10, 1, 33])
    h = secret_scan.window_entropy(codes, lengths, 24, 7)
    for r in range(9):
        for w in range(60 - 24 + 1):
            if w + 24 <= lengths[r]:
                assert abs(h[r, w] - entropy(list(codes[r, w:w + 24]))) < 1e-9
            else:
                assert np.isnan(h[r, w])


def test_allow_list_suppresses_and_base_spans_stay(spark):
    key = "q7Rz0PmX2vLk9TbW4sHd8YcJ1nGf"
    texts = [f"see {key} there", f"token = {key}"]
    found = [r["spans"] for r in secret_scan.secrets(docs_frame(spark, texts)).orderBy("doc_id").collect()]
    assert found == ["entropy_base64:4:32", "assign:0:36"]
    for kw in ({"allow": [key]}, {"allow_patterns": ["q7.*Gf"]}):
        found = [r["spans"] for r in secret_scan.secrets(docs_frame(spark, texts), **kw).orderBy("doc_id").collect()]
        assert found == ["", "assign:0:36"]


def test_redacted_secrets(spark):
    key = "q7Rz0PmX2vLk9TbW4sHd8YcJ1nGf"
    docs = docs_frame(spark, [f"é token = {key} end", f"x {key}", "plain", None]).withColumn("secrets", F.lit("clash"))
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["é [ASSIGN] end", "x [ENTROPY_BASE64]", "plain", None]
    assert {r["secrets"] for r in out.collect()} == {"clash"}


def test_secrets_of_odd_empty_and_shared_tables(spark):
    rows = sorted(((r["doc_id"], r["spans"]) for r in secret_scan.secrets(odd_docs(spark)).collect()), key=str)
    name = secret_scan.KINDS
    want = sorted(((i, ",".join(f"{name[k]}:{a}:{b}" for a, k, b in spans_by_hand(t or ""))) for i, t in odd_rows()), key=str)
    assert rows == want
    assert secret_scan.secrets(empty_docs(spark)).count() == 0
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in secret_scan.secrets(docs).collect():
        assert r["spans"] == ",".join(f"{name[k]}:{a}:{b}" for a, k, b in spans_by_hand(texts[r["doc_id"]]))


def test_phrase_strings_are_arrow_text():
    words = pa.array([b"a", "é".encode()], pa.binary())
    h = collocations.word_slots(words, "en")
    assert h[0] != h[1] and (h != collocations.word_slots(words, "de")).all()
