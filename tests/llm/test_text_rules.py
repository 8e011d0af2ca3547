"""Quality rules, personal data, licences, decontamination, language."""

import hashlib
import itertools
import math
import pathlib
import random
import re
import textwrap
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from retentio.llm import decontamination, language, license_texts, licenses, pii, quality
from retentio.llm.common import drop_saved, row_key, saved
from retentio.session import path_exists
from tests.conftest import SF0001, SF001
from tests.llm.fixtures import docs_frame, empty_docs, labels, odd_docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_base_rules_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = random.Random(1)
    extra = [" ".join(rng.choice("a b c d".split()) for _ in range(n)) for n in range(40)]
    extra += ["x\nx\n y\nx \n\n", "#a *b $c", "a b c a b c"]
    # long texts: few and many repeats
    extra += [" ".join(f"w{rng.randrange(n)}" for _ in range(9000)) for n in (12, 25, 60, 100_000)]
    docs = docs.select("doc_id", "text").unionByName(docs_frame(spark, [(10_000 + i, t) for i, t in enumerate(extra)]).select("doc_id", "text"))
    texts |= {10_000 + i: t for i, t in enumerate(extra)}
    for r in quality.base_rules(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == base_counts(texts[r["doc_id"]]), r["doc_id"]


def test_quality_keeps_trusted_prose_and_rejects_symbol_junk(spark):
    rng = random.Random(2)
    good = [prose(rng, 150) for _ in range(60)]
    junk = [" ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in prose(rng, 150).split()) for _ in range(12)]
    docs = docs_frame(spark, good + junk)
    rows = quality.quality(docs, labels(spark, [(i, 1, 0) for i in range(40)] + [(60, 0, 0)])).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept == set(range(60))
    assert quality.keep(docs, labels(spark, [(i, 1, 0) for i in range(40)])).count() == 60


TOKEN = re.compile(r"[a-z0-9\u0080-\U0010ffff]+|[^a-z0-9\u0080-\U0010ffff\s]+", re.A)


def h64(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_scores_and_verdicts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    lab = spark.read.parquet(f"{SF001}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in lab.collect()}
    n = quality.BUCKETS
    toks = {i: TOKEN.findall((t or "").lower()) for i, t in texts.items()}
    grams = {i: [signed(h64(t)) % n for t in k] + [signed(h64(a, b)) % n for a, b in zip(k, k[1:])] for i, k in toks.items()}
    raw, good = Counter(), Counter()
    bad = [Counter(), Counter()], [Counter(), Counter()]
    for i, g in grams.items():
        raw.update(g)
        q, x = marks.get(i, (None, None))
        cls = 1 if x == 1 else 0 if q == 1 else None
        good.update(g if cls == 0 else [])
        for t in set(toks[i]) if cls is not None else ():
            h = h64(t)
            bad[cls][0][h & 0xFFFF] += 1
            bad[cls][1][h >> 32 & 0xFFFF] += 1
    size, tox = [sum(raw.values()), sum(good.values())], [[sum(c.values()) for c in k] for k in bad]
    ratio = [math.log((good[b] + 1) / (size[1] + n)) - math.log((raw[b] + 1) / (size[0] + n)) for b in range(n)]

    def peak(t):
        h, m = h64(t), quality.TOXIC_BUCKETS
        at = (h & 0xFFFF, h >> 32 & 0xFFFF)
        return min(math.log((bad[1][k][at[k]] + 1) / (tox[1][k] + m)) - math.log((bad[0][k][at[k]] + 1) / (tox[0][k] + m)) for k in (0, 1))

    rows = quality.quality(docs, lab).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        if not toks[i]:
            assert r["score"] is r["toxic_peak"] is None and not r["kept"]
            continue
        score, top = sum(ratio[b] for b in grams[i]) / len(grams[i]), max(map(peak, set(toks[i])))
        top = top if top >= quality.FLOOR else 0.0
        assert abs(r["score"] - score) < 1e-5 and abs(r["toxic_peak"] - top) < 1e-9, i
        w, _, _, _, rep = base_counts(texts[i])
        failed = w < 50 or 100 * rep > 50 * w
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and score >= quality.THRESHOLD and top < quality.PEAK), i


def test_a_few_toxic_words_in_long_prose_are_caught(spark):
    rng = random.Random(21)
    def text(bad):
        w = prose(rng, 400, 3000).split()
        for k in range(bad):
            w[rng.randrange(len(w))] = rng.choice(["vilewordA", "vilewordB"])
        return " ".join(w)

    texts = [text(0) for _ in range(120)] + [text(2) for _ in range(80)]
    lab = labels(spark, [(i, 1, 0) for i in range(60)] + [(i, 1, 1) for i in range(120, 180)])
    rows = {r["doc_id"]: r for r in quality.quality(docs_frame(spark, texts), lab).collect()}
    assert all(rows[i]["kept"] for i in range(120))  # labelled and unlabelled ones
    assert not any(rows[i]["kept"] for i in range(120, 200))
    # one text that repeats a word does not make it toxic
    lab = labels(spark, [(i, 1, 0) for i in range(60)] + [(119, 1, 1)])
    rows = quality.quality(docs_frame(spark, texts[:119] + ["oddword " * 300 + texts[0], texts[1] + " oddword"]), lab).collect()
    assert {r["doc_id"]: r["kept"] for r in rows}[120]


def test_quality_without_labels_scores_zero(spark):
    rows = quality.quality(docs_frame(spark, [prose(random.Random(3), 90)]), labels(spark, [])).collect()
    assert rows[0]["score"] == 0 and rows[0]["kept"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in plain.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_entities_match_plain_patterns(spark):
    rng = random.Random(4)
    pieces = ["a.b@c.de", "a@b", "x@y.z_q@r.st", "@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0.00.000.7", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "+1 ((( ", "1 2 3", "é@ü.ß", "😀 10.0.0.1", "..", "-", "+49 30 1234567 ", "a@b.c@d.e"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ".", "x"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    real = [r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    rows = pii.personal_data(docs_frame(spark, texts + real)).collect()
    for r in rows:
        want = base_spans((texts + real)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (texts + real)[r["doc_id"]]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_contexts_find_numbers_that_no_base_pattern_has(spark):
    rng = random.Random(6)
    seeds = [f"{prose(rng, 20)} reach me under +1 (743) 555-{rng.randint(1000, 9999)} {prose(rng, 20)}" for _ in range(12)]
    hidden = f"{prose(rng, 10)} reach me under 743-555-0199 please {prose(rng, 5)}"
    elsewhere = f"{prose(rng, 10)} noted 743-555-0199 twice"
    other = f"{prose(rng, 10)} the year 2024 and part 12345678 {prose(rng, 5)}"
    docs = docs_frame(spark, seeds + [hidden, elsewhere, other])
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    at = hidden.index("743-555-0199")
    assert rows[12]["spans"] == f"phone:{at}:{at + 12}" and rows[12]["n_phone"] == 0 and rows[12]["n_found"] == 1
    assert rows[13]["n_found"] == 1  # the same number in another place
    assert rows[14]["spans"] == ""
    red = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert "743-555-0199" not in red[12]["text"] and "[PHONE]" in red[12]["text"]
    assert red[12]["n_chars"] == len(red[12]["text"]) and red[14]["text"] == other


def test_license_canonical_forms(spark):
    mit = license_texts.TEXTS["MIT"]
    texts = ["Copyright (c) 1999 Jane Doe\n\n" + mit.upper(), mit.replace("sublicense", "sub-license").replace(",", " ;"),
             mit + " and more", "some prose\n* Released under the MIT Licence!\nend", "", None]
    rows = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, texts), licenses.known_digests(spark)).collect()}
    assert [rows[i]["license"] for i in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert rows[3]["notices"] == "MIT notice" and rows[3]["n_notices"] == 1 and rows[5]["digest"] is None


def wrappings(text):
    """A text wrapped in other ways, with copyright statements around it."""
    flat = " ".join(text.split())
    yield text
    yield flat
    yield textwrap.fill(flat, 50)
    yield text.upper().replace("\n", "\r\n")
    yield "Copyright (c) 2020 Jane Doe and others\n\n" + text
    yield "Copyright 1999-2004, 2007 The X Project.\n(c) 2011 Y Inc. All rights reserved.\n\n" + textwrap.fill(flat, 90)
    yield "© Z 2003\n" + "\n".join("  * " + x for x in text.split("\n"))


def test_licences_are_found_under_any_wrapping(spark):
    texts, names = [], []
    for name, text in license_texts.TEXTS.items():
        for t in wrappings(text):
            texts.append(t)
            names.append(name)
    rows = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, texts), licenses.known_digests(spark)).collect()}
    assert [rows[i]["license"] for i in range(len(texts))] == names


def test_titles_headers_notices_and_one_line_statements(spark):
    mit, gpl = license_texts.TEXTS["MIT"], dict(reversed(list(license_texts.texts())))["GPL-3.0-or-later header"]
    one_line = " ".join(mit.split())
    texts = ["The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + mit, "Copyright (c) 2020 X. " + one_line, "Copyright (c) 2020 X " + one_line,
             gpl, "Licensed under the MIT License.", "prose\nThis project is licensed under the terms of the BSD 3-Clause license\nSPDX-License-Identifier: MPL-2.0",
             "copyright notice and this permission notice appear in all copies.", mit.replace("free of charge", "for a fee")]
    rows = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, texts), licenses.known_digests(spark)).collect()}
    assert [rows[i]["license"] for i in range(8)] == ["MIT", "MIT", "MIT", "GPL-3.0-or-later header", "MIT notice", None, None, None]
    assert rows[5]["notices"] == "BSD-3-Clause notice,MPL-2.0 notice" and rows[6]["digest"] is not None


def test_digests_of_long_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1",
             "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "Artistic-1.0-Perl": "Artistic"}
    there = {n: pathlib.Path("/usr/share/common-licenses", f) for n, f in files.items()}
    there = {n: f.read_text(errors="replace") for n, f in there.items() if f.exists()}
    if not there:
        pytest.skip("no licence texts on this system")
    names = sorted(there)
    wide = [re.sub(r"(?<=[a-z,;])\n *(?=[a-z])", " ", there[n]) for n in names]  # one line per paragraph
    rows = licenses.scan(docs_frame(spark, [there[n] for n in names] + wide), licenses.known_digests(spark)).collect()
    assert {r["doc_id"]: r["license"] for r in rows} == dict(enumerate(names + names))


def found_texts(spark, texts, **kw):
    """The added spans of each text, as its words."""
    out = {}
    for r in pii.personal_data(docs_frame(spark, texts), **kw).collect():
        base = set(filter(None, base_spans(texts[r["doc_id"]]).split(",")))
        new = [x.split(":") for x in filter(None, r["spans"].split(",")) if x not in base]
        out[r["doc_id"]] = [(k, texts[r["doc_id"]][int(a):int(b)]) for k, a, b in new]
        assert r["n_found"] == len(new)
    return out


def test_found_numbers_make_new_patterns(spark):
    rng = random.Random(12)

    def near(a, number, b="end"):
        return f"{prose(rng, 6)} {a} {number} {b} {prose(rng, 6)}"

    seeds = [near("reach me", f"+1 (743) 555-{1000 + k}") for k in range(4)]
    # seen after "reach me" and, too, after "dial now": those two words are a pattern of the second round
    both = [f"743 555 {2000 + k}" for k in range(4)]
    first = [near("reach me", x) for x in both]
    second = [near("dial now", x, "thanks") for x in both]
    third = [near("dial now", "(743) 555-3999", "thanks")]
    other = [near("order code", f"7435552{k}99") for k in range(5)]
    texts = seeds + first + second + third + other
    got = found_texts(spark, texts)
    assert [got[4 + k] for k in range(4)] == [got[8 + k] for k in range(4)] == [[("phone", x)] for x in both]
    assert got[12] == [("phone", "(743) 555-3999")]
    assert all(got[i] == [] for i in [0, 1, 2, 3, *range(13, 18)])
    one = found_texts(spark, texts, rounds=1)  # one round finds no second generation
    assert one[4] == [("phone", both[0])] and one[12] == []


def test_half_of_a_contexts_numbers_hidden(spark):
    rng = random.Random(13)
    texts = []
    for k in range(30):
        number = f"+49 30 12345{k:02d}0" if k % 2 else rng.choice([f"030 12345{k:02d}0", f"(030) 12345{k:02d}0", f"030-12345{k:02d}0"])
        texts.append(f"{prose(rng, 8)} my phone {number}, {prose(rng, 8)}")
    got = found_texts(spark, texts)
    assert all(len(got[k]) == (k % 2 == 0) for k in range(30))
    assert all(got[k][0][1] in texts[k] and got[k][0][1].endswith("0") for k in range(0, 30, 2))


def test_a_context_with_contradicting_words_is_no_pattern(spark):
    rng = random.Random(14)
    texts = [f"{prose(rng, 6)} the number {x} {prose(rng, 6)}" for x in
             [f"+1 (743) 555-{1000 + k}" for k in range(4)] + ["room3", "b2b", "7x", "743 555 0199"]]
    assert all(x == [] for x in found_texts(spark, texts).values())


def test_long_texts_of_candidates_take_linear_time(spark):
    def seconds(n):
        texts = ["1 " * n, "a@b." * n, "+1(" * n, "1" + "." * n + "x", "1(" * n, "9" * n, "1." * n]
        t = time.monotonic()
        assert pii.personal_data(docs_frame(spark, texts)).count() == 7
        return time.monotonic() - t

    seconds(100)
    short = seconds(20_000)
    assert seconds(160_000) < 8 * short + 20


def tokens_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_contaminated(doc, item):
    """Best agreement of any window of the document with any of the item."""
    a, b = tokens_of(doc), tokens_of(item)
    n, best = len(b), 0
    if n < decontamination.SPAN:
        return 0 < n and any(a[i:i + n] == b for i in range(len(a) - n + 1)), n
    w = min(decontamination.WINDOW, n)
    for i in range(len(a) - w + 1):
        for j in range(n - w + 1):
            best = max(best, sum(x == y for x, y in zip(a[i:i + w], b[j:j + w])))
    return best >= -(-w * 8 // 10), best


def test_masks_hit_every_pattern_that_the_agreement_allows():
    span = decontamination.SPAN
    masks = [[k for k, on in enumerate(m) if on == "1"] for m in decontamination.MASKS]
    for w in range(span, decontamination.WINDOW + 1):
        for n in range(w - -(-w * 8 // 10) + 1):
            for bad in itertools.combinations(range(w), n):
                assert any(not any(o + k in bad for k in m) for m in masks for o in range(w - span + 1)), (w, bad)


@pytest.mark.parametrize("kw", [{}, {"max_seeds": 60}, {"piece": 30, "max_seeds": 500}])
def test_spaced_seeds_find_substituted_passages(spark, kw):
    rng = random.Random(7)
    items = [prose(rng, rng.randint(1, 30)) for _ in range(14)] + [prose(rng, 130), "", "!!!", None]
    texts = []
    for n in range(60):
        body = prose(rng, 40).split()
        passage = rng.choice(items[:15]).split()
        for _ in range(n % 6):
            passage[rng.randrange(len(passage))] = "sub"
        cut = rng.randint(0, 3)
        texts.append(" ".join(body[:20] + passage[cut:] + body[20:]))
    texts += [prose(rng, 50) for _ in range(5)] + [items[0], items[14], "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs_frame(spark, texts), bench, **kw).collect()}
    for i, t in enumerate(texts):
        found = {k: brute_contaminated(t, x) for k, x in enumerate(items)}
        hits = [k for k, (bad, _) in found.items() if bad]
        want = (bool(hits), len(hits), min(hits, default=None), max((found[k][1] for k in hits), default=0))
        assert tuple(got[i])[1:] == want, i
    assert 10 < sum(r["contaminated"] for r in got.values()) < 68


def test_every_thirteen_token_window_within_the_agreement_is_found(spark):
    item = [f"t{k}" for k in range(13)]
    pairs = list(itertools.combinations(range(13), 2))
    texts = [" ".join("before it".split() + ["x" if k in p else t for k, t in enumerate(item)] + ["after"]) for p in pairs]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = decontamination.decontaminate(docs_frame(spark, texts), bench).collect()
    assert len(rows) == 78 and all(r["contaminated"] and r["matched"] == 11 for r in rows)


def test_items_without_id_repeated_ids_and_repeated_items(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 16) for _ in range(3))
    bench = spark.createDataFrame([(None, a), (5, b), (5, c), (5, c), (None, None)], "item_id long, text string")
    docs = docs_frame(spark, [f"x {a} y", f"{c} and {b}", f"{a} {b}", "clean"])
    rows = decontamination.decontaminate(docs, bench.withColumn("_item", F.lit("clash"))).orderBy("doc_id").collect()
    assert [tuple(r)[1:4] for r in rows] == [(True, 1, None), (True, 2, 5), (True, 2, 5), (False, 0, None)]
    assert [r["doc_id"] for r in decontamination.clean(docs, bench).collect()] == [3]


def test_row_keys_tell_nulls_and_places_apart(spark):
    rows = [("4111111111111111", None), (None, "4111111111111111"), (None, None), ("", None), (None, ""), ("", "")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    assert d.select(row_key(F.col("doc_id"), F.col("text"))).distinct().count() == 6
    got = {r["doc_id"]: (r["n_card"], r["spans"]) for r in pii.personal_data(d.limit(2)).collect()}
    assert got == {"4111111111111111": (0, ""), None: (1, "card:0:16")}


def test_drop_saved_leaves_other_folders_alone(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "table"))
    drop_saved(spark.read.parquet(str(tmp_path / "table")))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    kept = saved(spark.range(3).toDF("id"), "probe")
    drop_saved(kept)
    assert not path_exists(spark, kept.inputFiles()[0].rsplit("/", 1)[0]) if kept.inputFiles() else True


def test_benchmark_passages_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r["text"].strip() for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(x in r["text"] for x in items)}
    got = {r["doc_id"] for r in decontamination.decontaminate(docs, bench).where("contaminated").collect()}
    assert want <= got and len(got) < len(want) + 3


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.fit(d.where(~held))
    p = language.predict(d.where(held).select("doc_id", "text", "lang"), model)
    assert p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_pieces_count_each_gram_once(monkeypatch):
    import numpy as np

    text = "abcdefghijklmnopqrstuvwxyz" * 40

    def total(piece):
        monkeypatch.setattr(language, "PIECE", piece)
        out = np.zeros(256)
        for _, b, n in language.gram_counts([text, "xy", ""], 256):
            np.add.at(out, b, n)
        return out

    assert (total(1 << 19) == total(37)).all()


def bayes_by_hand(rows, texts, features):
    """Naive Bayes with a loop over every n-gram."""
    m64 = (1 << 64) - 1
    steps = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]

    def buckets(t):
        codes = [ord(c) for c in t.lower()]
        for i in range(len(codes)):
            h = 0
            for k in range(min(3, len(codes) - i)):
                h = (h ^ codes[i + k]) * steps[k] & m64
                h ^= h >> 29
                yield (h * steps[0] & m64) >> (64 - (features.bit_length() - 1))

    counts, docs = {}, Counter()
    for t, g in rows:
        if t is not None and g is not None:
            counts.setdefault(g, Counter()).update(buckets(t))
            docs[g] += 1
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        s = {}
        for g in sorted(counts):
            total = sum(counts[g].values()) + language.SMOOTH * features
            s[g] = math.log(docs[g] / sum(docs.values())) + sum(math.log((counts[g][b] + language.SMOOTH) / total) for b in buckets(t))
        best = max(sorted(s), key=s.get)
        out.append((best, 1 / sum(math.exp(x - s[best]) for x in s.values())))
    return out


@pytest.mark.parametrize("bound", [language.MAX_MATRIX_BYTES, 2 * 8 * 1024, 1])
def test_predictions_match_brute_force_in_any_blocks(spark, bound):
    rng = random.Random(31)
    alphabets = {"aa": "abcde ", "bb": "bcdef ", "cc": "xyz. ", "dd": "éüß a", "zz": "abcde "}
    rows = [("".join(rng.choice(alphabets[g]) for _ in range(rng.randrange(40))), g) for g in alphabets for _ in range(12)]
    rows += [(None, "aa"), ("abc", None), ("", "bb")]
    texts = ["".join(rng.choice(rng.choice(list(alphabets.values()))) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    texts += [None, "", "123 !", "A", "bcd", "\U0001F600", "é" * 3000]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), features=1024)
    assert model[2].shape == (5, 1024)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("_best", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.predict(docs, model, bound).collect()}
    for i, (lang, p) in enumerate(bayes_by_hand(rows, texts, 1024)):
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - p) < 1e-6, (i, texts[i])
        assert got[i]["_best"] == "clash"


def test_equal_probabilities_go_to_the_first_language(spark):
    rows = [("abc abc", g) for g in ("b", "a", "c")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    for bound in (language.MAX_MATRIX_BYTES, 1):
        r = language.predict(spark.createDataFrame([("abc",)], "text string"), model, bound).first()
        assert r["lang_pred"] == "a" and abs(r["score"] - 1 / 3) < 1e-9


def test_odd_rows(spark):
    d, n = odd_docs(spark), len(odd_rows())
    bench = spark.createDataFrame([(1, "w1x w2x"), (None, None), (2, "")], "item_id long, text string")
    lab = labels(spark, [(5, 1, None), (None, 1, 0), (5, 1, 0)])
    assert quality.quality(d, lab).count() == n
    assert pii.personal_data(d).count() == n
    assert pii.redact(d).columns == d.columns
    assert decontamination.decontaminate(d, bench).count() == n
    hit = sum(brute_contaminated(t, "w1x w2x")[0] for _, t in odd_rows())
    assert decontamination.clean(d, bench).count() == n - hit
    assert licenses.scan(d, licenses.known_digests(spark)).count() == n
    model = language.fit(d.select("text", "lang"))
    rows = language.predict(d, model).collect()
    assert len(rows) == n and all(r["lang_pred"] == "und" for r in rows if r["text" if "text" in r else "doc_id"] in (1, 2, 3, 13))


def test_empty_tables(spark):
    d, lab = empty_docs(spark), labels(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality(d, lab).count() == 0
    assert pii.personal_data(d).count() == 0
    assert decontamination.decontaminate(d, bench).count() == 0
    assert licenses.scan(d, licenses.known_digests(spark)).count() == 0
    assert language.predict(d.select("doc_id", "text"), language.fit(d)).count() == 0
