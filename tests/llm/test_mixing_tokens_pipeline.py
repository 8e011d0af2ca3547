"""Source mixing, token files, the pipeline, the queries' SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import catalog, mixing, tokens
from retentio.session import scratch_path
from tests.conftest import SF0001
from tests.llm.fixtures import docs_frame, empty_docs, labels, odd_docs, odd_rows, prose


def reshared(sizes, share=1.5, most=2.0):
    """Targets by handing the excess on, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if t[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else t[s] for s in names}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 1000, 20000]) for s in [*"abcdefg", None, "é", "Z"]}
    got = {r["source"]: r["target"] for r in mixing.source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_mix_takes_the_targets_and_reruns_agree(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.choice([0, 5, 40, 300])), f"s{i % 7}") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.05)
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "copy"]


def test_mixed_repeats_equal_rows_together(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "c")] * 40 + [(2, "c", None, None)] * 3, "doc_id long, text string, source string, copy string")
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "mix_copy"]
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r["doc_id"]: r["c"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect() if r["c"]}
    assert sum(n.values()) == pytest.approx(sum(want.values()), abs=3)


@pytest.mark.parametrize("block", [4, 64, tokens.BLOCK_TOKENS])
def test_token_files_round_trip(spark, block):
    import sentencepiece

    enc = sentencepiece.SentencePieceProcessor(model_file=tokens.TOKENIZER)
    rng = random.Random(15)
    rows = [(i * 1_000_003 - 7 if i % 5 else None, prose(rng, rng.randint(0, 60)) if i % 7 else "") for i in range(80)]
    rows += [(-(2**63), None), (2**63 - 1, "x </s> y")]
    path = scratch_path(spark, "tokens")
    tokens.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(
        spark, path, header=tokens.HEADER, block_tokens=block).collect()), key=str)
    assert got == sorted(((i, len(enc.encode(t or ""))) for i, t in rows), key=str)
    plain = tokens.token_counts(spark, path, block_tokens=block).collect()  # read without headers
    assert sorted(r["n_tokens"] - tokens.HEADER for r in plain) == sorted(n for _, n in got)


def counts_by_hand(raw, eod, header):
    t = np.frombuffer(raw, "<u2").tolist()
    out, start = [], 0
    for i, x in enumerate(t):
        if x == eod:
            out.append((start, tokens.id_of(np.array(t[start:start + header]), header) if i - start >= header else None, i - start - header))
            start = i + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("eod,split", [(2, 37), (50256, 64), (0x0202, 41)])
def test_files_read_in_ranges_count_like_whole_ones(spark, tmp_path, eod, split):
    rng = random.Random(eod + split)
    # tokens whose halves make up separators at odd bytes, empty documents, files with and without a last separator
    low, high = eod & 255, eod >> 8
    odd = [low << 8 | rng.randrange(256) for _ in range(3)] + [rng.randrange(256) << 8 | high for _ in range(3)]
    pool = [x for x in odd + [3, 4, 513, 0x0101, 65535] if x != eod] + [eod]
    paths = []
    for k in range(6):
        t = [rng.choice(pool) for _ in range(rng.choice([1, 40, 300]))] + ([eod] if k % 2 else [9])
        (tmp_path / f"f{k}.bin").write_bytes(np.array(t, "<u2").tobytes())
        paths.append(tmp_path / f"f{k}.bin")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for header in (0, 2):
            want = {p.name: counts_by_hand(p.read_bytes(), eod, header) for p in paths}
            for whole in (0, 100):  # all files in ranges, the longer ones
                got = {p.name: [] for p in paths}
                for r in tokens.token_counts(spark, str(tmp_path), eod, header, block_tokens=16, whole_bytes=whole).collect():
                    got[r["path"].rsplit("/", 1)[1]].append((r["start"], r["doc_id"] if r["n_tokens"] >= 0 else None, r["n_tokens"]))
                assert {k: sorted(v, key=str) for k, v in got.items()} == want, (header, whole)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_odd_and_empty_inputs(spark):
    d, n = odd_docs(spark), len(odd_rows())
    assert mixing.mix(d).count() == n
    assert mixing.mixed(d).columns == [*d.columns, "mix_copy"]
    assert tokens.document_tokens(d).count() == n
    e = empty_docs(spark)
    assert mixing.mix(e).count() == 0 and mixing.mixed(e).count() == 0 and tokens.document_tokens(e).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a brute-force view of its own input."""
    import corpus_pipeline as p

    rng = random.Random(16)
    item = prose(rng, 25)
    base = prose(rng, 150)
    texts = [prose(rng, 150) for _ in range(30)] + [base, base, base.replace("v1", "q1", 1)]
    texts += [prose(rng, 60) + " " + item + " " + prose(rng, 60)]
    texts += [prose(rng, 70) + " mail hein.19@mail5.example.com or 10.20.30.40 now " + prose(rng, 70)]
    texts += [" ".join(w + "###" for w in prose(rng, 150).split()), "too short", None]
    docs = docs_frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, 0) for i in range(35)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, d = {}, docs
    for name, stage in p.STAGES:
        d = stage(spark, d, str(tmp_path))
        if name != "mix":
            assert d.columns == docs.columns
        rows = d.collect()
        ids[name] = sorted(r["doc_id"] for r in rows)
        d = spark.createDataFrame(rows, d.schema)
    everything = list(range(35))
    assert ids["quality_rules"] == everything
    assert ids["near_duplicates"] == [i for i in everything if i not in (31, 32)]
    assert ids["decontaminate"] == [i for i in everything if i not in (31, 32, 33)] == ids["redact"]
    text = next(r["text"] for r in rows if r["doc_id"] == 34) if 34 in ids["mix"] else "[EMAIL] or [IP]"
    assert "[EMAIL] or [IP]" in text
    out = p.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == ids["mix"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF0001)
    cols = got.columns
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_rows_that_differ_in_a_map_only_are_all_taken(spark):
    rows = [(1, "same words here", "s", {"a": k}, [{"b": k % 2}]) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, n array<map<string,int>>")
    out = mixing.mixed(d).collect()  # one source takes 150 %: every row once or twice
    assert {r["m"]["a"] for r in out} == set(range(40)) and len(out) == 60
    assert all(r["m"]["a"] % 2 == r["n"][0]["b"] for r in out)


def test_slices_do_not_change_the_mix(spark):
    d = spark.read.parquet(f"{SF0001}/documents.parquet")
    want = sorted((r["doc_id"], r["copies"]) for r in mixing.mix(d, slice_chars=1).collect())
    assert want == sorted((r["doc_id"], r["copies"]) for r in mixing.mix(d, slice_chars=3).collect())
    assert [mixing.slices_for(n) for n in (0, 3_200_000, 3_200_001, 10 ** 9, 10 ** 15)] == [1, 1, 2, 4, 8]


def written(tmp_path, docs, lab, bench):
    for name, df in (("documents", docs), ("labels", lab), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as p
    sf = written(tmp_path, empty_docs(spark), labels(spark, []), spark.createDataFrame([], "item_id long, text string"))
    assert p.run(spark, sf).count() == 0


def test_pipeline_on_odd_rows_keeps_extra_columns_and_drops_toxic_text(spark, tmp_path):
    import corpus_pipeline as p
    rng = random.Random(33)
    fine = [prose(rng, 120, 2000) for _ in range(60)]
    bad = [" ".join(w if k % 40 else "vileword" for k, w in enumerate(prose(rng, 120, 2000).split())) for _ in range(60)]
    rows = [(100 + i, t) for i, t in enumerate(fine + bad)] + odd_rows()
    docs = docs_frame(spark, rows).withColumn("_key", F.lit("clash")).withColumn("copy", F.lit("clash"))
    lab = labels(spark, [(100 + i, 1, 0) for i in range(50)] + [(160 + i, 1, 1) for i in range(50)] + [(None, 1, 1)])
    bench = spark.createDataFrame([(None, fine[7]), (2, None), (3, "")], "item_id long, text string")
    out = p.run(spark, written(tmp_path, docs, lab, bench))
    assert out.columns == [*docs.columns, "mix_copy"]
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert ids <= {*range(100, 160), 4, 5, None} - {107}  # no toxic, contaminated, short or blank text
    assert len(ids & set(range(100, 160))) > 50 and {r["copy"] for r in rows} == {"clash"}
