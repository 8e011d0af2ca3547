"""Queries over whole tables: one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.llm import (
    audit, collocations, debruijn, decontamination, jaccard, language, licenses, mixing, pii, quality, secret_scan,
    substrings, tokens)
from retentio.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return put


@query("op1_quality_rules")
def op1(spark, sf):
    q = quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept", "score", "toxic_peak")


MIX_SQL = """
WITH d AS (SELECT doc_id, source, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
             CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
c AS (SELECT *, CASE WHEN size < 16 THEN size
             ELSE 16 * length(bin(size)) + ((size >> (length(bin(size)) - 5)) & 15) END AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM l),
r AS (SELECT c.doc_id, c.size, c.source, t.source_size, t.target,
             row_number() OVER (PARTITION BY c.source ORDER BY class, k, c.doc_id, c.size) AS nth,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             CAST('0x' || substr(md5('mix:' || coalesce('s:' || c.source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target,
       CAST(least(floor(start + rate * nth) - floor(start + rate * (nth - 1)), 2) AS BIGINT) AS copies,
       CAST(least(floor(start + rate * nth) - floor(start + rate * (nth - 1)), 2) AS BIGINT) * size AS taken
FROM r"""


@query("op3_jaccard_join")
def op3(spark, sf):
    return jaccard.jaccard_components(table(spark, sf, "documents"), size=3, pct=90).select(
        "doc_id", "n_shingles", "component_id")


@query("op5_mix_sources", MIX_SQL)
def op5(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source", "source_size", "target", "copies", "taken")


@query("op8_decontaminate")
def op8(spark, sf):
    return decontamination.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_personal_data")
def op2(spark, sf):
    return pii.personal_data(table(spark, sf, "documents"))


@query("op4_language")
def op4(spark, sf):
    # fixed by contract: every fifth id hash is held out of learning
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    d = table(spark, sf, "documents").withColumn("held_out", held)
    model = language.fit(d.where(~F.col("held_out")).select("text", "lang"))
    return language.predict(d.select("doc_id", "text", "held_out"), model)


@query("op9_repeated_bytes")
def op9(spark, sf):
    return substrings.strip(table(spark, sf, "documents"), texts=False)


@query("op10_repeated_words")
def op10(spark, sf):
    return debruijn.strip(table(spark, sf, "documents"), texts=False)


# Canonical lines of a (doc_id, text) table, in its own words: line by line, a
# year or a sign with the word copyright ends the line.
LICENSE_SQL = """
SELECT doc_id, text, list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: trim(regexp_replace(
        __SPELL__, '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM __TABLE__"""


def _license_sql() -> str:
    from retentio.llm import license_texts as lt
    spell = r"regexp_replace(x, '((copyright ?)?(\(c\)|©) ?|copyright |\(c\) ?)[0-9]{4}.*$|copyright ?(\(c\)|©).*$|©.*$', '')"
    spell = f"replace({spell}, 'all rights reserved', '')"
    for old, new in licenses.SPELLINGS:
        spell = f"replace({spell}, '{old}', '{new}')"
    inner = LICENSE_SQL.replace("__SPELL__", spell)

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    def values(rows):
        return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"

    names = values((k, n) for k, v in lt.NAMES.items() for n in v)
    one = {k: values((x,) for x in v) for k, v in (("b", lt.BEGINNINGS), ("a", lt.ARTICLES), ("e", lt.ENDINGS))}
    return f"""
WITH d AS ({inner.replace("__TABLE__", "documents")}),
t AS (SELECT * FROM {values(lt.texts())} v(doc_id, text)
      UNION ALL SELECT spdx || ' notice', b || ' ' || a || name || e FROM {names} n(spdx, name), {one["b"]} b(b), {one["a"]} a(a), {one["e"]} e(e)
      UNION ALL SELECT DISTINCT spdx || ' notice', 'SPDX-License-Identifier: ' || spdx FROM {names} n(spdx, name)),
c AS ({inner.replace("__TABLE__", "t")}),
k AS (SELECT digest, min(license) AS license FROM (
        SELECT md5(array_to_string(lines, ' ')) AS digest, doc_id AS license FROM c WHERE len(lines) > 0
        UNION ALL SELECT digest, license FROM {values((d, n) for n, d in lt.DIGESTS.items())} v(digest, license)) GROUP BY digest),
n AS (SELECT doc_id, text, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
      FROM (SELECT doc_id, text, md5(unnest(lines)) AS m FROM d) JOIN k ON m = digest GROUP BY doc_id, text),
w AS (SELECT doc_id, text, CASE WHEN len(lines) > 0 THEN md5(array_to_string(lines, ' ')) END AS digest FROM d)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n, 0) AS n_notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN n ON w.doc_id = n.doc_id AND w.text = n.text"""


@query("op6_license_scan", _license_sql())
def op6(spark, sf):
    return licenses.scan(table(spark, sf, "documents"), licenses.known_digests(spark))


@query("op7_token_counts")
def op7(spark, sf):
    return tokens.document_tokens(table(spark, sf, "documents"))


PHRASE_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM q
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM q
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM q),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT lang, size, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM c
      UNION ALL SELECT lang, size, phrase, a, 2, array_to_string(w[:2], ' '), w[3] FROM c WHERE size = 3),
s AS (SELECT k.lang, k.size, k.phrase, a, k, l.f AS l, r.f AS r,
             CAST(a AS HUGEINT) * a * 1000000 // (CAST(l.f AS HUGEINT) * r.f) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = head JOIN f r ON r.lang = k.lang AND r.phrase = tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, part, max(a) AS a FROM (
        SELECT lang, a, array_to_string(w[:2], ' ') AS part FROM c WHERE size = 3
        UNION ALL SELECT lang, a, array_to_string(w[2:], ' ') FROM c WHERE size = 3) GROUP BY ALL),
x AS (SELECT m.* FROM m LEFT JOIN o ON o.lang = m.lang AND o.part = m.phrase
      WHERE m.size = 3 OR o.a IS NULL OR 100 * o.a < 50 * m.a),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
SELECT y.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM y JOIN n ON n.lang = y.lang WHERE rank <= 2000"""


@query("op11_collocations", PHRASE_SQL)
def op11(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@query("op12_secret_scan")
def op12(spark, sf):
    return secret_scan.secrets(table(spark, sf, "documents"))


AUDIT_SQL = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
b AS (SELECT doc_id, part,
        CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM b LEFT JOIN l ON l.doc_id = b.doc_id GROUP BY part, mask),
f(i, v) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.i || b.i || c.i || d.i || e.i AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS v
      FROM f a, f b, f c, f d, f e WHERE a.v + b.v + c.v + d.v + e.v = 31 AND (a.v | b.v | c.v | d.v | e.v) = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, v[step] AS own, CAST(list_sum(v[:step]) AS INT) - v[step] AS before
      FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark, sf):
    return audit.filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
