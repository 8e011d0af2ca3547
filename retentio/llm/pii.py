"""Personal data: base patterns plus bootstrapped contextual extraction.

Base entities (email, ip, card, phone) are leftmost non-overlapping matches
per kind that pass the kind's test; they are the seeds. Every seed and every
other candidate (a number, its groups of digits parted by single spaces, or a
word with a digit or an at sign) is an *instance* that stands in contexts (the
two words before it, the two words after it: lexical patterns). Over the graph
of patterns and instances, per kind, rounds alternate: a pattern that holds
``min_seeds`` accepted instances or more scores their share among these and
the instances that contradict it (whose shape is none of the kind's; values of
the right shape that are not accepted yet say nothing); an instance of the
right shape scores the noisy-or of its patterns that reach ``min_pattern``, and
is accepted from ``accept`` on. Accepted instances support patterns in the next
round, so that a pattern without a seed of its own can be found through them.
Rounds end when nothing new is accepted, or after ``rounds``. All occurrences
of accepted instances become spans. Base spans always stay.

Texts are read once; what goes on are the occurrences (a kind, a place, a
short context). Gaps between matches give the places, as prefix sums of
lengths. Everything is aggregation and equi-join over occurrence rows; no
text is shuffled.

Defined cases: null text counts as empty; places are code points, end
exclusive; repeated rows get equal results; overlapping kinds are all
reported; contexts reach 80 code points, longer words are cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import SPACE, WORD, row_key, saved

# Kinds in reporting order and their patterns. Possessive
# quantifiers and look-behinds keep the search linear in the text; they
# exclude no match of the plain forms (a run that fails from its start fails
# from any later start, too).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other candidates: numbers (groups of digits, parted by single spaces), and
#: words with a digit or an at sign.
NUMBER = r"[(+]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)*+(?![^\x20\x09-\x0D,;:!?\"'])"
OTHER = rf"(?<![^\x20\x09-\x0D])(?:{NUMBER}|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "other": ""}
CONTEXT = 80


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn test of a string of digits (any length)."""
    d = F.split(F.reverse(number), "")
    total = F.aggregate(F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern is an entity."""
    n = F.length(digits(match))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == "card", n.between(13, 19) & luhn(digits(match)))
            .when(kind == "phone", n.between(9, 15))
            .otherwise(F.lit(True)))


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Array of the matches of a pattern with the gap before each."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("g"),
                                    F.slice(gaps, 2, F.size(m)).alias("a")),
                       lambda x, i: F.struct(
                           F.lit(kind).alias("kind"), i.alias("idx"), x["m"].alias("match"),
                           F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(CONTEXT)).alias("before"),
                           F.left(x["a"], F.lit(CONTEXT)).alias("after")))
    need = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9@]")
    return F.when(need, rows)


def occurrences(docs: DataFrame) -> DataFrame:
    """Every base match and every other candidate word of every text: _key,
    kind, start, end, match, before, after. One row per place and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [F.coalesce(_found(text, k, p), F.array().cast(
        "array<struct<kind:string,idx:int,match:string,gap:int,before:string,after:string>>"))
        for k, p in {**PATTERNS, "other": OTHER}.items()]
    d = docs.where(F.col("text").rlike("[0-9@]")).select(
        row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.explode(F.concat(*found)).alias("o"))
    d = d.select("_key", "o.*").dropDuplicates(["_key", "kind", "idx"])
    w = Window.partitionBy("_key", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    return d.select("_key", "kind", (end - F.length("match")).alias("start"), end.alias("end"),
                    "match", "before", "after")


def shape(token: Column) -> Column:
    """The kind that a token's shape allows, or null."""
    n = F.length(digits(token))
    return (F.when(token.rlike(r"^[^@]+(?:@|[(\[]at[)\]])[^@]+$"), "email")
            .when(token.rlike(r"^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$"), "ip")
            .when(token.rlike(r"^[0-9][0-9\x20-]*$") & n.between(13, 19), "card")
            .when(token.rlike(r"^[+(]?[0-9][\x200-9().-]*$") & n.between(7, 15), "phone"))


def contexts(before: Column, after: Column) -> Column:
    """Patterns of a place: two words before, two words after (lower case)."""
    w = rf"({WORD})" + SPACE + "+" + rf"({WORD})"
    left = F.regexp_extract(F.lower(before), w + SPACE + r"*$", 0)
    right = F.regexp_extract(F.lower(after), "^" + r"[,.;:!?]?" + SPACE + "+" + w, 0)
    both = F.array(F.concat(F.lit("L "), F.regexp_replace(F.trim(left), SPACE + "+", " ")),
                   F.concat(F.lit("R "), F.regexp_replace(F.trim(right), SPACE + "+", " ")))
    return F.filter(both, lambda c: F.length(c) > 2)


def bootstrap(occ: DataFrame, rounds: int = 5, min_seeds: int = 3, min_pattern: float = 0.9,
              accept: float = 0.9) -> DataFrame:
    """New identifiers: (kind, x, score) of accepted instances that are no
    seeds (x: hash of the lower-cased value).

    ``occ`` has base entities (kind set) and other candidates (kind ``other``,
    ``guess`` their shape's kind or null). Each round is two aggregations and
    three equi-joins over distinct (pattern, instance) edges.
    """
    value = F.lower("match")
    edges = occ.select(
        F.when(F.col("kind") == "other", F.col("guess")).otherwise(F.col("kind")).alias("kind"),
        (F.col("kind") != "other").cast("double").alias("seed"), value.alias("value"),
        F.explode(contexts(F.col("before"), F.col("after"))).alias("pattern"))
    # a shape of no kind counts against every kind's patterns
    edges = saved(edges.groupBy("pattern", F.coalesce("kind", F.lit("")).alias("kind"),
                                F.xxhash64("value").alias("x")).agg(F.max("seed").alias("seed")), "pii-all-edges")
    # a pattern can gather support if enough of its instances have the kind's
    # shape; the rest of them contradicts it, whatever is accepted
    per_kind = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = per_kind.groupBy(F.col("pattern").alias("tp")).agg(F.sum("n").alias("all"))
    live = per_kind.where((F.col("n") >= min_seeds) & (F.col("kind") != "")).join(
        total, F.col("pattern") == F.col("tp")).select("pattern", "kind", (F.col("all") - F.col("n")).alias("against"))
    known = edges.where("seed = 1").select("kind", "x").distinct().withColumn("score", F.lit(1.0))
    edges = saved(edges.join(live, ["pattern", "kind"]).drop("seed"), "pii-edges")
    known = saved(known, "pii-seeds")
    scores, before = known, known.count()
    for _ in range(rounds):
        support = edges.join(scores, ["kind", "x"]).groupBy("pattern", "kind").agg(
            F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.max("against").alias("against"))
        p = F.col("s") / (F.col("n") + F.col("against"))
        good = support.where((F.col("n") >= min_seeds) & (p >= min_pattern)).select("pattern", "kind", p.alias("p"))
        # a pattern's word for an instance is never certain
        least = F.least(F.col("p"), F.lit(0.999))
        found = edges.join(good, ["pattern", "kind"]).groupBy("kind", "x").agg(
            (1 - F.exp(F.sum(F.log(1 - least)))).alias("score")).where(F.col("score") >= accept)
        found = found.join(known.select("kind", "x"), ["kind", "x"], "left_anti")
        scores = saved(known.unionByName(found), "pii-scores")
        now = scores.count()
        if now == before:
            break
        before = now
    return scores.join(known.select("kind", "x"), ["kind", "x"], "left_anti")


def _cells(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / 64), F.floor((end - 1) / 64)))


def untouched(others: DataFrame, base: DataFrame) -> DataFrame:
    """The words that overlap no base span; spans meet in 64-wide cells."""
    a = others.select(F.col("_key").alias("ka"), F.col("start").alias("sa"), F.col("end").alias("ea"),
                      _cells(F.col("start"), F.col("end")).alias("ca"))
    b = base.select(F.col("_key").alias("kb"), F.col("start").alias("sb"), F.col("end").alias("eb"),
                    _cells(F.col("start"), F.col("end")).alias("cb"))
    hit = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("ca") == F.col("cb"))
                 & (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea"))).select("ka", "sa").distinct()
    return others.join(hit, (F.col("_key") == F.col("ka")) & (F.col("start") == F.col("sa")), "left_anti")


def spans(docs: DataFrame, **kw) -> DataFrame:
    """All spans: _key, kind, start, end, base (of a base pattern or found)."""
    occ = occurrences(docs).where(passes(F.col("kind"), F.col("match")))
    # other words go without the punctuation around them (each run of it is tried once: linear)
    head = F.regexp_replace("match", r"^[^\p{L}\p{N}+(]++", "")
    core = F.regexp_replace(head, r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    lead = F.length("match") - F.length(head)
    other = F.col("kind") == "other"
    occ = occ.select("_key", "kind", F.when(other, F.col("start") + lead).otherwise(F.col("start")).alias("start"),
                     F.when(other, F.col("start") + lead + F.length(core)).otherwise(F.col("end")).alias("end"),
                     F.when(other, core).otherwise(F.col("match")).alias("match"), "before", "after")
    occ = saved(occ.where(F.col("end") > F.col("start")).withColumn(
        "guess", F.when(F.col("kind") == "other", shape(F.col("match")))), "pii-places")
    base, others = occ.where("kind <> 'other'"), occ.where("kind = 'other'")
    others = saved(untouched(others, base), "pii-words")
    new = bootstrap(base.unionByName(others), **kw).select(F.col("kind").alias("guess"), F.col("x").alias("_x"))
    found = others.where("guess IS NOT NULL").withColumn("_x", F.xxhash64(F.lower("match"))).join(new, ["guess", "_x"])
    return (base.select("_key", "kind", "start", "end", F.lit(True).alias("base"))
            .unionByName(found.select("_key", F.col("guess").alias("kind"), "start", "end", F.lit(False).alias("base"))))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def per_row(found: DataFrame) -> DataFrame:
    """Per row key: counts of base entities per kind, base and all spans as
    sorted arrays of (o, start, end, kind, base)."""
    g = found.groupBy("_key").agg(
        *[F.sum(F.when(F.col("base") & (F.col("kind") == k), 1).otherwise(0)).cast("long").alias(f"n_{k}")
          for k in KINDS],
        F.array_sort(F.collect_list(F.struct(_order(F.col("kind")).alias("o"), "start", "end", "kind", "base"))
                     ).alias("spans"))
    return g.withColumnRenamed("_key", "_k")


def text_of(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_found (spans that the patterns added)."""
    per = per_row(spans(docs, **kw))
    d = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    d = d.join(per, F.col("_key") == F.col("_k"), "left")
    every = F.coalesce("spans", F.array().cast("array<struct<o:bigint,start:bigint,end:bigint,kind:string,base:boolean>>"))
    return d.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                    F.sha2(text_of(F.filter(every, lambda s: s["base"])), 256).alias("base_sha256"),
                    text_of(every).alias("spans"),
                    F.size(F.filter(every, lambda s: ~s["base"])).cast("long").alias("n_found"))


def redact(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; touching or
    overlapping spans become one, named after the first. ``n_chars``, where
    there is one, follows the text."""
    per = per_row(spans(docs, **kw))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                    F.col("text").alias("_text"), row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    d = d.join(per.select("_k", F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].cast("int").alias("s"), s["end"].cast("int").alias("e"), s["kind"].alias("k")))).alias("_sp")),
        F.col("_key") == F.col("_k"), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.when(s["s"] > acc["at"], F.substring(F.col("_text"), acc["at"] + 1, s["s"] - acc["at"])).otherwise("")
        name = F.when((s["s"] >= acc["at"]) | (acc["at"] == 0), F.concat(F.lit("["), F.upper(s["k"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], gap, name).alias("out"), F.greatest(acc["at"], s["e"]).alias("at"))

    masked = F.aggregate(F.col("_sp"), start, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    d = d.withColumn("_new", F.when(F.col("_sp").isNotNull(), masked).otherwise(F.col("_text")))
    cols = []
    for c in docs.columns:
        col = F.col("_row").getField(c)
        if c == "text":
            col = F.col("_new")
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            col = F.when(F.col("_sp").isNotNull(), F.length("_new").cast(kind)).otherwise(col)
        cols.append(col.alias(c))
    return d.select(*cols)
