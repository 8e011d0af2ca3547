"""Secret scan: assignments, access keys and hex strings by pattern, other
secrets by sliding-window Shannon entropy per character class.

Base entities are leftmost non-overlapping matches per kind that pass the
kind's length test. The method adds spans: candidate strings are the maximal
runs of a class's characters that are at least a window long; every window of
such a run is judged by its Shannon entropy. Windows advance by one character:
the leaving and the entering character change one count each, and with it the
sum of c log c, so no window is counted anew. Many runs advance in step
(numpy); a run is cut into blocks of ``BLOCK`` windows that overlap by a window,
so that memory does not grow with its length. Windows at or above the class's
threshold that also mix digits and letters are united into spans.

Suppression: spans that touch a base span are dropped (it is reported
already), and so are those whose run is on the allow list: exact strings given
by the caller, and the patterns of ``ALLOWED`` (UUIDs, dates, paths and
compound words, counting sequences, marked examples).

Texts are read once, nothing is shuffled, and each row is decided alone.

Defined cases: null text counts as empty (no spans); places are code points,
end exclusive; matches and runs never cross rows; repeated rows get equal
results; overlapping base kinds are all reported; input columns other than
those passed on are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.textvec import chunks, encode

# Base kinds in reporting order, patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

HEX = b"0123456789abcdefABCDEF"
BASE64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Character classes of the method: (kind, characters, window, least entropy in bits per character).
CLASSES = (("entropy_hex", HEX, 24, 3.0), ("entropy_base64", BASE64, 24, 4.0))
KINDS = BASE_KINDS + tuple(c[0] for c in CLASSES)
#: Runs (whole strings) that are no secrets.
ALLOWED = (
    rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",             # UUID
    rb"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[-_T][0-9]+)*",                        # date
    rb"(?:[A-Za-z]+|[0-9]{1,4})?(?:[/_-]+(?:[A-Za-z]+|[0-9]{1,4}))+[/_-]*",  # path, compound word
    rb"(?i:.*(?:example|placeholder|dummy|changeme|xxxx).*)",               # marked as no secret
)
BLOCK = 256

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def _members(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def runs(data: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of member bytes, ``least`` or longer."""
    edge = np.diff(members[data].view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


def window_entropy(codes: np.ndarray, lengths: np.ndarray, width: int, symbols: int) -> np.ndarray:
    """Shannon entropy of every window of rows of symbol numbers.

    ``codes`` is (rows, longest row); the result has a column per window, nan
    beyond a row's end. All rows advance by one symbol at a time; a step
    changes two counts per row and the running sum of c log2 c.
    """
    n, longest = codes.shape
    c = np.arange(width + 2)
    term = c * np.log2(np.maximum(c, 1))
    counts = np.zeros((n, symbols), np.int16)
    total, rows = np.zeros(n), np.arange(n)
    out = np.full((n, max(longest - width + 1, 0)), np.nan)
    for t in range(longest):
        live = rows[lengths > t]
        if t >= width:
            old = codes[live, t - width]
            had = counts[live, old]
            total[live] += term[had - 1] - term[had]
            counts[live, old] = had - 1
        new = codes[live, t]
        had = counts[live, new]
        total[live] += term[had + 1] - term[had]
        counts[live, new] = had + 1
        if t >= width - 1:
            out[live, t - width + 1] = np.log2(width) - total[live] / width
    return out


def high_windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, characters: bytes, width: int,
                 least: float) -> np.ndarray:
    """Starts (bytes) of the windows inside the runs that are random enough
    and mix digits and letters."""
    number = np.zeros(256, np.int64)
    number[list(characters)] = np.arange(len(characters))
    blocks = (end - start - width) // BLOCK + 1
    run = np.repeat(np.arange(len(start)), blocks)
    first = start[run] + BLOCK * (np.arange(len(run)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    length = np.minimum(end[run] - first, BLOCK + width - 1)
    digit = _members(b"0123456789")
    letter = _members(bytes(range(65, 91)) + bytes(range(97, 123)))
    found = []
    for a in range(0, len(first), 512):
        f, n = first[a:a + 512], length[a:a + 512]
        at = np.minimum(f[:, None] + np.arange(n.max())[None, :], len(data) - 1)
        chars = data[at]
        h = window_entropy(number[chars], n, width, len(characters))
        good = np.nan_to_num(h, nan=-1.0) >= least - 1e-9
        for kind in (digit, letter):
            seen = np.cumsum(np.pad(kind[chars].astype(np.int32), ((0, 0), (1, 0))), axis=1)
            good &= seen[:, width:] > seen[:, :-width]
        r, w = np.nonzero(good)
        found.append(f[r] + w)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def united(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching windows as maximal spans."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > width)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + width


def _sequence(run: bytes) -> bool:
    """Four in five neighbours differ by one step in the same direction."""
    step = np.diff(np.frombuffer(run, np.uint8).astype(np.int16))
    return len(step) > 0 and max((step == 1).mean(), (step == -1).mean()) >= 0.8


def allowed_run(run: bytes, exact: frozenset[bytes], patterns: re.Pattern) -> bool:
    return run in exact or patterns.fullmatch(run) is not None or _sequence(run)


def places(raw: bytes, exact: frozenset[bytes], patterns: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of everything found in a buffer
    whose rows are separated by line feeds (in no pattern and no class)."""
    data = np.frombuffer(raw, np.uint8)
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= LEAST["assign"]]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    base += [(int(a), 2, int(b)) for a, b in zip(*runs(data, _members(b"0123456789abcdef"), LEAST["hex"]))]
    found: list[tuple[int, int, int]] = []
    for k, (_, characters, width, least) in enumerate(CLASSES):
        # what is reported already: base spans and those of the classes before
        taken = sorted(base + found)
        t_start = np.array([x[0] for x in taken], np.int64)
        t_end = np.maximum.accumulate(np.array([x[2] for x in taken], np.int64)) if taken else t_start
        start, end = runs(data, _members(characters), width)
        if not len(start):
            continue
        for a, b in zip(*united(high_windows(data, start, end, characters, width, least), width)):
            i = np.searchsorted(t_start, b)  # of those, the ones that begin before b
            if i and t_end[i - 1] > a:
                continue
            r = np.searchsorted(start, a, "right") - 1
            if not allowed_run(raw[start[r]:end[r]], exact, patterns):
                found.append((int(a), len(BASE_KINDS) + k, int(b)))
    return sorted(base + found)


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position (``at`` ascending)."""
    if not len(at):
        return at
    lead = (data & 0xC0) != 0x80
    edges = np.concatenate([[0], at])
    sums = [np.count_nonzero(lead[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return np.cumsum(sums)


def _batch_spans(texts: list[bytes], exact, patterns):
    """(row, kind number, start, end) arrays over all rows of a batch."""
    out = [np.zeros((0, 4), np.int64)]
    for part in chunks(texts, 1 << 22):
        rows = texts[part]
        raw = b"\n".join(rows) + b"\n"
        hits = np.array(places(raw, exact, patterns), np.int64).reshape(-1, 3)
        if not len(hits):
            continue
        first = np.cumsum([0] + [len(t) + 1 for t in rows])
        owner = np.searchsorted(first, hits[:, 0], "right") - 1
        at = np.unique(np.concatenate([hits[:, 0], hits[:, 2], first[owner]]))
        cp = _code_points(np.frombuffer(raw, np.uint8), at)

        def place(x):
            return cp[np.searchsorted(at, x)] - cp[np.searchsorted(at, first[owner])]

        out.append(np.stack([owner + part.start, hits[:, 1], place(hits[:, 0]), place(hits[:, 2])], axis=1))
    return np.concatenate(out)


def scan(docs: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",), allow: Iterable[str] = (),
         allow_patterns: Iterable[str] = ()) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns and ``secrets``, an
    array of (kind, start, end, base), ordered by start and kind. ``allow``
    and ``allow_patterns`` (regular expressions for whole runs) extend the
    allow list; they travel with the tasks, so they must be small."""
    return _scan(docs, text, list(keep), *_allow_list(allow, allow_patterns)).select("row.*", "secrets")


def _allow_list(allow: Iterable[str] = (), allow_patterns: Iterable[str] = ()) -> tuple[frozenset[bytes], bytes]:
    patterns = (*ALLOWED, *(p.encode("utf-8") for p in allow_patterns))
    return frozenset(a.encode("utf-8") for a in allow), b"|".join(b"(?:" + p + b")" for p in patterns)


def _scan(docs: DataFrame, text: str, keep: list[str], exact: frozenset[bytes], both: bytes) -> DataFrame:
    """(row, secrets): the kept columns as a struct, and what is found."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([d.schema["row"], T.StructField("secrets", SPAN)])

    def run(batches):
        patterns = re.compile(both, re.DOTALL)
        names = np.array(KINDS, object)
        for rb in batches:
            hits = _batch_spans([encode(t) for t in rb.column("text").to_pylist()], exact, patterns)
            offsets = np.searchsorted(hits[:, 0], np.arange(rb.num_rows + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array(names[hits[:, 1]], pa.string()), pa.array(hits[:, 2]), pa.array(hits[:, 3]),
                 pa.array(hits[:, 1] < len(BASE_KINDS))], ["kind", "start", "end", "base"])
            yield pa.RecordBatch.from_arrays(
                [rb.column("row"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["row", "secrets"])

    return d.mapInArrow(run, schema)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_found (spans that the method added)."""
    d = scan(docs, **kw)

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["base"])
    return d.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(spans_text(base), 256).alias("base_sha256"),
                    spans_text(F.col("secrets")).alias("spans"),
                    F.size(F.filter("secrets", lambda s: ~s["base"])).cast("long").alias("n_found"))


def redact(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; overlapping
    spans become one, named after the first. Null texts stay null."""
    columns, text = docs.columns, F.col("row.text")
    d = _scan(docs, "text", columns, *_allow_list(**kw))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        gap = F.when(s["start"] > acc["at"], F.substring(text, (acc["at"] + 1).cast("int"),
                                                         (s["start"] - acc["at"]).cast("int"))).otherwise("")
        name = F.when((s["start"] >= acc["at"]) | (acc["at"] == 0),
                      F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], gap, name).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate("secrets", start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.size("secrets") > 0, masked).otherwise(text)
    return d.select(*[new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])
