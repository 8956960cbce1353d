"""Secrets in texts: fixed patterns, and strings whose characters look random.

The base kinds are assignments of passwords and tokens, access keys, and long hexadecimal runs. The method adds spans of
kind ``entropy``: candidates are strings of at least ``SHORTEST`` letters, digits and ``+/_=-`` that hold a digit and a
letter. The Shannon entropy of every window of ``WINDOW`` characters is kept up as the window moves: only the counts of
the character that leaves and of the one that enters change, so a step updates the sum of ``c log2 c`` by two terms. The
span runs from the first to the last window whose entropy reaches the threshold of the candidate's character class.
Allow-listed candidates (UUIDs, dates and versions, words of examples, paths of plain words) are left out, as are those
that overlap a base span.

Everything is column expressions. Matches come from one regular expression pass, and a split by the same pattern gives
the text between them, so their places are running sums of lengths. Sums run over chunks of matches, and base spans are
looked up by blocks of the text, so the time for a text does not grow with the square of its matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import query, table, whole_text

# fixed values: the base patterns of the contract
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_WORDS = "password|passwd|secret|token|api_?key"
SHORTEST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = SHORTEST = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Long candidates are cut into parts that share ``WINDOW - 1`` characters, as access to a character takes time that
#: grows with its place.
PART = 512
#: Character classes by their alphabets, and the entropy (bits) a window has to reach; 4.32 is the most for 20 characters.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[0-9a-z+/_=-]+$|^[0-9A-Z+/_=-]+$", 3.5), (r"", 3.8))
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-].*)?$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{8}|0{8}|1234567890|0123456789|abcdefghij",
    r"^[A-Za-z/_=+-]*[0-9]{0,4}$",
    r"^(?:[A-Za-z]+[0-9]{0,4}[/_=+-]+)*+[A-Za-z]*[0-9]{0,4}$",  # possessive: no stack frame for each part
)

_XLOGX = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = "struct<start:int,kind:int,end:int,text:string>"
#: Matches whose places are added up at once, and code points of a block.
CHUNK, BLOCK = 256, 4096


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(gaps: Column, matches: Column, kind: int, valid) -> Column:
    """Array of (start, kind, end, text) of the matches that are ``valid``, in code points, the end exclusive. ``gaps`` is
    what stands before each match."""
    none = F.array().cast(f"array<{_FOUND}>")

    def chunk(pairs):  # spans counted from the end of the chunk before, and the length of the chunk
        def step(state, pair):
            def found(start):
                end = start + F.char_length(pair["match"])
                span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["match"].alias("text"))
                return F.struct(F.when(valid(pair["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"), end.alias("at"))

            return let(state["at"] + F.char_length(pair["gap"]), found)

        return F.aggregate(pairs, F.struct(none.alias("spans"), F.lit(0).alias("at")), step)

    def whole(pairs):
        at = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))

        def shifted(state, part):
            moved = F.transform(part["spans"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + state["at"]).alias("end"), x["text"].alias("text")))
            return F.struct(F.concat(state["spans"], moved).alias("spans"), (state["at"] + part["at"]).alias("at"))

        return F.aggregate(F.transform(at, lambda i: chunk(F.slice(pairs, i, F.lit(CHUNK)))), F.struct(none.alias("spans"), F.lit(0).alias("at")), shifted)["spans"]

    return let(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match")), whole)


def _split(text: Column, pattern: str, maybe: Column = None) -> tuple[Column, Column]:
    """What stands before each match (and after the last one), and the matches; none unless ``maybe`` holds."""
    none = F.array().cast("array<string>")
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return (gaps, matches) if maybe is None else (F.when(maybe, gaps).otherwise(none), F.when(maybe, matches).otherwise(none))


def overlapping(spans: Column, last: Column):
    """A test whether a span overlaps one of ``spans``, which are dealt to the blocks of the text they touch."""

    def build(body):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")),
            lambda b: F.filter(spans, lambda x: (x["start"] < (b + 1) * BLOCK) & (x["end"] > b * BLOCK)),
        )

        def test(known):
            touches = lambda s, b: F.exists(F.element_at(known, b + 1), lambda x: (x["start"] < s["end"]) & (x["end"] > s["start"]))
            return body(lambda s: F.exists(F.sequence(F.floor(s["start"] / BLOCK).cast("int"), F.floor((s["end"] - 1) / BLOCK).cast("int")), lambda b: touches(s, b)))

        return let(blocks, test)

    return build


def _xlogx(count: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in _XLOGX]), count + 1)


def _count(char: Column, window: Column) -> Column:
    return F.char_length(window) - F.char_length(F.replace(window, char))


def hot_range(part: Column, threshold: Column) -> Column:
    """(first, last): offsets of the first and last window of ``part`` whose entropy reaches the threshold, or nulls."""
    first_window = F.substring(part, 1, WINDOW)
    chars = F.array_distinct(F.split(first_window, ""))
    start = F.aggregate(chars, F.lit(0.0), lambda s, c: s + _xlogx(_count(c, first_window)))
    entropy = lambda s: F.lit(math.log2(WINDOW)) - s / WINDOW
    none = F.lit(None).cast("int")

    def begin(total):
        hot = F.when(entropy(total) >= threshold, F.lit(0)).otherwise(none)
        return F.struct(total.alias("s"), hot.alias("first"), hot.alias("last"))


    def step(state, i):  # the window moves to offset i; ``before`` is the one it leaves, with the entering character
        def counted(before):
            window, out, new = F.substring(before, 1, WINDOW), F.substring(before, 1, 1), F.substring(before, WINDOW + 1, 1)
            return F.when(out == new, state["s"]).otherwise(let(F.struct(_count(out, window).alias("a"), _count(new, window).alias("b")), lambda n: state["s"] - _xlogx(n["a"]) + _xlogx(n["a"] - 1) - _xlogx(n["b"]) + _xlogx(n["b"] + 1)))

        def moved(s):
            high = entropy(s) >= threshold - 1e-9
            return F.struct(s.alias("s"), F.when(high & state["first"].isNull(), i).otherwise(state["first"]).alias("first"), F.when(high, i).otherwise(state["last"]).alias("last"))

        return let(let(F.substr(part, i, F.lit(WINDOW + 1)), counted), moved)

    moves = F.char_length(part) - WINDOW
    steps = F.when(moves > 0, F.sequence(F.lit(1), F.greatest(moves, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, let(start, begin), step, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))


def random_range(candidate: Column) -> Column:
    """(first, last) over all windows of a candidate."""
    limit = F.lit(CLASSES[-1][1])
    for pattern, value in reversed(CLASSES[:-1]):
        limit = F.when(F.rlike(candidate, F.lit(pattern)), F.lit(value)).otherwise(limit)
    return let(limit, lambda threshold: _hot_parts(candidate, threshold))


def _hot_parts(candidate: Column, threshold: Column) -> Column:
    step = PART - WINDOW + 1
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(candidate) - WINDOW, F.lit(0)), F.lit(step))

    def part(at):
        moved = lambda found: F.struct((found["first"] + at).alias("first"), (found["last"] + at).alias("last"))
        return let(F.substr(candidate, at + 1, F.lit(PART)), lambda p: let(hot_range(p, threshold), moved))

    both = lambda found: F.struct(F.array_min(F.transform(found, lambda x: x["first"])).alias("first"), F.array_max(F.transform(found, lambda x: x["last"])).alias("last"))
    return let(F.transform(starts, part), both)


def _suspicious(candidate: Column) -> Column:
    keep = F.rlike(candidate, F.lit("[0-9]")) & F.rlike(candidate, F.lit("[A-Za-z]"))
    for pattern in ALLOWED:
        keep = keep & ~F.rlike(candidate, F.lit(pattern))
    return keep


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``_fl_base`` and ``_fl_random``: arrays of (start, kind, end) of the base kinds and of
    the spans the method adds. Null texts are empty; a text may be of any length and hold any number of matches."""
    rows = docs.withColumn("_fl_text", whole_text(text))
    body, low = F.col("_fl_text"), F.lower(F.col("_fl_text"))
    assigned = F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    patterns = [(ASSIGN, assigned), (ACCESS, F.contains(body, F.lit("AKIA"))), (HEX, None), (CANDIDATE, None)]
    work = {}
    for i, (pattern, maybe) in enumerate(patterns):
        work[f"_fl_gap{i}"], work[f"_fl_match{i}"] = _split(body, pattern, maybe)
    rows = rows.withColumns(work)
    long_enough = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= SHORTEST_VALUE
    always = lambda m: F.lit(True)
    found = [places(F.col(f"_fl_gap{i}"), F.col(f"_fl_match{i}"), i, valid) for i, valid in enumerate((long_enough, always, always, _suspicious))]
    plain = lambda spans: F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end")]))
    rows = rows.withColumn("_fl_base", plain(F.concat(*found[:3]))).withColumn("_fl_found", found[3])

    def narrowed(s):
        span = lambda hot: F.struct((s["start"] + hot["first"]).alias("start"), s["kind"].alias("kind"), (s["start"] + hot["last"] + WINDOW).alias("end"))
        return let(random_range(s["text"]), span)

    hot = lambda spans: F.filter(F.transform(spans, narrowed), lambda s: s["start"].isNotNull())
    last = F.greatest(F.array_max(F.transform("_fl_found", lambda s: s["end"])), F.lit(0))
    apart = overlapping(F.col("_fl_base"), last)(lambda test: F.filter("_fl_found", lambda s: ~test(s)))
    random = F.when(F.size("_fl_base") > 0, let(apart, hot)).otherwise(hot(F.col("_fl_found")))
    rows = rows.withColumn("_fl_random", F.when(F.size("_fl_found") > 0, random).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return rows.drop("_fl_text", "_fl_found", *work)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, the numbers of base spans by kind, the hash of the base spans, and all spans as text
    (``kind:start:end``, comma-joined by start, then kind)."""
    rows = secret_spans(docs.select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("_fl_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")
    return rows.select("doc_id", number(0), number(1), number(2), F.sha2(_listed(F.col("_fl_base")), 256).alias("base_sha256"), _listed(F.concat("_fl_base", "_fl_random")).alias("spans"))


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(table(spark, sf_dir, "documents"))
