"""Order of versions and ranges of versions as npm reads them, as column expressions.

A version becomes a key, a struct that compares as versions do: numbers first, a release above its pre-releases, and
pre-releases by their parts (numbers below words, numbers by value, words by their characters, the shorter of two alike
first). A range becomes alternatives, each a list of comparisons with such keys. Nothing leaves the JVM, so both can
stand in joins, filters and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRE = "array<struct<word:boolean,number:decimal(38,0),text:string>>"
KEY = f"struct<major:bigint,minor:bigint,patch:bigint,release:boolean,pre:{_PRE}>"
TERM = f"struct<op:int,key:{KEY}>"
_PART = "(?:[0-9]+|[xX*])"
_VERSION = r"^\s*[v=]*\s*([0-9]{1,15})\.([0-9]{1,15})\.([0-9]{1,15})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
# operator, numbers or x, pre-release
_TERM = rf"^(\^|~>?|>=|<=|>|<|=)?[v=]*(?:({_PART})(?:\.({_PART})(?:\.({_PART})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?)?)?)?$"
AT_LEAST, ABOVE, BELOW, AT_MOST, EQUAL, NEVER = range(6)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group of a match, null if it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _pre(text: Column) -> Column:
    def part(p):
        number = F.rlike(p, F.lit("^[0-9]+$"))
        return F.struct((~number).alias("word"), F.when(number, p.try_cast("decimal(38,0)")).alias("number"), F.when(~number, p).alias("text"))

    return F.when(text.isNull(), F.array().cast(_PRE)).otherwise(F.transform(F.split(text, r"\."), part).cast(_PRE))


def key_of(major: Column, minor: Column, patch: Column, pre: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if pre is None else pre
    return F.struct(
        major.cast("bigint").alias("major"), minor.cast("bigint").alias("minor"), patch.cast("bigint").alias("patch"),
        text.isNull().alias("release"), _pre(text).alias("pre"),
    )


def precedence(version: Column) -> Column:
    """The key of a version; null for text that is no version. Build metadata does not count."""
    group = lambda i: F.regexp_extract(version, _VERSION, i)
    return F.when(F.rlike(version, F.lit(_VERSION)), key_of(group(1), group(2), group(3), _group(version, _VERSION, 4)))


def _terms(term: Column) -> Column:
    """The comparisons one term stands for; null for text that is no term."""
    op = F.regexp_extract(term, _TERM, 1)
    number = lambda i: _group(F.regexp_replace(F.regexp_extract(term, _TERM, i), "[xX*]", ""), "^(.*)$", 1).cast("bigint")
    parsed = F.struct(op.alias("op"), number(2).alias("a"), number(3).alias("b"), number(4).alias("c"), _group(term, _TERM, 5).alias("pre"))

    def compared(t):
        zero = F.lit(0)
        a, b, c = t["a"], t["b"], t["c"]
        b = F.when(a.isNotNull(), b)  # what follows an x counts as x
        c = F.when(b.isNotNull(), c)
        pre = F.when(c.isNotNull(), t["pre"])
        own = key_of(a, F.coalesce(b, zero), F.coalesce(c, zero), pre)
        before = lambda x, y, z: key_of(x, y, z, F.lit("0"))  # noqa: E731  (below all pre-releases of the version)
        term_ = lambda kind, key: F.struct(F.lit(kind).alias("op"), key.alias("key")).cast(TERM)
        of = lambda *x: F.array(*x)
        following = F.when(b.isNull(), before(a + 1, zero, zero)).otherwise(before(a, b + 1, zero))  # after an x-range
        nothing, everything = of(term_(NEVER, own)), F.array().cast(f"array<{TERM}>")
        caret = (
            F.when(b.isNull() | (a > 0), before(a + 1, zero, zero))
            .when(c.isNull() | (b > 0), before(a, b + 1, zero))
            .otherwise(before(a, b, c + 1))
        )
        partial = c.isNull()
        return (
            F.when(a.isNull(), F.when(t["op"].isin("<", ">"), nothing).otherwise(everything))
            .when(t["op"] == "^", of(term_(AT_LEAST, own), term_(BELOW, caret)))
            .when(t["op"].startswith("~"), of(term_(AT_LEAST, own), term_(BELOW, following)))
            .when(t["op"] == ">", F.when(partial, of(term_(AT_LEAST, F.when(b.isNull(), key_of(a + 1, zero, zero)).otherwise(key_of(a, b + 1, zero))))).otherwise(of(term_(ABOVE, own))))
            .when(t["op"] == ">=", of(term_(AT_LEAST, own)))
            .when(t["op"] == "<", of(term_(BELOW, F.when(partial, before(a, F.coalesce(b, zero), zero)).otherwise(own))))
            .when(t["op"] == "<=", F.when(partial, of(term_(BELOW, following))).otherwise(of(term_(AT_MOST, own))))
            .when(partial, of(term_(AT_LEAST, own), term_(BELOW, following)))
            .otherwise(of(term_(EQUAL, own)))
        )

    return F.when(F.rlike(term, F.lit(_TERM)), let(parsed, compared))


def range_terms(text: Column) -> Column:
    """Alternatives of a range, each an array of (op, key); null if any part of it is no range (a tag, a URL, a path)."""
    hyphens = F.regexp_replace(text, r"(?:^|(?<=\|))\s*([^\s|]+)\s+-\s+([^\s|]+)\s*(?=\||$)", " >=$1 <=$2 ")
    close = F.regexp_replace(hyphens, r"(\^|~>?|>=|<=|>|<|=)\s+", "$1")

    def alternative(part):
        words = F.split(F.trim(part), r"\s+")
        return let(F.transform(words, _terms), lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.flatten(t)))

    return let(F.transform(F.split(close, r"\|\|"), alternative), lambda found: F.when(~F.exists(found, lambda x: x.isNull()), found))


def in_terms(key: Column, alternatives: Column) -> Column:
    """Whether the version of ``key`` is in a range of ``range_terms``; null if either is null. A pre-release needs a term
    of its own numbers that names a pre-release."""

    def holds(t):
        k = t["key"]
        return (
            F.when(t["op"] == AT_LEAST, key >= k).when(t["op"] == ABOVE, key > k).when(t["op"] == BELOW, key < k)
            .when(t["op"] == AT_MOST, key <= k).when(t["op"] == EQUAL, key == k).otherwise(False)
        )

    def named(t):
        k = t["key"]
        return ~k["release"] & (k["major"] == key["major"]) & (k["minor"] == key["minor"]) & (k["patch"] == key["patch"])

    inside = F.exists(alternatives, lambda terms: F.forall(terms, holds) & (key["release"] | F.exists(terms, named)))
    return F.when(key.isNotNull() & alternatives.isNotNull(), inside)


def satisfies(version: Column, range_: Column) -> Column:
    """Whether a version is in a range; null if the version or the range cannot be read."""
    return let(F.struct(precedence(version).alias("key"), range_terms(range_).alias("terms")), lambda x: in_terms(x["key"], x["terms"]))


def base_version(range_: Column) -> Column:
    """The version a declared range starts from: of ``^1.2.3``, ``~1.2.3``, ``>=1.2.3 <2`` or ``1.2.3`` the version 1.2.3;
    missing numbers are 0. Null if it starts with no version."""
    pattern = r"^\s*(?:\^|~>?|>=|=)?\s*[v=]*([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:\.[xX*])*(-[0-9A-Za-z.-]+)?(?=[\s+|]|$)"
    group = lambda i: F.coalesce(_group(range_, pattern, i), F.lit("0"))
    return F.when(F.rlike(range_, F.lit(pattern)), F.concat(group(1), F.lit("."), group(2), F.lit("."), group(3), F.regexp_extract(range_, pattern, 4)))


def drift_class(from_: Column, to: Column) -> Column:
    """``major``, ``minor``, ``patch`` or ``prerelease``: the first place where the key ``from_`` is behind ``to``;
    ``none`` if it is not behind."""
    return (
        F.when(from_.isNull() | to.isNull(), F.lit(None).cast("string"))
        .when(from_ >= to, "none")
        .when(from_["major"] < to["major"], "major")
        .when(from_["minor"] < to["minor"], "minor")
        .when(from_["patch"] < to["patch"], "patch")
        .otherwise("prerelease")
    )
