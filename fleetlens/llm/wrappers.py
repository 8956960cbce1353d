"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a row of tags and text slots. Adjacent equal runs fold into repeated groups. Pages of one host are aligned one
after another: what matches stays, texts that differ make a slot, and runs that stand on one side only become optional
(markers of a repeated group too, so a group may occur once). The result, the wrapper, is a sequence of tags, slots,
repeated groups and optional parts, and knows for each slot how many pages have it, whether its text is always the same,
and how much text that is not links it holds in each part of the pages that have no article.

The main text of a page is all its text, aligned or not, without what on this page stands in boilerplate elements
(menus, headers, footers, sidebars, notices, adverts, forms, comments) or outside its article (a page without one: outside
that of its parts with most such text on the pages of the host). Only on a page without an article is a repeated text
dropped as a notice: one of a block, no heading, the same on nearly all of ``MANY`` or more different pages of the host,
if all such texts together are less than the text that differs (so not on copies of one page).

Every task folds its pages of a host into one wrapper, so a host with many pages sends one row per task; these are
folded by host again. All pages take part.
"""

from __future__ import annotations

import json
import re
import zlib
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import cut_lineage, map_batches, query, table, whole_text

MANY = 10
NEARLY = 0.9
LONGEST_RUN = 12
FOLD_AT = 64

# fixed values: elements of HTML and names that mark boilerplate
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object textarea select".split())
ASIDE = frozenset("head nav footer aside form button menu dialog".split())
MARKED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-bar|menu|nav(?:bar|igation)?|breadcrumbs?|"
    r"header|masthead|footer|comments?|comment-list|disqus|replies|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|widget)(?:$|[\s_-])"
)
ARTICLE = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def tokens(html: str) -> list[tuple[str, str]]:
    """(signature, text) of tags (text is empty) and of texts (signature ``#``); hidden elements are dropped."""
    out, at = [], 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text = html[at : m.start()]
            if not text.isspace():
                out.append(("#", text))
            elif out and out[-1][0] == "#":
                out[-1] = ("#", out[-1][1] + " ")
        at = m.end()
        tag = m.group()
        name = _NAME.match(tag)
        if m.group(1) or not name:
            continue
        low = name.group(1).lower()
        if tag[1] == "/":
            out.append((f"</{low}>", ""))
        else:
            marks = " ".join(sorted(a or b or c for _, a, b, c in _MARK.findall(tag))) if "=" in tag else ""
            out.append((f"<{low} {marks}>" if marks else f"<{low}>", ""))
    if at < len(html) and not html[at:].isspace():
        out.append(("#", html[at:]))
    return out


def paths(page: list[tuple[str, str]]) -> list[str | None]:
    """For each text the open elements around it that are not inline, and ``a`` for links; None for tags."""
    open_: list[tuple[str, str]] = []
    out: list[str | None] = []
    for sig, _ in page:
        if sig == "#":
            out.append("|".join(s for n, s in open_ if n not in INLINE or n == "a"))
            continue
        out.append(None)
        name = sig.strip("</>").split(" ", 1)[0]
        if sig[1] == "/":
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
        elif name not in VOID:
            if name not in INLINE and open_ and open_[-1][0] == "p" and name != "p":
                open_.pop()
            if name == "p":
                while open_ and (open_[-1][0] == "p" or open_[-1][0] in INLINE):
                    open_.pop()
            open_.append((name, sig[1:-1]))
    return out


def folded(signatures: list[str]) -> tuple[list[str], list[int]]:
    """The row with repeated runs as ``( ... )+``, and for each signature its place in the result."""
    # nodes: (key, signature or None, children, members); members are the places of the input
    nodes: list[list] = []
    keys: list = []
    for i, s in enumerate(signatures):
        nodes.append([s, None, [i]])
        keys.append(s)
        again = True
        while again:
            again = False
            last = keys[-1]
            for n in range(1, min(LONGEST_RUN, len(nodes) - 1) + 1):
                before = nodes[-n - 1]
                if before[1] is None and before[0] != last:
                    continue
                if before[1] is not None and len(before[1]) == n and keys[-n:] == [c[0] for c in before[1]]:  # one more of a group
                    for c, x in zip(before[1], nodes[-n:], strict=True):
                        _join(c, x)
                    del nodes[-n:], keys[-n:]
                    again = True
                    break
                if before[0] == last and 2 * n <= len(nodes) and keys[-n:] == keys[-2 * n : -n] and not (n == 1 and nodes[-1][1] is not None) and _whole(keys[-n:]):
                    run, twin = nodes[-2 * n : -n], nodes[-n:]
                    for c, x in zip(run, twin, strict=True):
                        _join(c, x)
                    del nodes[-2 * n :], keys[-2 * n :]
                    key = ("+", tuple(c[0] for c in run))
                    nodes.append([key, run, None])
                    keys.append(key)
                    again = True
                    break
    out: list[str] = []
    place = [0] * len(signatures)
    _flatten(nodes, out, place)
    return out, place


def _whole(run: list) -> bool:
    """Whether a run begins with a tag that opens and closes none that it has not opened: of the turns of a repeated run
    only the one that follows the elements is folded."""
    if run[0] == "#" or (isinstance(run[0], str) and run[0].startswith("</")):
        return False
    depth = 0
    for key in run:
        if isinstance(key, str) and key != "#":
            depth += -1 if key.startswith("</") else key.strip("<>").split(" ", 1)[0] not in VOID
            if depth < 0:
                return False
    return True


def _join(a: list, b: list) -> None:
    if a[1] is None:
        a[2] += b[2]
    else:
        for c, x in zip(a[1], b[1], strict=True):
            _join(c, x)


def _flatten(nodes: list, out: list[str], place: list[int]) -> None:
    for key, children, members in nodes:
        if children is None:
            for i in members:
                place[i] = len(out)
            out.append(key)
        else:
            out.append("(")
            _flatten(children, out, place)
            out.append(")+")


def skeleton(html: str) -> tuple[list[tuple[str, str]], list[str], list[int]]:
    page = tokens(html)
    row, place = folded([s for s, _ in page])
    return page, row, place


# a slot: [pages, least text hash, greatest text hash, characters that are not links by part of the page, hashes of up to MANY pages]


def _text_hash(text: str) -> int:
    return zlib.crc32(" ".join(text.split()).encode("utf-8", "replace"))


def _slot(texts: list[str], mass: dict[str, int], page: int) -> list:
    hashes = [_text_hash(t) for t in texts]
    return [1, min(hashes), max(hashes), mass, [page]]


def _merged(a: list, b: list) -> list:
    mass = {r: a[3].get(r, 0) + b[3].get(r, 0) for r in {**a[3], **b[3]}}
    return [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), mass, sorted({*a[4], *b[4]})[:MANY]]


def page_wrapper(html: str) -> list[list]:
    """The wrapper of one page: nodes [signature, optional, slot or None]."""
    page, row, place = skeleton(html)
    number, where = zlib.crc32(html.encode("utf-8", "replace")), paths(page)
    plain = [path is not None and not _boilerplate(path) for path in where]
    article = any(p and _in_article(path) for p, path in zip(plain, where, strict=True))
    texts: dict[int, tuple[list, dict]] = {}
    for i, (sig, text) in enumerate(page):
        if sig == "#":
            own, mass = texts.setdefault(place[i], ([], {}))
            own.append(text)
            if plain[i] and not article:
                mass[_region(where[i])] = mass.get(_region(where[i]), 0) + (-len(text) if _link(where[i]) else len(text))
    return [[s, False, _slot(*texts[i], number) if i in texts else None] for i, s in enumerate(row)]


def align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of places that match, and single places of either side, in order."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    out, i, j = [], 0, 0
    for x, y, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        out += [(k, None) for k in range(i, x)] + [(None, k) for k in range(j, y)] + [(x + k, y + k) for k in range(n)]
        i, j = x + n, y + n
    return out


def merge(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for the pages of both."""
    out = []
    for i, j in align([n[0] for n in a], [n[0] for n in b]):
        if i is None or j is None:
            sig, _, slot = a[i] if j is None else b[j]
            out.append([sig, True, slot])
        else:
            x, y = a[i], b[j]
            out.append([x[0], x[1] or y[1], x[2] and y[2] and _merged(x[2], y[2]) or x[2] or y[2]])
    return out


def expression(wrapper: list[list]) -> str:
    """The wrapper as text: ``?`` after optional nodes."""
    return "".join(f"{s}?" if optional and s not in "()+" else s for s, optional, _ in wrapper)


class HostWrapper:
    """Folds the pages of a host; equal skeletons first, as most pages share one."""

    def __init__(self):
        self.by_row: dict[tuple, list[list]] = {}

    def add(self, wrapper: list[list]) -> None:
        key = tuple(n[0] for n in wrapper)
        old = self.by_row.get(key)
        self.by_row[key] = wrapper if old is None else merge(old, wrapper)
        if len(self.by_row) > FOLD_AT:
            one = self.result()
            self.by_row = {tuple(n[0] for n in one): one}

    def result(self) -> list[list]:
        rows = [self.by_row[k] for k in sorted(self.by_row, key=lambda k: (-len(k), k))]
        out = rows[0]
        for w in rows[1:]:
            out = merge(out, w)
        return out


@lru_cache(10_000)
def _boilerplate(path: str) -> bool:
    inside = False
    for part in path.split("|"):
        name, _, marks = part.partition(" ")
        if name in HIDDEN or name in ASIDE or (name == "header" and not inside):
            return True
        if name in ARTICLE or marks == "main":
            inside = True
            continue
        if name not in ("body", "html", "a") and marks and MARKED.search(marks):
            return True
    return False


@lru_cache(10_000)
def _in_article(path: str) -> bool:
    return any(p.split(" ", 1)[0] in ARTICLE or p.endswith(" main") for p in path.split("|"))


def _region(path: str) -> str:
    """html, body and the part below."""
    return "|".join(path.split("|")[:3])


def _link(path: str) -> bool:
    return any(part == "a" or part.startswith("a ") for part in path.split("|"))


def _alone(wrapper: list[list], i: int, step: int) -> bool:
    """Whether the next tag on that side is one of a block, so the slot does not share its block with other text."""
    i += step
    while 0 <= i < len(wrapper) and wrapper[i][0] in ("(", ")+"):
        i += step
    if not 0 <= i < len(wrapper):
        return True
    return wrapper[i][0] != "#" and wrapper[i][0].strip("</>").split(" ", 1)[0] not in INLINE


def _heading(path: str) -> bool:
    return any(part.split(" ", 1)[0] in HEADING for part in path.split("|"))


def fixed_slots(wrapper: list[list]) -> list[bool]:
    """For each node whether it is a slot whose text is a notice on pages without an article."""
    pages = max((slot[0] for _, _, slot in wrapper if slot), default=0)
    fixed = [
        slot is not None and bool(slot[3]) and slot[1] == slot[2] and len(slot[4]) >= MANY and slot[0] >= NEARLY * pages and _alone(wrapper, i, -1) and _alone(wrapper, i, 1)
        for i, (_, _, slot) in enumerate(wrapper)
    ]
    mass = [sum(slot[3].values()) if slot else 0 for _, _, slot in wrapper]
    differs = sum(m for m, (_, _, slot) in zip(mass, wrapper, strict=True) if slot and slot[1] != slot[2])
    return fixed if differs > sum(m for m, f in zip(mass, fixed, strict=True) if f) else [False] * len(wrapper)


class Extractor:
    """Applies a wrapper; the alignment of a skeleton is worked out once."""

    def __init__(self, wrapper: list[list]):
        self.row, self.fixed, self.known = [n[0] for n in wrapper], fixed_slots(wrapper), {}
        self.text = [slot and slot[1] for _, _, slot in wrapper]
        self.mass: dict[str, int] = {}
        for fixed, (_, _, slot) in zip(self.fixed, wrapper, strict=True):
            for region, size in slot[3].items() if slot and not fixed else ():
                self.mass[region] = self.mass.get(region, 0) + size

    def slots(self, row: list[str]) -> list[int | None]:
        """For each node of a page the node of the wrapper that matches it."""
        key = tuple(row)
        slots = self.known.get(key)
        if slots is None:
            slots = [None] * len(row)
            for i, j in align(self.row, row):
                if i is not None and j is not None:
                    slots[j] = i
            if len(self.known) > 1000:
                self.known = {}
            self.known[key] = slots
        return slots

    def main(self, page: list[tuple[str, str]]) -> list[bool]:
        """For each tag and text of a page whether it is main text."""
        where = paths(page)
        plain = [path is not None and not _boilerplate(path) for path in where]
        inside = [p and _in_article(path) for p, path in zip(plain, where, strict=True)]
        if any(inside):
            return inside
        if any(self.fixed):
            row, place = folded([s for s, _ in page])
            slots = self.slots(row)
            # a text that matches no slot, or one of other text, is no notice
            fixed = [i is not None and self.fixed[i] for i in slots]
            plain = [p and not (fixed[i] and not _heading(path) and _text_hash(text) == self.text[slots[i]]) for p, path, (_, text), i in zip(plain, where, page, place, strict=True)]
        best = max(sorted({_region(path) for p, path in zip(plain, where, strict=True) if p}), key=lambda r: self.mass.get(r, 0), default=None)
        return [p and _region(path) == best for p, path in zip(plain, where, strict=True)]

    def __call__(self, html: str) -> str:
        page = tokens(html)
        keep = self.main(page)
        blocks, parts = [], []
        for (sig, text), own in zip(page, keep, strict=True):
            if sig == "#":
                if own:
                    parts.append(unescape(text) if "&" in text else text)
                continue
            name = sig.strip("</>").split(" ", 1)[0]
            if name == "br":
                parts.append(" ")
            elif name not in INLINE and parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        blocks.append(" ".join("".join(parts).split()))
        return "\n".join(b for b in blocks if b)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` (JSON) of ``pages(url, html)``. Pages without a host share the empty one."""

    def fold_pages(batches):
        hosts: dict[str, HostWrapper] = {}
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                hosts.setdefault(host, HostWrapper()).add(page_wrapper(html))
            if len(hosts) > 2000:  # many small hosts: send what is there
                yield rows({h: w.result() for h, w in hosts.items()})
                hosts = {}
        if hosts:
            yield rows({h: w.result() for h, w in hosts.items()})

    def rows(wrappers: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(wrappers)), pa.array([json.dumps(w) for w in wrappers.values()])], ["host", "wrapper"])

    def fold_wrappers(batches):
        host, one = None, None
        for batch in batches:
            for h, w in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if h != host and one is not None:
                    yield rows({host: one})
                    one = None
                one = json.loads(w) if one is None else merge(one, json.loads(w))
                host = h
        if one is not None:
            yield rows({host: one})

    first = pages.select(host_of().alias("host"), whole_text("html").alias("html")).mapInArrow(fold_pages, "host string, wrapper string")
    return first.repartition("host").sortWithinPartitions("host", F.length("wrapper").desc(), "wrapper").mapInArrow(fold_wrappers, "host string, wrapper string")


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``pages(page_id, url, html)``.

    A null page is empty and has an empty text, as has one without main text. Rows may be repeated and ids null.
    """
    wrappers = cut_lineage(host_wrappers(pages), "wrappers")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        extractors: dict[str, Extractor] = {}
        for host, html, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
            if host not in extractors:
                extractors[host] = Extractor(json.loads(wrapper))
            texts.append(extractors[host](html))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", host_of().alias("host"), whole_text("html").alias("html")).join(wrappers, "host")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_batches(rows, work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))
