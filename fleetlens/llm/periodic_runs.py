"""Periodic runs of words by a Re-Pair grammar.

Words are numbered, and the most frequent pairs of neighbours are replaced by new symbols, round by round: in a round
every place is replaced whose pair is more frequent than the pairs it overlaps, so frequent pairs go first as in Re-Pair
and a round costs a few passes over arrays. What remains of a text when no pair repeats is halved again and again (the
start rule as a balanced tree). The texts of a slice share one grammar.

A run lies in the text of some smallest symbol and crosses the boundary between the two symbols of its rule. It has at
least ``EXPONENT`` = 4 periods, so two of them lie on one side of the boundary: a period ``q`` between 2^k and 2^(k+1) is
seen from the boundary as a block of 2^k words that stands again ``q`` words on. Candidates are extended to both sides by
doubling block hashes. This is done once for each rule, at one place where it stands, and the found intervals are moved
to all places where the rule stands. Intervals of one period that lie in another one are parts of it, cut by the borders
of their symbol; of equal intervals the least period counts.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import GOLD, map_batches, mix, query, slices, table, whole_text

SHORTEST, EXPONENT = 6, 4
#: Text bytes that share a grammar (a longer text has one of its own), and candidate places looked at in one step.
GRAMMAR_BYTES, PLACES = 1 << 21, 1 << 21
_COUNTERS = 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Grammar:
    """Rules of a slice: ``size`` and ``left`` (words of a symbol and of its left part), and where each symbol stands."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.terminals = int(words.max()) + 1 if len(words) else 0
        self.size = np.ones(self.terminals, dtype=np.int64)
        self.left = np.zeros(self.terminals, dtype=np.int64)
        self.names = np.empty(0, np.int64), np.empty(0, np.int64)  # pairs, sorted, and their symbols
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.symbol, self.at = words.astype(np.int64), np.arange(len(words))
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        while self._replace():
            pass

    def _replace(self) -> bool:
        """One round; false when it no longer shortens the texts by a hundredth."""
        if len(self.symbol) < 2:
            return False
        a, b = self.symbol[:-1], self.symbol[1:]
        inside = self.text[:-1] == self.text[1:]
        equal = inside & (a == b)
        if equal.any():  # in a row of equal symbols every other place
            order = np.arange(len(a))
            start = np.maximum.accumulate(np.where(equal & ~np.append(False, equal[:-1]), order, -1))
            inside &= ~equal | ((order - start) % 2 == 0)
        pair = (a << 32) | b
        name = mix(pair.view(np.uint64))
        counter = (name >> np.uint64(64 - _COUNTERS)).astype(np.int64)
        count = np.bincount(counter[inside], minlength=1 << _COUNTERS)[counter]
        rank = np.where(inside & (count > 1), (count.astype(np.uint64) << np.uint64(40)) | (name & np.uint64((1 << 40) - 1)), np.uint64(0))
        best = rank > 0
        best[1:] &= rank[1:] > rank[:-1]
        best[:-1] &= rank[:-1] > rank[1:]
        places = np.flatnonzero(best)
        if not len(places):
            return False
        symbols = self._name(pair[places])
        self.seen.append((symbols, self.at[places]))
        self.symbol[places] = symbols
        keep = np.ones(len(self.symbol), dtype=bool)
        keep[places + 1] = False
        self.symbol, self.at, self.text = self.symbol[keep], self.at[keep], self.text[keep]
        return 100 * len(places) > len(keep)

    def _name(self, pair: np.ndarray) -> np.ndarray:
        """The symbols of pairs; a pair keeps the symbol of an earlier round."""
        pairs, back = np.unique(pair, return_inverse=True)
        known, symbols = self.names
        at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
        old = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
        out = np.empty(len(pairs), np.int64)
        out[old] = symbols[at[old]]
        new = pairs[~old]
        out[~old] = len(self.size) + np.arange(len(new))
        left, right = new >> 32, new & ((1 << 32) - 1)
        self.left = np.append(self.left, self.size[left])
        self.size = np.append(self.size, self.size[left] + self.size[right])
        known, symbols = np.append(known, new), np.append(symbols, out[~old])
        order = np.argsort(known)
        self.names = known[order], symbols[order]
        return out[back]

    def nodes(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, boundary and end of one place of every rule and of every node of the start rules, and the symbol (-1)."""
        empty = np.empty(0, np.int64)
        self.places = tuple(np.concatenate([empty, *(x[i] for x in self.seen)]) for i in (0, 1))
        order = np.argsort(self.places[0], kind="stable")
        self.places = self.places[0][order], self.places[1][order]
        symbol, first = np.unique(self.places[0], return_index=True)
        at = self.places[1][first]
        parts = [(at, at + self.left[symbol], at + self.size[symbol], symbol)]
        count = np.bincount(self.text, minlength=len(offsets) - 1)
        base = np.cumsum(count) - count
        half = 1
        while half < (count.max() if len(count) else 0):
            number = np.maximum(-(-(count - half) // (2 * half)), 0)
            text = np.repeat(np.arange(len(count)), number)
            begin = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * 2 * half
            stop = np.minimum(begin + 2 * half, count[text])
            whole = stop == count[text]
            end = np.where(whole, offsets[text + 1], self.at[np.where(whole, 0, base[text] + stop)])
            parts.append((self.at[base[text] + begin], self.at[base[text] + begin + half], end, np.full(len(text), -1)))
            half *= 2
        start, middle, end, symbol = (np.concatenate([p[i] for p in parts]) for i in range(4))
        long_ = end - start >= SHORTEST
        return start[long_], middle[long_], end[long_], symbol[long_]


def block_hashes(words: np.ndarray, largest: int) -> list[np.ndarray]:
    """For each k, hashes of the 2^k words from each place, up to 2^k = ``largest``."""
    out = [mix((words.astype(np.uint64) + np.uint64(1)) * GOLD)]
    while 2 << (len(out) - 1) <= min(largest, len(words)):
        step = 1 << (len(out) - 1)
        out.append(mix(out[-1][:-step] * GOLD + out[-1][step:]))
    return out


def _common(blocks: list[np.ndarray], x: np.ndarray, y: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """Length, at most ``limit``, of what the words from (or, ``back``, before) places ``x`` and ``y`` have in common."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(len(blocks) - 1, -1, -1):
        step = 1 << k
        todo = np.flatnonzero(out + step <= limit)
        while len(todo):
            move = -out[todo] - step if back else out[todo]
            todo = todo[blocks[k][x[todo] + move] == blocks[k][y[todo] + move]]
            out[todo] += step
            todo = todo[out[todo] + step <= limit[todo]] if k == len(blocks) - 1 else todo[:0]
    return out


def _candidates(blocks: list[np.ndarray], start: np.ndarray, middle: np.ndarray, end: np.ndarray):
    """Chunks of (node, period, first place of two that lie a period apart) where a block at the boundary returns."""
    size = end - start
    for k in range(len(blocks)):
        step = 1 << k
        for back in (False, True):
            room = (middle - start if back else end - middle) // 2
            largest = np.minimum(np.minimum(2 * step - 1, size // EXPONENT), room)
            node = np.flatnonzero(largest >= step)
            number = largest[node] - step + 1
            for part in np.split(np.arange(len(node)), np.flatnonzero(np.diff(np.cumsum(number) // PLACES)) + 1):
                if not len(part):
                    continue
                of, n = node[part], number[part]
                at = np.repeat(of, n)
                q = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + step
                own = np.repeat(blocks[k][middle[of] - (step if back else 0)], n)
                same = blocks[k][middle[at] - q - step if back else middle[at] + q] == own
                at, q = at[same], q[same]
                yield at, q, middle[at] - (q if back else 0)


def _least_period(owner: np.ndarray, begin: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different intervals, each with its least period, sorted by owner, start and period."""
    order = np.lexsort((q, stop, begin, owner))
    owner, begin, stop, q = owner[order], begin[order], stop[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    order = np.lexsort((q[new], begin[new], owner[new]))
    return tuple(x[new][order] for x in (owner, begin, stop, q))


def find_runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of the texts ``words[offsets[i]:offsets[i + 1]]``, by start, then period."""
    grammar = Grammar(words, offsets)
    start, middle, end, symbol = grammar.nodes(offsets)
    found = [tuple(np.empty(0, np.int64) for _ in range(4))]
    if len(start):
        blocks = block_hashes(words, max(1, int((end - start).max()) // EXPONENT))
        for node, q, x in _candidates(blocks, start, middle, end):
            begin = x - _common(blocks, x, x + q, x - start[node], True)
            stop = x + q + _common(blocks, x, x + q, end[node] - x - q, False)
            run = stop - begin >= np.maximum(SHORTEST, EXPONENT * q)
            found.append((node[run], begin[run], stop[run], q[run]))
    node, begin, stop, q = _least_period(*(np.concatenate([f[i] for f in found]) for i in range(4)))
    # to all places of the rules
    name = symbol[node]
    lo, hi = (np.searchsorted(grammar.places[0], name, side=side) for side in ("left", "right"))
    number = np.where(name < 0, 1, hi - lo)
    each = np.repeat(np.arange(len(node)), number)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
    place = np.where(name[each] < 0, start[node[each]], grammar.places[1][np.minimum(lo[each] + nth, len(grammar.places[1]) - 1)] if len(grammar.places[1]) else 0)
    shift = place - start[node[each]]
    begin, stop, q = begin[each] + shift, stop[each] + shift, q[each]
    # of each period the maximal intervals
    order = np.lexsort((-stop, begin, q))
    begin, stop, q = begin[order], stop[order], q[order]
    reach = np.maximum.accumulate(q * (len(words) + 1) + stop) if len(q) else q
    whole = np.ones(len(q), dtype=bool)
    whole[1:] = q[1:] * (len(words) + 1) + stop[1:] > reach[:-1]
    _, begin, stop, q = _least_period(np.zeros(int(whole.sum()), np.int64), begin[whole], stop[whole], q[whole])
    return begin, stop, q


def _runs_of_slice(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.ListArray, list[str]]:
    data = raw.tobytes()
    texts = [data[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]  # at \x20 and \x09 to \x0D
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    every = np.empty(int(at[-1]), dtype=object)
    every[:] = [w for t in texts for w in t]
    words = pd.factorize(every)[0].astype(np.int64)
    begin, stop, q = find_runs(words, at)
    change = np.bincount(begin + q, minlength=len(words) + 1) - np.bincount(stop, minlength=len(words) + 1)
    kept = np.cumsum(change)[: len(words)] == 0
    texts = [t if kept[a:b].all() else list(compress(t, kept[a:b])) for t, a, b in zip(texts, at[:-1], at[1:], strict=True)]
    text = np.searchsorted(at, begin, side="right") - 1
    fields = [pa.array(x, pa.int64()) for x in (begin - at[text], stop - begin, q)]
    runs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), runs), [b" ".join(t).decode() for t in texts]


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``runs`` and ``collapsed`` of every row of ``docs``; other columns are ignored.

    Words are separated by ASCII white space. A run is a stretch of words with a least period q and a length of at least
    6 and 4 q that cannot be extended; ``runs`` holds (start, length, period) by start, then period, in word numbers.
    ``collapsed`` is the text without the words that any run holds after its first period, joined by one space. Null and
    empty texts have no runs and collapse to an empty text. Repeated rows and ids stay, null ids too. Each text is worked
    on whole, in one task; nothing is shuffled.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [_runs_of_slice(raw, offsets) for _, raw, offsets in slices(batch, "text", GRAMMAR_BYTES)]
        texts = pa.array([t for _, part in parts for t in part], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.concat_arrays([p for p, _ in parts]), texts], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id).alias("doc_id"), whole_text(text).alias("text"))
    return map_batches(rows, work, f"doc_id {docs.schema[id].dataType.simpleString()}, runs array<{RUN}>, collapsed string")


def looped(id: Column, text: Column) -> Column:
    """A text with a planted loop: with h = crc32 of the decimal id and g = floor(h / 10), every word i >= a = g mod n of
    its n words becomes word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)), if h mod 10 = 0 and n > 0. Other
    texts, and those without an id, stay."""
    h = F.crc32(id.cast("string"))
    g = F.floor(h / 10)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  (computed once)

    def edited(words):
        n = F.size(words)

        def joined(x):
            back = lambda w, i: F.when(i >= x["a"], F.element_at(words, (x["a"] + (i - x["a"]) % x["p"] + 1).cast("int"))).otherwise(w)
            return F.array_join(F.transform(words, back), " ")

        a = g % n
        return F.when(n > 0, let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), joined)).otherwise("")

    return F.when(h % 10 == 0, let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), edited)).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document with planted loops: their number, the run of greatest exponent, and what is left."""
    docs = table(spark, sf_dir, "documents")
    rows = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), whole_text()).alias("text")))
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    listed = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    lines = F.concat_ws("", F.transform("runs", listed))
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
