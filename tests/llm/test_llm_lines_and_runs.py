"""Line dedup, importance resampling and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import components, importance, line_runs, periodic_runs, secrets
from fleetlens.llm.queries import QUERIES

# -- op13 --------------------------------------------------------------------------------------------------------------


def plain_runs(words):
    """All runs by comparing the words with themselves at every distance."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapse(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, texts):
    rng = np.random.default_rng(seed)
    for _ in range(texts):
        n = int(rng.integers(0, 150))
        words = rng.integers(0, int(rng.integers(1, 6)), n)
        for _ in range(int(rng.integers(0, 4))):
            if n > 8:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, n // 4 + 1))
                for i in range(a, int(rng.integers(a, n + 1))):
                    words[i] = words[a + (i - a) % p]
        yield words.astype(np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_a_shared_grammar_equal_plain_runs(seed):
    texts = list(random_texts(seed, 12))
    texts += texts[: seed % 4]  # copies share their rules
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    begin, stop, q = periodic_runs.find_runs(np.concatenate(texts), at)
    got = [(int(a), int(b - a), int(p)) for a, b, p in zip(begin, stop, q, strict=True)]
    assert got == [(a + int(at[i]), n, p) for i, t in enumerate(texts) for a, n, p in plain_runs(t.tolist())]


def test_a_rule_is_looked_at_once_and_moved_to_all_its_places():
    words = np.concatenate([np.append(np.tile([1, 2, 3], 8), [90 + i]) for i in range(50)]).astype(np.int64)
    grammar = periodic_runs.Grammar(words, np.array([0, len(words)]))
    assert len(grammar.symbol) == 100 and grammar.size[grammar.terminals :].tolist() == [2, 3, 6, 12, 24]
    begin, stop, q = periodic_runs.find_runs(words, np.array([0, len(words)]))
    assert begin.tolist() == [25 * i for i in range(50)] and set((stop - begin).tolist()) == {24} and set(q.tolist()) == {3}


def test_the_same_word_thousands_of_times_and_a_long_period():
    begin, stop, q = periodic_runs.find_runs(np.zeros(50_000, np.int64), np.array([0, 50_000]))
    assert (begin.tolist(), stop.tolist(), q.tolist()) == ([0], [50_000], [1])
    begin, stop, q = periodic_runs.find_runs(np.arange(40_000) % 10_000, np.array([0, 40_000]))
    assert (begin.tolist(), stop.tolist(), q.tolist()) == ([0], [40_000], [10_000])
    assert len(periodic_runs.find_runs(np.arange(39_999) % 10_000, np.array([0, 39_999]))[0]) == 0


TEXTS = ["", None, "a", " \t\n ", "a b " * 4, "a " * 6, "x " + "lo la li " * 5 + "y", "same\x0bsame\x0csame same\tsame\rsame", "é  " * 9, "w" * 100_000 + " z" * 7]


def test_runs_nulls_empty_texts_ids_and_names(spark, docs):
    rows = docs([(i % 7 if i % 5 else None, t) for i, t in enumerate(TEXTS)], extra={"runs": "r", "collapsed": "c", "start": "s"})
    got = periodic_runs.periodic_runs(rows)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    found = Counter((r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got.collect())
    expected = Counter()
    for i, t in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words)
        expected[(i % 7 if i % 5 else None, tuple(runs), plain_collapse(words, runs))] += 1
    assert found == expected
    assert periodic_runs.periodic_runs(docs([])).collect() == []


def test_periodic_runs_query_equals_a_plain_version(spark, docs, tmp_path):
    texts = [" ".join(f"w{x}" for x in t) for t in random_texts(5, 120)] + ["", None, "one two three four " * 30, "a  b\tc"]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    expected = []
    for id, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        expected.append((id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(plain_collapse(words, runs))))
    assert planted > 4
    assert sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()) == expected


# -- op11 --------------------------------------------------------------------------------------------------------------


def plain_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_feature_buckets_equal_plain_ones(n):
    texts = ["", "a", "A b'C d9", "É été ÉTÉ x-y", "q" * 300 + " z", "..", "one two three four"]
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    bucket, offsets, words = importance.feature_buckets(np.frombuffer(b"".join(data), np.uint8), at, n)
    for i, t in enumerate(texts):
        count, features = plain_features(t, n)
        assert words[i] == count and sorted(bucket[offsets[i] : offsets[i + 1]].tolist()) == sorted(features)


@pytest.mark.parametrize(("rows", "wanted"), [(1, 1), (50, 1), (50, 50), (3000, 700), (3000, 2999)])
def test_cutoff_equals_a_sort(spark, rows, wanted):
    rng = np.random.default_rng(rows + wanted)
    keys = [(int(x), int(y)) for x, y in zip(rng.integers(-9, 9, rows), rng.integers(0, max(2, rows // 3), rows), strict=True)]
    frame = spark.createDataFrame(keys, "x bigint, y bigint").repartition(7)
    assert importance.cutoff(frame, wanted) == sorted(keys)[wanted - 1]


def test_each_pivot_discards_a_quarter():
    rng = np.random.default_rng(3)
    parts = [sorted((int(x), 0) for x in rng.choice(10**6, n, replace=False)) for n in (1, 5, 40, 300, 2000)]
    pivot = importance.weighted_median([(p[(len(p) - 1) // 2], len(p)) for p in parts])
    every = sorted(k for p in parts for k in p)
    assert len(every) / 4 <= every.index(pivot) + 1 <= 3 * len(every) / 4 + len(parts)


def plain_resample(docs, target, n=1, share=10, least=20):
    counts = [Counter(b for t in texts for b in plain_features(t, n)[1]) for texts in ([t for _, t in docs], target)]
    total = [sum(c.values()) + 10000 for c in counts]
    gain = lambda b: math.floor(1000 * math.log((counts[1][b] + 1) * total[0] / ((counts[0][b] + 1) * total[1])))
    rows = []
    for id, text in docs:
        words, features = plain_features(text, n)
        weight = sum(map(gain, features)) // max(len(features), 1)
        h = int(hashlib.sha256(f"2024:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        rows.append((id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = able[: len(able) * share // 100]
    ranked = Counter((*r[:4], i + 1) for i, r in enumerate(drawn))
    for r in drawn:
        rows.remove(r)
    return ranked + Counter((*r[:4], None) for r in rows)


def key_of(row):
    return tuple(-(2**63) if x is None else x for x in row)


@pytest.mark.parametrize("n", [1, 2])
def test_resample_equals_a_plain_version(spark, docs, n):
    rng = np.random.default_rng(n)
    texts = [" ".join(f"W{int(x)}" for x in rng.zipf(1.5, int(rng.integers(0, 60))) % 300) for _ in range(300)]
    rows = [*enumerate(texts), (None, texts[3]), (7, texts[7]), (7, texts[7]), (500, None), (501, ""), (502, "ab " * 9000)]
    target = [" ".join(f"w{int(x)}" for x in rng.integers(0, 40, 30)) for _ in range(20)] + [None]
    got = importance.resample(docs(rows, extra={"score": "x", "rank": "y", "x": "z"}), docs(target).select("text"), n=n)
    assert sorted((tuple(r) for r in got.collect()), key=key_of) == sorted(plain_resample(rows, target, n).elements(), key=key_of)


def test_resample_of_empty_tables(docs):
    assert importance.resample(docs([]), docs(["a"])).collect() == []
    few = importance.resample(docs(["a b", "c " * 30]), docs([])).collect()
    assert [r["rank"] for r in few] == [None, None]


# -- op12 --------------------------------------------------------------------------------------------------------------


def plain_dedup(rows, shortest=20, documents=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(-1 if id is None else id)
    gone = {k: max(ids) for k, ids in holders.items() if len(k) >= shortest and len(ids) >= documents}
    out = Counter()
    for id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), -1 if id is None else id) == (-1 if id is None else id)]
        out[(id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_line_dedup_equals_a_plain_version(spark, docs, batches):
    rng = np.random.default_rng(batches)
    pool = [f"Line {i} with a text of some length" for i in range(30)] + ["short", "", " ", "ÉTÉ comme hiver, toujours là"]
    vary = [lambda s: s, str.upper, lambda s: f"\t {s}\r", lambda s: s + "\x0b"]
    rows = [(int(i), "\n".join(vary[int(rng.integers(4))](pool[int(j)]) for j in rng.integers(0, len(pool), int(rng.integers(0, 9))))) for i in rng.permutation(60)]
    rows += [(None, pool[0]), (None, pool[1] + "\n" + pool[0]), (5, "other\n" + pool[2]), rows[3], rows[3], (99, None), (98, ""), (97, (pool[4] + "\n") * 3000), (96, "x" * 200_000)]
    rows += [(1000 + i, "the line that very many documents share\n" + str(i)) for i in range(300)]
    got = line_runs.without_repeated_lines(docs(rows, extra={"a": "x", "key": "y", "kept": "z", "drops": "d"}), batches=batches)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == plain_dedup(rows)


def test_line_dedup_of_an_empty_table(docs):
    assert line_runs.without_repeated_lines(docs([])).collect() == []
    assert [tuple(r)[2:] for r in line_runs.without_repeated_lines(docs([None])).collect()] == [(1, 0, "")]


def test_runs_are_sorted_disjoint_levelled_and_can_be_reopened(spark):
    keys = lambda xs: spark.createDataFrame([(x, -x) for x in xs], "a bigint, b bigint")
    runs = line_runs.LineRuns(spark, buckets=3, fanout=2)
    for start in range(0, 50, 10):
        new = runs.unseen(keys(range(start, start + 15)))
        assert sorted(r["a"] for r in new.collect()) == (list(range(15)) if not start else list(range(start + 5, start + 15)))
        runs.add(new)
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five batches, two to a level
    again = line_runs.LineRuns(spark, buckets=3, fanout=2, levels=runs.state())
    assert [r["a"] for r in again.unseen(keys([3, 54, 55])).collect()] == [55]
    plan = again.unseen(keys(range(9)).repartition(3, "a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    assert "Exchange" not in plan.split("SortMergeJoin")[-1].split("FileScan")[-1] and plan.count("Exchange") <= 1  # runs are not shuffled
    runs.close()
    again.close()


def test_the_number_of_batches_does_not_change_line_dedup(docs):
    rows = docs([(i, f"a line of enough length {i % 4}\nb{i}") for i in range(40)])
    one, many = (sorted(tuple(r) for r in line_runs.without_repeated_lines(rows, batches=n).collect()) for n in (1, 6))
    assert one == many and sum(r[3] for r in one) == 36


# -- components (op10) ---------------------------------------------------------------------------------------------------


def plain_components(links):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    classes: dict = {}
    for x in parent:
        classes.setdefault(find(x), set()).add(x)
    return sorted(map(frozenset, classes.values()), key=min)


SHAPES = {
    "star": [(0, i) for i in range(1, 4000)],
    "star with the largest in the middle": [(9999, i) for i in range(4000)],
    "chain": [(i, i + 1) for i in range(400)],
    "two stars and a bridge": [*((0, i) for i in range(1, 900)), *((5000, i) for i in range(6000, 6900)), (899, 6000)],
    "random": [tuple(map(int, x)) for x in np.random.default_rng(1).integers(0, 900, (700, 2))],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_keep_every_link_and_shrink(spark, monkeypatch, shape):
    sizes = []
    write = components.cut_lineage

    def counted(df, label):
        out = write(df, label)
        if label.endswith("-links"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "cut_lineage", counted)
    rows = components.components(spark.createDataFrame(SHAPES[shape], "a bigint, b bigint")).collect()
    classes: dict = {}
    for r in rows:
        classes.setdefault(r["root"], set()).add(r["node"])
    alone = {x for c in plain_components(SHAPES[shape]) if len(c) == 1 for x in c}  # a link to itself only
    assert sorted(map(frozenset, classes.values()), key=min) == [c for c in plain_components(SHAPES[shape]) if not c <= alone]
    assert all(r["root"] in classes[r["root"]] for r in rows)
    assert sizes[-1] == 0 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))
    if shape.startswith("star"):
        assert len(sizes) <= 3


# -- long texts of op6 ---------------------------------------------------------------------------------------------------


def test_secrets_of_texts_with_many_parts_and_matches(docs):
    random, run = "aB3xY9kLm2Qw8ErT5uIo7", "0123456789abcdef01234567"
    texts = ["ab-" * 100_000 + "9x", f"{run} " * 100_000, f"é{random} " * 5_000, f"token=abcdef{run} x {random}\n" * 2_000, "a/b2-" * 60_000]
    rows = {r.doc_id: r for r in secrets.scan(docs(texts, extra={"_base": "x", "_fl_base": "y", "spans": "z", "_m0": "m"})).collect()}
    assert [(rows[i].n_assign, rows[i].n_access, rows[i].n_hex) for i in range(5)] == [(0, 0, 0), (0, 0, 100_000), (0, 0, 0), (2_000, 0, 2_000), (0, 0, 0)]
    assert rows[0].spans == rows[4].spans == ""
    assert rows[1].spans == ",".join(f"hex:{25 * i}:{25 * i + 24}" for i in range(100_000))
    assert rows[2].spans == ",".join(f"entropy:{23 * i + 1}:{23 * i + 22}" for i in range(5_000))
    line = len(f"token=abcdef{run} x {random}\n")
    first = rows[3].spans.split(",")[:3]
    assert first == ["assign:0:36", "hex:6:36", "entropy:39:60"] and len(rows[3].spans.split(",")) == 6_000
    assert rows[3].spans.split(",")[-1] == f"entropy:{1999 * line + 39}:{1999 * line + 60}"


def test_secrets_of_an_empty_table(docs):
    assert secrets.scan(docs([])).collect() == []
    assert [tuple(r)[1:4] for r in secrets.scan(docs([None, ""])).collect()] == [(0, 0, 0)] * 2
