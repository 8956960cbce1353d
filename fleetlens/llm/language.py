"""Language of texts by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads a word (a run of letters, lower case in ASCII, at most ``SEGMENT`` bytes; longer runs are cut) with its
borders from both sides and gives a distribution over languages at every byte. The state starts anew at each word, so
the labels of a position depend on its word alone: every different word of a batch is evaluated once, and the time for a
text does not depend on its length. The logs of the distributions at all letters of a text are added and normalised:
the pooled probabilities of the document.

Training takes a bounded sample, at most ``SAMPLE_DOCS`` texts of each language (those with the least hash of the id; of
several texts of one id the least), and backpropagation through time with Adam. Only the sample reaches the driver.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import fold, hash_spans, map_batches, query, slices, table, whole_text, word_spans

SEGMENT = 24
HIDDEN, EMBEDDING = 12, 8
SAMPLE_DOCS = 300
SAMPLE_WORDS = 40_000
EPOCHS, BATCH, RATE = 3, 256, 0.01

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.int64)
FOLD[65:91] += 32
BORDER = 0  # stands before and after each word; a NUL byte is no letter


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, long ones cut into segments."""
    starts, ends, at = word_spans(raw, offsets, LETTER)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    parts = -(-(ends - starts) // SEGMENT)
    if len(parts) and parts.max() > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        stop, rows = np.repeat(ends, parts), np.repeat(rows, parts)
        starts = np.repeat(starts, parts) + nth * SEGMENT
        ends = np.minimum(starts + SEGMENT, stop)
    return starts, ends, rows


def byte_table(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of equal width between borders, and their lengths."""
    size = ends - starts
    width = int(size.max()) if len(size) else 0
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    out = np.full((len(size), width + 2), BORDER, dtype=np.int64)
    out[:, 1:-1] = np.where(inside, FOLD[raw[np.minimum(at, max(len(raw) - 1, 0))]], BORDER)
    return out, size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGru:
    """Embedding, one gated recurrent layer each way, and a softmax at every byte."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n, h = len(languages), HIDDEN
        self.p = {"E": rng.normal(0, 0.3, (256, EMBEDDING)), "O": rng.normal(0, 0.3, (2 * h, n)), "o": np.zeros(n)}
        for way in "fb":
            self.p |= {f"W{way}": rng.normal(0, 0.3, (EMBEDDING, 3 * h)), f"U{way}": rng.normal(0, 0.3, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, way: str, keep: bool):
        """States after each byte, in reading order; gates are [update, reset, candidate]."""
        h, n, steps = HIDDEN, len(x), x.shape[1]
        drive = (self.p["E"] @ self.p[f"W{way}"] + self.p[f"c{way}"]).astype(np.float32)  # of each byte value
        u = self.p[f"U{way}"]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state, states, memory = np.zeros((n, h), np.float32), [], []
        order = range(steps) if way == "f" else range(steps - 1, -1, -1)
        for t in order:
            d = drive[x[:, t]]
            gates = _sigmoid(d[:, : 2 * h] + state @ u_gates)
            z, r = gates[:, :h], gates[:, h:]
            back = r * state
            new = np.tanh(d[:, 2 * h :] + back @ u_new)
            if keep:
                memory.append((t, state, z, r, back, new))
            state = state + z * (new - state)
            states.append(state)
        return (states if way == "f" else states[::-1]), memory

    def log_probabilities(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log distributions summed over the bytes of each word (without borders)."""
        forward, backward = self._run(x, "f", False)[0], self._run(x, "b", False)[0]
        top, low = self.p["O"][:HIDDEN], self.p["O"][HIDDEN:]
        total = np.zeros((len(x), len(self.languages)), np.float32)
        for t in range(1, x.shape[1] - 1):
            logit = forward[t] @ top + backward[t] @ low + self.p["o"]
            logit -= logit.max(axis=1, keepdims=True)
            logit -= np.log(np.exp(logit).sum(axis=1, keepdims=True))
            total += np.where((t <= size)[:, None], logit, 0)
        return total

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (cross entropy per byte) and gradients by backpropagation through time."""
        h, steps, g = HIDDEN, x.shape[1], {k: np.zeros_like(v) for k, v in self.p.items()}
        forward, mf = self._run(x, "f", True)
        backward, mb = self._run(x, "b", True)
        inside = (np.arange(steps) >= 1) & (np.arange(steps) <= size[:, None])
        scale, loss = np.float32(1 / inside.sum()), 0.0
        push = {"f": [None] * steps, "b": [None] * steps}
        for t in range(steps):
            both = np.concatenate([forward[t], backward[t]], axis=1)
            logit = both @ self.p["O"] + self.p["o"]
            logit -= logit.max(axis=1, keepdims=True)
            q = np.exp(logit)
            q /= q.sum(axis=1, keepdims=True)
            on = inside[:, t]
            loss -= float(np.log(q[np.arange(len(y)), y] + 1e-9)[on].sum() * scale)
            q[np.arange(len(y)), y] -= 1
            q *= (on * scale)[:, None]
            g["O"] += both.T @ q
            g["o"] += q.sum(axis=0)
            d = q @ self.p["O"].T
            push["f"][t], push["b"][t] = d[:, :h], d[:, h:]
        for way, memory in (("f", mf), ("b", mb)):
            u, carry = self.p[f"U{way}"], np.zeros((len(x), h), np.float32)
            for t, state, z, r, back, new in reversed(memory):
                d = carry + push[way][t]
                a_new = d * z * (1 - new * new)
                d_back = a_new @ u[:, 2 * h :].T
                a_z, a_r = d * (new - state) * z * (1 - z), d_back * state * r * (1 - r)
                gates = np.concatenate([a_z, a_r], axis=1)
                all_ = np.concatenate([gates, a_new], axis=1)
                carry = d * (1 - z) + d_back * r + gates @ u[:, : 2 * h].T
                g[f"U{way}"][:, : 2 * h] += state.T @ gates
                g[f"U{way}"][:, 2 * h :] += back.T @ a_new
                g[f"c{way}"] += all_.sum(axis=0)
                byte = x[:, t]
                g[f"W{way}"] += self.p["E"][byte].T @ all_
                np.add.at(g["E"], byte, all_ @ self.p[f"W{way}"].T)
        return loss, g

    def fit(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, seed: int = 6) -> BiGru:
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, 0
        total = EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                width = int(size[at].max()) + 2
                step += 1
                rate = RATE * (1 - 0.9 * step / total)
                for k, g in self.gradients(x[at][:, :width], size[at], y[at])[1].items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame) -> BiGru | None:
    """A network from ``docs(doc_id, text, lang)``; None if no row has a language and a letter."""
    # ids are chosen without their texts, and only the chosen texts are read and moved
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", "lang", whole_text().alias("text"))
    ids = known.select("lang", "doc_id").distinct()
    chosen = ids.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= SAMPLE_DOCS).drop("_rank")
    sample = known.join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").toArrow()
    if not sample.num_rows:
        return None
    languages = sorted(pc.unique(sample.column("lang")).to_pylist())
    words: list[np.ndarray] = []
    label: list[np.ndarray] = []
    known_as = np.array([languages.index(x) for x in sample.column("lang").to_pylist()])
    for i, batch in enumerate(sample.combine_chunks().to_batches()):
        base = 0 if i == 0 else base  # noqa: F821
        for part, raw, offsets in slices(batch, "text"):
            starts, ends, rows = segments(raw, offsets)
            x, _ = byte_table(raw, starts, ends)
            wide = np.full((len(x), SEGMENT + 2), BORDER, dtype=np.uint8)
            wide[:, : x.shape[1]] = x
            words.append(wide)
            label.append(known_as[base + rows])
            base += part.num_rows
    x, y = np.concatenate(words).astype(np.int64), np.concatenate(label)
    if not len(x):
        return None
    rng, chosen = np.random.default_rng(4), []
    for one in range(len(languages)):  # as many words of each language
        own = np.flatnonzero(y == one)
        chosen.append(rng.permutation(own)[: SAMPLE_WORDS // len(languages)])
    at = np.concatenate(chosen)
    x, y = x[at], y[at]
    return BiGru(languages).fit(x, (x > BORDER).sum(axis=1), y)


def pooled(model: BiGru, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log probabilities of the languages summed over the letters of each row; zeros without any."""
    starts, ends, rows = segments(raw, offsets)
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(starts):
        return out
    _, first, back = np.unique(hash_spans(FOLD.astype(np.uint8)[raw], starts, ends), return_index=True, return_inverse=True)
    score, length = np.zeros((len(first), out.shape[1]), np.float32), (ends - starts)[first]
    order = np.argsort(length, kind="stable")
    for at in np.array_split(order, max(1, len(order) // 4096)):  # words of like length together
        x, size = byte_table(raw, starts[first[at]], ends[first[at]])
        score[at] = model.log_probabilities(x, size)
    for i in range(out.shape[1]):
        out[:, i] = np.bincount(rows, weights=score[back, i], minlength=len(out))
    return out


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a Unicode letter; only rows without an ASCII letter are looked into."""
    ascii_ = LETTER & (np.arange(256) < 128)
    run = np.concatenate([[0], np.cumsum(ascii_[raw])])
    found = run[offsets[1:]] > run[offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = raw[offsets[i] : offsets[i + 1]]
        if (text > 127).any():
            found[i] = any(unicodedata.category(c)[0] == "L" for c in text.tobytes().decode("utf-8", "replace"))
    return found


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row of ``docs``.

    Languages are learned from ``text`` and non-null ``lang`` of rows whose fold (crc32 of the id, modulo 5) is not 0.
    A null text, or one without a letter, is ``und`` with score 0; so is every text when nothing can be learned. Equal
    texts get equal results.
    """
    model = train(docs.filter(fold(5) != 0))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [], []
        for _, raw, offsets in slices(batch, "text"):
            if model is None:
                names += ["und"] * (len(offsets) - 1)
                scores.append(np.zeros(len(offsets) - 1))
                continue
            logs = pooled(model, raw, offsets)
            share = np.exp(logs - logs.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            known = _has_letter(raw, offsets)
            names += [model.languages[j] if ok else "und" for j, ok in zip(logs.argmax(axis=1), known, strict=True)]
            scores.append(np.where(known, share.max(axis=1), 0.0))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "lang_pred", "score"])

    found = map_batches(docs.select("doc_id", whole_text().alias("text")), work, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages(table(spark, sf_dir, "documents"))
