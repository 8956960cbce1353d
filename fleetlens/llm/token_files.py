"""Token ids of texts in bit-packed files.

A file holds the ids of consecutive documents, each closed by an end id. An id takes as many bits as the vocabulary
needs. 64 ids fill a whole number of 64-bit words, ``BLOCK_IDS`` ids make a block, and the footer lists the offset of
each block and the length and id of each document, so any range of ids is read by seeking to its blocks and unpacked by
``bits`` vector operations.

Layout, little-endian: blocks; block offsets (uint64); tokens per document (uint64); document ids (int64); 1 where a
document id is null (uint8); footer of six uint64 (bits, ids, blocks, documents, offset of the block table, version);
eight bytes ``FLTOKENS``.

Files lie in the shared folder and carry the number of the task attempt; a lost or repeated attempt leaves a file that
no manifest names. Paths are opened through ``pyarrow.fs``, so local, HDFS and object stores work.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import cut_lineage, query, scratch_path, slices, table, whole_text

MAGIC = b"FLTOKENS"
BLOCK_IDS = 1 << 16
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Encoded pieces of text in each of the two generations a Python worker keeps.
PIECES = 1 << 18
#: Pieces that are encoded as one text, and bytes of text that are looked up at once.
TOGETHER, SLICE = 1000, 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each; the last group of 64 is filled up with zeros."""
    groups = np.zeros(-(-len(ids) // 64) * 64, dtype=np.uint64)
    groups[: len(ids)] = ids
    groups = groups.reshape(-1, 64)
    words = np.zeros((len(groups), bits), dtype="<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= groups[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, j] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)


class TokenWriter:
    """Writes one file; only the current block and the document table are held in memory."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.offsets, self.place = stream, bits, [], 0
        self.lengths: list[int] = []
        self.names: list[int | None] = []
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, name: int | None, ids: bytes) -> None:
        """A document: its ids as little-endian uint32."""
        self.names.append(name)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        full = len(ids) if all_ else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, full, BLOCK_IDS):
            data = pack(ids[i : min(i + BLOCK_IDS, full)], self.bits)
            self.offsets.append(self.place)
            self.stream.write(data)
            self.place += len(data)
        self.total += full
        self.waiting, self.held = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([n is None for n in self.names], dtype=np.uint8)
        for part in (np.array(self.offsets, "<u8"), np.array(self.lengths, "<u8"), np.array([n or 0 for n in self.names], "<i8"), nulls):
            self.stream.write(part.tobytes())
        self.stream.write(struct.pack("<6Q", self.bits, self.total, len(self.offsets), len(self.names), self.place, 1) + MAGIC)
        self.stream.close()


class TokenFile:
    """Reads one file: ``lengths`` and ``names`` of its documents, and any range of ids."""

    def __init__(self, stream):
        self.stream, end = stream, stream.size()
        stream.seek(end - 56)
        tail = stream.read(56)
        if tail[48:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.total, blocks, docs, start, _ = struct.unpack("<6Q", tail[:48])
        stream.seek(start)
        body = stream.read(end - 56 - start)
        self.offsets = np.append(np.frombuffer(body, "<u8", blocks), start).astype(np.int64)
        self.lengths = np.frombuffer(body, "<u8", docs, 8 * blocks).astype(np.int64)
        names, nulls = np.frombuffer(body, "<i8", docs, 8 * (blocks + docs)), np.frombuffer(body, np.uint8, docs, 8 * (blocks + 2 * docs))
        self.names = [None if null else int(name) for name, null in zip(names, nulls, strict=True)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of positions ``start`` to ``stop``; reads only their blocks."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        self.stream.seek(int(self.offsets[first]))
        data = self.stream.read(int(self.offsets[last + 1] - self.offsets[first]))
        return unpack(data, self.bits)[start - first * BLOCK_IDS : stop - first * BLOCK_IDS].astype(np.uint32)


# -- encoding --------------------------------------------------------------------------------------------------------

#: A space before visible text always begins a new piece of a byte-level tokenizer, whatever stands around it; a piece
#: can be encoded by itself, and the ids of a text are those of its pieces.
_BORDER = re.compile(r"(?= \S)")
_UNSAFE = re.compile(r" (?!\S)")

def pieces_of(text: str) -> list[str]:
    if _UNSAFE.search(text):
        return _BORDER.split(text)
    return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _BORDER.split(text)


class Encoder:
    """A tokenizer that remembers the ids of pieces. One per Python worker and tokenizer file.

    Pieces are remembered in two generations: when the younger is full it becomes the elder, whose pieces stay only if
    they are met again. So frequent pieces stay, whatever their length, and a worker holds ``2 * PIECES`` pieces and
    those of one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        # a byte-level token has a character for each byte it stands for
        names = {i: len(token) for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        names |= {i: len(token.content.encode()) for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.size = np.zeros(max(names, default=0) + 1, dtype=np.int64)
        self.size[list(names)] = list(names.values())
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_fleetlens_encoders", {})  # lives as long as the worker
        return kept.setdefault(path, None) or kept.__setitem__(path, cls(path)) or kept[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        pieces = [pieces_of(t) for t in texts]
        if len(self.known) > PIECES:
            self.known, self.elder = {}, self.known
        self._learn(set().union(*pieces).difference(self.known), {p[0] for p in pieces})
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def _learn(self, pieces: set[str], first: set[str]) -> None:
        """Remember the ids of pieces. Those not of ``first`` have a border before them and are joined into longer texts,
        whose ids are cut where the bytes of a piece end; where no id ends there, each is encoded by itself."""
        again = [(x, ids) for x in pieces if (ids := self.elder.get(x)) is not None]
        self.known.update(again)
        pieces.difference_update(x for x, _ in again)
        joined, alone = list(pieces - first), list(pieces & first)
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends, last = np.cumsum(self.size[ids]), np.cumsum([len(x.encode()) for x in group])
            at = np.searchsorted(ends, last)
            if len(ids) and ends[-1] == last[-1] and (ends[at] == last).all():
                data, cut = ids.tobytes(), (4 * (at + 1)).tolist()
                self.known.update(zip(group, map(data.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
            else:
                alone += group
        for piece, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.known[piece] = struct.pack(f"<{len(found.ids)}I", *found.ids)


# -- jobs ------------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, order: list[str], tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of ``docs(doc_id, text, order...)`` in ascending ``order``, one file per partition. Returns the
    manifest: ``part``, ``path``, ``docs``, ``ids`` of each file; files follow each other by ``part``.

    ``tokenizer`` is the path of a tokenizer file on every executor; by default the public one named ``TOKENIZER``.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    end = struct.pack("<I", END_ID)

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers

        encoder, writer, path = Encoder.of(tokenizer or public_tokenizers.path(TOKENIZER)), None, ""
        context = TaskContext.get()
        for batch in batches:
            for part, _, _ in slices(batch, "text", SLICE):
                if writer is None:
                    files, base = arrow_fs.FileSystem.from_uri(folder)
                    files.create_dir(base, recursive=True)
                    path = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.tokens"
                    writer = TokenWriter(files.open_output_stream(f"{base}/{path}"), encoder.bits)
                for name, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    writer.add(name, ids + end)
        if writer is not None:
            writer.close()
            row = [[context.partitionId()], [f"{folder}/{path}"], [len(writer.lengths)], [writer.total]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), *(pa.array(r, pa.int64()) for r in row[2:])], ["part", "path", "docs", "ids"])

    rows = docs.select("doc_id", whole_text().alias("text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.xxhash64("text"))
    return cut_lineage(ranged.select("doc_id", "text").mapInArrow(run, "part int, path string, docs bigint, ids bigint"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``. One row per file reaches the
    driver, to add up where each file starts."""
    spark, total, files = manifest.sparkSession, 0, []
    # collected in one statement: an iterator over a sorted frame reads its shuffle after the statement that made it
    for _, path, ids in sorted(manifest.select("part", "path", "ids").collect()):
        files.append((path, total))
        total += ids

    def run(batches):
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base")), strict=True):
                store, place = arrow_fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as stream:
                    file = TokenFile(stream)
                    ends = np.cumsum(file.lengths)
                    i = 0
                    while i < len(ends):
                        start = int(ends[i] - file.lengths[i])
                        j = max(i + 1, int(np.searchsorted(ends, start + 16 * BLOCK_IDS, side="right")))
                        ids = file.ids(start, int(ends[j - 1])).astype("<u4").tobytes()
                        cut = [0, *(4 * (ends[i:j] - start)).tolist()]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                        columns = [file.names[i:j], base + ends[i:j] - file.lengths[i:j], file.lengths[i:j], crc]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    rows = spark.createDataFrame(files, "path string, base bigint")
    return rows.repartition(max(1, len(files))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written in order of ``doc_id`` and read back from the files."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return read_token_files(write_token_files(docs, ["doc_id"]))
