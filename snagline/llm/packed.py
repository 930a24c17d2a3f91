"""Token ids of documents in binary files of fixed-width bit packing.

Every id takes the bits that the vocabulary needs.  Eight ids fill a whole
number of bytes, so numpy packs and unpacks many at a time.  Ids lie in blocks
of equal length, whose offsets the file's footer has, with the first id of each
document: any document, or any range of ids, is read by one seek.

File: MAGIC; the blocks; the footer, made of block offsets (u64, one more than
blocks), the first id of each document (u64, one more than documents) and their
doc_ids (i64); then TRAILER.  All numbers are little-endian.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snagline.llm.common import BROADCAST_BYTES, shared_dir, shuffle_partitions, slices, stored, text_of

MAGIC = b"IDPACK\x00\x01"
#: Footer offset, ids, documents, blocks, documents without doc_id (they come first), ids of a block, bits of an id, MAGIC.
TRAILER = struct.Struct("<QQQQQII8s")
BLOCK_IDS = 4096
#: Bytes of text that a file has about, and ids that are unpacked or packed at a time.
SHARD_BYTES, CHUNK_IDS = 64 << 20, 1 << 18


def bits_of(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


#: Widths that are whole numbers.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, lowest bits first; the last byte is filled up with zeros."""
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), bits + 1), np.uint8)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        value = groups[:, j] << np.uint64(shift)
        for b in range(-(-(bits + shift) // 8)):
            out[:, at + b] |= (value >> np.uint64(8 * b)).astype(np.uint8)
    return out[:, :bits].tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The ids (uint32) that pack made bytes of."""
    if bits in _WHOLE:
        return np.frombuffer(data, _WHOLE[bits], count).astype(np.uint32)
    groups = -(-count // 8)
    raw = np.zeros((groups, bits + 1), np.uint8)
    whole = np.zeros(groups * bits, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)
    raw[:, :bits] = whole.reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        value = np.zeros(groups, np.uint64)
        for b in range(-(-(bits + shift) // 8)):
            value |= raw[:, at + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, j] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


class PackedWriter:
    """Writes a file front to back; in memory are a chunk of ids and the index."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        if block_ids % 8 or not 1 <= bits <= 32:
            raise ValueError("a block has a multiple of 8 ids, an id 1 to 32 bits")
        self.stream, self.bits, self.block = stream, bits, block_ids
        self.held, self.n_held, self.n_ids, self.nulls = [], 0, 0, 0
        self.starts, self.doc_ids = [0], []
        stream.write(MAGIC)
        self.offsets = [len(MAGIC)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if doc_id is None and len(self.doc_ids) > self.nulls:
            raise ValueError("documents without doc_id come first")
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.nulls += doc_id is None
        self.doc_ids.append(doc_id or 0)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= CHUNK_IDS + self.block:
            self._flush(self.n_held // self.block * self.block)

    def extend(self, ids: np.ndarray) -> None:
        """More ids of the last document."""
        self.n_ids += len(ids)
        self.starts[-1] = self.n_ids
        self.held.append(ids)
        self.n_held += len(ids)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        self.held, self.n_held = [ids[count:]], len(ids) - count
        for at in range(0, count, CHUNK_IDS // self.block * self.block or self.block):
            data = pack(ids[at : min(count, at + (CHUNK_IDS // self.block * self.block or self.block))], self.bits)
            size = self.block * self.bits // 8
            begin = self.offsets[-1]
            self.offsets += [begin + min(len(data), i + size) for i in range(0, len(data), size)]
            self.stream.write(data)

    def close(self) -> None:
        self._flush(self.n_held)
        footer = self.offsets[-1]
        for numbers, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.doc_ids, "<i8")):
            self.stream.write(np.array(numbers, kind).tobytes())
        self.stream.write(TRAILER.pack(footer, self.n_ids, len(self.doc_ids), len(self.offsets) - 1, self.nulls, self.block, self.bits, MAGIC))
        self.stream.close()


class PackedReader:
    """Random access to a file; only the index is kept in memory."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        trailer = self._bytes(max(0, end - TRAILER.size), end)
        if len(trailer) < TRAILER.size or trailer[-8:] != MAGIC:
            raise ValueError("no whole file of packed ids")
        footer, self.n_ids, self.n_docs, blocks, self.nulls, self.block, self.bits, _ = TRAILER.unpack(trailer)
        index = self._bytes(footer, end - TRAILER.size)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1)
        self.starts = np.frombuffer(index, "<u8", self.n_docs + 1, 8 * (blocks + 1))
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, 8 * (blocks + self.n_docs + 2))

    def _bytes(self, begin: int, end: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(end - begin)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids from begin to end (exclusive), out of the blocks that have them."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block, -(-end // self.block)
        data = self._bytes(int(self.offsets[first]), int(self.offsets[last]))
        count = min(self.n_ids, last * self.block) - first * self.block
        return unpack(data, count, self.bits)[begin - first * self.block : end - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        """Ids of the document at place i."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.doc_ids[i])

    def checksums(self) -> list[int]:
        """crc32 of each document's ids as little-endian u32, in one pass of bounded memory."""
        out, at = [0] * self.n_docs, 0
        for begin in range(0, self.n_ids, CHUNK_IDS):
            end = min(self.n_ids, begin + CHUNK_IDS)
            data = memoryview(self.ids(begin, end).astype("<u4").tobytes())
            while at < self.n_docs:
                a, b = max(begin, int(self.starts[at])), min(end, int(self.starts[at + 1]))
                out[at] = zlib.crc32(data[4 * (a - begin) : 4 * (b - begin)], out[at])
                if self.starts[at + 1] > end:
                    break
                at += 1
        return out


# --- encoding -----------------------------------------------------------------------------------

#: How byte-level tokenizers split a text; what a piece becomes does not depend on the pieces beside it.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same with the classes of `re`, which is faster, for texts of the characters below, on which both agree.
_FAST_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_COMMON = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Pieces whose ids a Python worker keeps, characters of the longest one that it keeps, characters of texts, or pieces of
#: a longer one, taken at a time.
KNOWN_PIECES, KNOWN_CHARS, TAKEN = 1 << 20, 64, 1 << 17


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library; pieces of a byte-level one are encoded once and kept."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        kind = str(self.tokenizer.pre_tokenizer)
        self.by_piece = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None
        self.known: dict[str, bytes] = {}
        if self.by_piece:
            space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]  # as the vocabulary writes it
            names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
            self.begins = np.array([bool(n) and n.startswith(space) for n in names])

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        spaced = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        groups = [spaced[k : k + 64] for k in range(0, len(spaced), 64)]
        # a space and letters end where the next space begins, so many go as one text, whose pieces begin with a space's token
        for part, e in zip(groups, self.tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self.known.update((p, data[a:b]) for p, a, b in zip(part, cuts[:-1], cuts[1:], strict=True))
        rest = list(pieces.difference(spaced))
        self.known.update(zip(rest, self._plain(rest)))

    def _joined(self, several: list[list[str]]) -> list[bytes]:
        """Ids of each of some lists of pieces; what is not known is learnt for all at once."""
        known = self.known
        new = set(itertools.filterfalse(known.__contains__, itertools.chain.from_iterable(several)))
        if len(known) + len(new) > KNOWN_PIECES:
            known.clear()
            new = set(itertools.chain.from_iterable(several))
        self._learn(new)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in several]
        for p in new:
            if len(p) > KNOWN_CHARS:
                del known[p]
        return out

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of whole texts."""
        if not self.by_piece:
            yield from (np.frombuffer(x, "<u4") for x in self._plain(texts))
            return
        held: list[list[str]] = []
        size = 0
        for text in texts:
            pattern = _FAST_PIECES if _COMMON.fullmatch(text) else _PIECES
            if len(text) <= TAKEN:
                held.append(pattern.findall(text))
                size += len(text)
            if held and (size > TAKEN or len(text) > TAKEN):
                yield from (np.frombuffer(x, "<u4") for x in self._joined(held))
                held, size = [], 0
            if len(text) > TAKEN:
                found, parts = (m[0] for m in pattern.finditer(text)), []
                while some := list(itertools.islice(found, TAKEN)):
                    parts += self._joined([some])
                yield np.frombuffer(b"".join(parts), "<u4")
        yield from (np.frombuffer(x, "<u4") for x in self._joined(held))


@lru_cache(2)
def _encoder(definition: str) -> Encoder:
    """One for each Python worker, whose pieces stay from task to task."""
    return Encoder(definition)


def _uri(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


_SHARD = "shard long, path string, n_docs long, n_ids long"


def write_packed(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, text: str = "text", doc_id: str = "doc_id",
    shard_bytes: int = SHARD_BYTES, block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encodes documents and writes their ids to files in ascending doc_id order; returns (shard, path, n_docs, n_ids).

    tokenizer is the path of a tokenizer file on the driver, end_id is added to
    each document (None: nothing).  Rows are dealt by ranges of doc_id, equal
    doc_ids by a hash of the text and their row, so that a repeated one may lie
    in several files; without doc_id they come first.  A task writes one file
    under a name of its own, and the returned table, which is written when all
    are done, has the files that count: what a lost or repeated task has left is
    not among them.  Null texts are empty.  Other columns are not read; doc_id
    must be integral.  An empty table gives no documents.
    """
    definition = Path(tokenizer).read_text(encoding="utf-8")
    if len(definition) > BROADCAST_BYTES:
        raise ValueError(f"{tokenizer} has more than {BROADCAST_BYTES} characters")
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(definition)
    bits = bits_of(Tokenizer.from_str(definition).get_vocab_size())
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // shard_bytes))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model.value)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        shard = TaskContext.get().partitionId()
        files, base = _uri(folder)
        files.create_dir(base)
        path = f"{base}/ids-{shard:08d}-{uuid.uuid4().hex}.bin"
        writer = PackedWriter(files.open_output_stream(path), bits, block_ids)
        for batch in slices(batches):
            for i, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                writer.add(i, ids)
                writer.extend(end)
        writer.close()
        made = ([shard], [f"{folder}/{path.rsplit('/', 1)[1]}"], [len(writer.doc_ids)], [writer.n_ids])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["shard", "path", "n_docs", "n_ids"])

    return stored(dealt.mapInArrow(write, _SHARD), "packed-files")


def read_packed(files: DataFrame) -> DataFrame:
    """Documents of files that write_packed lists: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before, over all files in order.  The
    list has a row for each file and is summed up on the driver; each file is
    read by one task, chunk by chunk.
    """
    spark = files.sparkSession
    listed, start = [], 0
    for f in files.orderBy("shard").collect():
        listed.append((f["path"], start))
        start += f["n_ids"]
    names = spark.createDataFrame(listed, "path string, start long").repartition(max(1, len(listed)))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = _uri(path)
                with system.open_input_file(name) as f:
                    r = PackedReader(f)
                    ids = pa.array(r.doc_ids, mask=np.arange(r.n_docs) < r.nulls)
                    starts = r.starts.astype(np.int64)
                    columns = [ids, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(r.checksums(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return names.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the ids of documents to files in the shared folder and reads them back, one row per document.

    Nulls, ties and repeated rows are settled as write_packed says; rows of equal
    doc_id follow each other by a hash of their text.  An empty table gives no rows.

    Returns doc_id, start, n_tokens, ids_crc32.
    """
    folder = f"{shared_dir(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    return read_packed(write_packed(docs, tokenizer, folder, end_id, text, doc_id))
