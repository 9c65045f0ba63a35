"""Token ids in fixed-width bit packing, with block offsets for random access.

A shard holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs,
most significant bit first.  Every BLOCK ids start a new byte, and the offset of each block is stored,
so any range of ids is one read and one vectorised unpacking.  Layout, little-endian:

    "MRPACK1\\0", uint32 bits, uint32 BLOCK            header, 16 bytes
    blocks                                            ceil(ids x bits / 8) bytes each
    int64 offset of each block, from the file's start
    int64 doc_id, uint8 id is null, int64 first id, int64 ids   one array each, per document
    uint64 blocks, uint64 documents, uint64 ids, "MRPACK1\\0"    trailer, 32 bytes

Documents are dealt by ranges of doc_id and sorted within each; the shard of a range is written by one
task under a name of its own, and only shards of tasks that succeeded are listed, so lost executors
leave at most files that nobody reads.

Defined cases: null and empty texts hold the end id alone; null ids come first; equal ids are ordered
by text; texts of any length are encoded whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe_stream import BLANK, PART, TOKENIZER, byte_letters, tokenizer_file
from millrace.llm.common import fresh_path, materialize, open_shared

MAGIC, BLOCK, END_ID = b"MRPACK1\0", 1 << 14, 0
#: So many parts of texts make one of the two generations that each worker remembers, with their ids.
KNOWN = 400_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    wide = np.ascontiguousarray(ids, dtype=">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes need no shifting
        return wide[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, 4 - bits // 8 :] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, -1)
    else:
        rows = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
        padded = np.zeros((n, 32), np.uint8)
        padded[:, 32 - bits :] = rows
        wide = np.packbits(padded, axis=1)
    return wide.view(">u4").ravel().astype(np.uint32)


class ShardWriter:
    """Takes ids document by document; holds one block and the index."""

    def __init__(self, out, bits: int) -> None:
        self.out, self.bits = out, bits
        head = MAGIC + struct.pack("<II", bits, BLOCK)
        out.write(head)
        self.at = len(head)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.n, len(ids)))
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK
        for a in range(0, stop, BLOCK):
            data = pack(ids[a : min(a + BLOCK, stop)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held = [ids[stop:].copy()]
        self.n_held = len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        docs = np.array(self.docs, np.int64).reshape(-1, 4)
        self.out.write(np.array(self.offsets, "<i8").tobytes())
        self.out.write(docs[:, 0].astype("<i8").tobytes() + docs[:, 1].astype(np.uint8).tobytes())
        self.out.write(docs[:, 2].astype("<i8").tobytes() + docs[:, 3].astype("<i8").tobytes())
        self.out.write(struct.pack("<QQQ", len(self.offsets), len(docs), self.n) + MAGIC)


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, os.SEEK_END)
        size = source.tell()
        source.seek(size - 32)
        n_blocks, n_docs, self.n, magic = struct.unpack("<QQQ8s", source.read(32))
        source.seek(0)
        head, self.bits, self.block = struct.unpack("<8sII", source.read(16))
        if head != MAGIC or magic != MAGIC:
            raise ValueError("not a token shard, or cut short")
        source.seek(size - 32 - n_blocks * 8 - n_docs * 25)
        self.offsets = np.frombuffer(source.read(n_blocks * 8), "<i8")
        self.doc_id = np.frombuffer(source.read(n_docs * 8), "<i8")
        self.is_null = np.frombuffer(source.read(n_docs), np.uint8).astype(bool)
        self.start = np.frombuffer(source.read(n_docs * 8), "<i8")
        self.length = np.frombuffer(source.read(n_docs * 8), "<i8")
        self._kept: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _one_block(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            n = min(self.block, self.n - k * self.block)
            self.source.seek(int(self.offsets[k]))
            self._kept = k, unpack(self.source.read((n * self.bits + 7) // 8), n, self.bits)
        return self._kept[1]

    def pieces(self, doc: int) -> Iterator[np.ndarray]:
        """The ids of the doc-th document, block by block."""
        at, end = int(self.start[doc]), int(self.start[doc] + self.length[doc])
        while at < end:
            k = at // self.block
            stop = min(end, (k + 1) * self.block)
            yield self._one_block(k)[at - k * self.block : stop - k * self.block]
            at = stop


@lru_cache(2)
def library_encoder(path: str) -> tuple[Callable[[list], list[bytes]], int]:
    """texts -> ids as little-endian uint32 bytes, by the tokenizers library; and the bits of an id.

    The ids of a part between blanks do not depend on what surrounds it.  Those of the parts last met are
    remembered in two generations; the others are joined to one text, which the library encodes, and its
    ids are cut again where the parts end.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    letters = {letter: 1 for letter in byte_letters()}
    size = library.get_vocab_size()
    special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
    #: Bytes of text that each id stands for: one letter of the vocabulary is one byte.
    width = np.array([len(special[i].encode()) if i in special else sum(letters.get(c, 1) for c in library.id_to_token(i) or "") for i in range(size)])
    apart = re.compile(f"[{BLANK}].*[^{BLANK}]", re.S).fullmatch
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(parts: list[str]) -> dict[str, bytes]:
        # A part that begins with a blank and ends without one keeps its ids beside others of the kind.
        joined = [p for p in parts if apart(p)]
        alone = [p for p in parts if not apart(p)]
        found = {p: ids.tobytes() for p, ids in zip(alone, ids_of(alone), strict=True)}
        for at in range(0, len(joined), 8192):
            some = joined[at : at + 8192]
            ids = ids_of(["".join(some)])[0]
            ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in some])) + 1
            data = ids.tobytes()
            found.update(zip(some, [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))
        return found

    def encode(texts: list) -> list[bytes]:
        nonlocal young, old
        if len(young) > KNOWN:
            old, young = young, {}
        parts = [PART.findall(t) if t else [] for t in texts]
        new = {p for ps in parts for p in ps if p not in young}
        young.update((p, old[p]) for p in new if p in old)
        young.update(learn([p for p in new if p not in old]))
        coded = [b"".join(map(young.__getitem__, ps)) for ps in parts]
        for p in new:
            if len(p) >= 64:
                del young[p]
        return coded

    return encode, max(1, (size - 1).bit_length())


def _slices(values: pa.Array, most_bytes: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are some megabytes together (one row at least)."""
    at, total = 0, 0
    for i, n in enumerate(pa.compute.binary_length(values).fill_null(0).to_pylist()):
        total += n
        if total > most_bytes:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(values):
        yield at, len(values)


def write_shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the corpus in ascending doc_id; returns shard (ascending), path, n_docs, n_tokens (stored)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        encode, bits = library_encoder(tokenizer_file(tokenizer))
        shard = TaskContext.get().partitionId()
        path, out, writer = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.pack", None, None
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                rows = batch.slice(a, b - a)
                if writer is None and len(rows):
                    out = open_shared(path, "wb")
                    writer = ShardWriter(out, bits)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": len(writer.docs), "n_tokens": writer.n}])

    # Ranges are drawn from the ids alone; texts move once, and are encoded where they are written.
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "pack-shards")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    # One row per shard; where each begins in the whole corpus is a running sum over them.
    shards, start, begun = manifest.orderBy("shard").collect(), 0, []
    for s in shards:
        begun.append((s["path"], start))
        start += s["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_shared(path, "rb") as source:
                    shard = ShardReader(source)
                    for at in range(0, len(shard.doc_id), 8192):
                        docs, sums = range(at, min(at + 8192, len(shard.doc_id))), []
                        for doc in docs:
                            crc = 0
                            for ids in shard.pieces(doc):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        some = slice(docs.start, docs.stop)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_id[some], pa.int64(), mask=shard.is_null[some]), pa.array(shard.start[some] + base),
                                pa.array(shard.length[some]), pa.array(sums, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    listed = spark.createDataFrame(begun, "path string, base long").repartition(max(1, len(begun)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the shards in the shared folder and reads every document back."""
    return read_shards(write_shards(docs, fresh_path(docs.sparkSession, "packed"), tokenizer))
