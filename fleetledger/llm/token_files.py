"""Token ids in binary files of independent zstandard frames with a seek table.

A file holds, one after the other:

- zstandard frames, each of at most ``FRAME`` bytes of ids (little-endian, 2 bytes for vocabularies of up to
  65,536 ids, else 4), readable by any zstandard tool;
- a skippable frame with the directory: the id and the number of tokens of every document in file order;
- the seek table of the public seekable format: a skippable frame with the compressed size, the size and the
  checksum (low 32 bits of XXH64) of every frame, then its footer.

``write_token_files`` deals the documents out by range of their ids, so that files in order of their names hold
the documents in ascending order (null ids first, equal ids by the text's hash, so that one id may fill many
files); each task writes one file under a name of its own attempt and then renames it, so a task that is
lost or runs twice leaves the same file.  A manifest, written last, makes the folder complete.
``read_token_files`` gives every document back, a file a task; ``TokenFile.ids`` gets single documents and reads only
the frames these lie in.  Both test the checksum of each frame they read.

Defined cases: null and empty texts hold only the end id; texts of any length span frames; repeated rows are
written as often as they occur; an empty table gives a manifest without files; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetledger.llm.piece_cache import PieceCache
from fleetledger.llm.unicode_classes import WORD_ENDS, byte_symbols, pieces

#: Bytes of ids in a frame, and the compression level.
FRAME, LEVEL = 1 << 18, 3
#: Marks of the formats (fixed values): a skippable frame, the one of a seek table, the end of a seek table, "has checksums".
SKIPPABLE, SEEK_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
MANIFEST = "manifest.json"


class WordEndBpe:
    """Ids of the tokenizers library for a vocabulary with word ends; repeated pieces are encoded once."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.symbols = self.tokenizer.model, dict(enumerate(byte_symbols()))
        self.added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.pieces = PieceCache(self._piece)

    def _piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1").translate(self.symbols)
        return b"".join(token.id.to_bytes(self.width, "little") for token in self.model.tokenize(symbols))

    def _plain(self, text: str) -> bytes:
        # Below U+0300 there is nothing to compose, and lower case does not depend on what stands around.
        plain = text.isascii() or not _COMPOSABLE.search(text)
        lower = text.lower() if plain else self.tokenizer.normalizer.normalize_str(text)
        return b"".join(map(self.pieces.__getitem__, pieces(WORD_ENDS, lower)))

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text, without added begin or end."""
        if not text:
            return b""
        self.pieces.trim()
        if not any(x in text for x in self.added):
            return self._plain(text)
        parts = self.split_added.split(text)
        return b"".join(self.added[x].to_bytes(self.width, "little") if x in self.added else self._plain(x) for x in parts)


_COMPOSABLE = re.compile("[^\x00-˿]")


@functools.lru_cache(maxsize=2)
def coder(vocabulary: str) -> WordEndBpe:
    """The coder of a file, made once in each Python worker."""
    return WordEndBpe(vocabulary)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class TokenFileWriter:
    """One file, written front to back."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.buffer, self.frames, self.directory = sink, width, bytearray(), [], []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, identity: int | None, packed: bytes) -> None:
        self.directory.append((identity, len(packed) // self.width))
        self.buffer += packed
        while len(self.buffer) >= FRAME:
            self._frame(bytes(self.buffer[:FRAME]))
            del self.buffer[:FRAME]

    def _frame(self, data: bytes) -> None:
        squeezed = self.compressor.compress(data)
        self.sink.write(squeezed)
        self.frames.append((len(squeezed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def finish(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        ids = np.array([i or 0 for i, _ in self.directory], "<i8").tobytes()
        absent = np.array([i is None for i, _ in self.directory], "u1").tobytes()
        lengths = np.array([n for _, n in self.directory], "<i8").tobytes()
        directory = self.compressor.compress(struct.pack("<BQ", self.width, len(self.directory)) + ids + lengths + absent)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(directory)) + directory)
        self.frames.append((len(directory) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *frame) for frame in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(table) + len(footer)) + table + footer)


class TokenFile:
    """Reader of one file; frames are read and decompressed only when asked for."""

    def __init__(self, place: fs.FileSystem, path: str):
        self.source = place.open_input_file(path)
        size = self.source.size()
        count, flags, mark = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if mark != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        frames = np.frombuffer(self._bytes(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(frames[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(frames[:-1, 1])])
        self.checksums = frames[:-1, 2]
        directory = self._bytes(int(self.packed_at[-2]) + 8, int(frames[-1, 0]) - 8)
        raw = zstandard.ZstdDecompressor().decompress(directory)
        self.width, n = struct.unpack_from("<BQ", raw)
        self.ids = np.frombuffer(raw, "<i8", n, 9)
        self.lengths = np.frombuffer(raw, "<i8", n, 9 + 8 * n)
        self.absent = np.frombuffer(raw, "u1", n, 9 + 16 * n).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.held: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        """The ids of frame ``k``; the last frame read is kept."""
        if self.held[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.packed_at[k]), int(self.packed_at[k + 1] - self.packed_at[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checksums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
            self.frames_read += 1
        return self.held[1]

    def document(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document."""
        at, end = int(self.starts[k]) * self.width, int(self.starts[k + 1]) * self.width
        parts, f = [], int(np.searchsorted(self.plain_at, at, "right")) - 1
        while at < end:
            stop = min(end, int(self.plain_at[f + 1]))
            parts.append(self.frame(f)[at - int(self.plain_at[f]) : stop - int(self.plain_at[f])])
            at, f = stop, f + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}")

    def of(self, identity: int) -> list[np.ndarray]:
        """Ids of the documents with this id."""
        return [self.document(int(k)) for k in np.flatnonzero((self.ids == identity) & ~self.absent)]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write its ids below ``folder``, in ascending order of the ids of the documents."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = _place(folder)
        own, part = coder(vocabulary), TaskContext.get().partitionId()
        place.create_dir(base, recursive=True)
        end = b"" if end_id is None else end_id.to_bytes(own.width, "little")
        name, attempt = f"part-{part:08d}.tokens", f"{base}/.{part}-{uuid.uuid4().hex}"
        with place.open_output_stream(attempt) as sink:
            writer = TokenFileWriter(sink, own.width)
            for batch in batches:
                for identity, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(identity, own.encode(value.as_py()) + end)
            writer.finish()
        if not writer.directory:
            place.delete_file(attempt)
            return
        place.move(attempt, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "documents": [len(writer.directory)], "tokens": [sum(n for _, n in writer.directory)]})

    columns = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    hashed = columns.withColumn("hash", F.xxhash64("text"))
    dealt = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    written = dealt.mapInArrow(write, "name string, documents long, tokens long").collect()  # a row for each file
    place, base = _place(folder)
    place.create_dir(base, recursive=True)
    with place.open_output_stream(f"{base}/.{MANIFEST}") as sink:
        sink.write(json.dumps(sorted(map(list, written))).encode())
    place.move(f"{base}/.{MANIFEST}", f"{base}/{MANIFEST}")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document."""
    place, base = _place(folder)
    with place.open_input_stream(f"{base}/{MANIFEST}") as source:
        files = json.loads(source.read())
    before = np.concatenate([[0], np.cumsum([tokens for _, _, tokens in files])]).astype(int).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = _place(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                file = TokenFile(place, f"{base}/{files[number][0]}")
                for low in range(0, len(file.ids), 500):
                    some = range(low, min(low + 500, len(file.ids)))
                    ids = pa.array([None if file.absent[k] else int(file.ids[k]) for k in some], pa.int64())
                    starts = pa.array([before[number] + int(file.starts[k]) for k in some], pa.int64())
                    packed = pa.array([file.document(k).astype("<u4").tobytes() for k in some], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids, starts, packed], ["doc_id", "start", "ids"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "doc_id long, start long, ids binary")
