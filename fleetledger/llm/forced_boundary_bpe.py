"""Byte-level BPE by forced boundaries, and its decoder.

A pair of neighbouring bytes that stands inside no vocabulary entry can never be
merged across, so it marks a certain cut.  A pre-token is cut at all such pairs, the
fragments are encoded each by itself and the ids put together; the ids are those of
the whole.  Fragments and pre-tokens repeat, so both are kept in bounded caches.

Defined cases: a null or empty text has no ids and decodes to the empty text; a string
of an added token inside a text gives that token's id; texts may have any length (a
fragment of n bytes costs n log n); repeated rows give repeated results; other columns
are left alone.  Work is per row: no shuffle, no state, and a lost task is simply run again.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetledger.llm.piece_cache import CACHE_ENTRIES, CACHE_PIECE, PieceCache
from fleetledger.llm.unicode_classes import BYTE_LEVEL, byte_symbols, pieces


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        model = spec["model"]
        entries = {name: bytes(of_symbol[c] for c in name) for name in model["vocab"]}
        ids: dict[bytes, int] = {entries[name]: i for name, i in model["vocab"].items()}
        inside = np.zeros((256, 256), bool)
        for entry in ids:
            for pair in zip(entry, entry[1:]):
                inside[pair] = True
        #: True where two neighbouring bytes occur inside some entry, so a merge may span them.
        self.inside = inside.tolist()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        size = 1 + max([*model["vocab"].values(), *self.added.values()])
        self.texts: list[bytes] = [b""] * size
        for entry, i in ids.items():
            self.texts[i] = entry
        for content, i in self.added.items():
            self.texts[i] = content.encode()
        self.fragments: dict[bytes, bytes] = {}
        self.symbols = dict(enumerate(byte_symbols()))
        #: Merges within one fragment are the library's.
        self.model = Tokenizer.from_file(vocabulary).model
        self.pieces = PieceCache(self._piece)

    def cut(self, data: bytes) -> list[bytes]:
        """The fragments of ``data`` between forced boundaries."""
        inside, out, start = self.inside, [], 0
        for at in range(1, len(data)):
            if not inside[data[at - 1]][data[at]]:
                out.append(data[start:at])
                start = at
        out.append(data[start:])
        return out

    def _fragment(self, data: bytes) -> bytes:
        known = self.fragments.get(data)
        if known is None:
            symbols = data.decode("latin-1").translate(self.symbols)
            known = b"".join(token.id.to_bytes(4, "little") for token in self.model.tokenize(symbols))
            if len(data) <= CACHE_PIECE:
                self.fragments[data] = known
        return known

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._fragment, self.cut(piece.encode())))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        self.pieces.trim()
        if len(self.fragments) > CACHE_ENTRIES:
            self.fragments.clear()
        of_piece = self.pieces.__getitem__
        if self.split_added is None or not any(x in text for x in self.added):
            return b"".join(map(of_piece, pieces(BYTE_LEVEL, text)))
        parts = []
        for part in self.split_added.split(text):
            if part in self.added:
                parts.append(self.added[part].to_bytes(4, "little"))
            else:
                parts.extend(map(of_piece, pieces(BYTE_LEVEL, part)))
        return b"".join(parts)

    def decode(self, packed: bytes | None) -> bytes:
        """The decoded text in UTF-8; broken sequences become replacement characters."""
        joined = b"".join(map(self.texts.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))
        return joined if joined.isascii() else joined.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def coder(vocabulary: str) -> ForcedBoundaryBpe:
    """The coder of a file, made once in each Python worker."""
    return ForcedBoundaryBpe(vocabulary)


def _texts(values: pd.Series) -> Iterable[str | None]:
    return (v if isinstance(v, str) else None for v in values)


def encode_column(text: Column, vocabulary: str) -> Column:
    """Packed ids (binary, little-endian unsigned 32-bit) of a text column; null counts as empty."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return pd.Series([coder(vocabulary).encode(v) for v in _texts(values)], dtype=object)

    return encode(text)


def decode_column(ids: Column, vocabulary: str) -> Column:
    """Text of a column of packed ids; null counts as no ids."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([coder(vocabulary).decode(v).decode() for v in values], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the packed ids of its texts as column ``into``; a column of that name is replaced."""
    return docs.withColumn(into, encode_column(F.col(f"`{text}`"), vocabulary))


def round_trip_column(text: Column, vocabulary: str) -> Column:
    """Count and digest of the ids, and digest of the text decoded from those ids.

    Encodes and decodes as the two columns above do, without sending the ids through the JVM.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def round_trip(values: pa.Array) -> pa.Array:
        own, counts, ids, texts = coder(vocabulary), [], [], []
        for value in values:  # one text at a time is made a Python string
            packed = own.encode(value.as_py())
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(own.decode(packed)).hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return round_trip(text)
