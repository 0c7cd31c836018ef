"""Encoded pieces of text, kept in a cache of bounded size."""

from __future__ import annotations

from collections.abc import Callable

#: Entries that a cache may hold before it is emptied, and the longest piece that is kept.
CACHE_ENTRIES, CACHE_PIECE = 400_000, 64


class PieceCache(dict):
    """Piece to its packed ids, encoded when first met."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = self._encode(piece)
        if len(piece) <= CACHE_PIECE:
            self[piece] = packed
        return packed

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()
