"""Character classes of the tokenizers' patterns, as sets that Python's ``re`` scans quickly.

Which characters are letters, numbers and white space is asked from the tokenizers
library itself, so that both always follow the same Unicode tables.
"""

from __future__ import annotations

import functools
import re

from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

#: Contractions that are pieces of their own (fixed values of the public patterns).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@functools.cache
def _members(kind: str) -> list[int]:
    """Code points of one class, in ascending order."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(every)
    return sorted(ord(c) for run, _ in runs for c in run)


@functools.cache
def inside(kind: str, narrow: bool) -> str:
    """A class as the inside of a character set; ``narrow``: only code points below 0x10000."""
    ranges: list[list[int]] = []
    for code in _members(kind):
        if narrow and code > 0xFFFF:
            break
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@functools.cache
def _pattern(form: str, narrow: bool) -> re.Pattern:
    return re.compile(form.format(L=inside(r"\p{L}", narrow), N=inside(r"\p{N}", narrow), S=inside(r"\s", narrow)))


#: Pieces of byte-level BPE: every character is in one piece.
BYTE_LEVEL = CONTRACTIONS + r"| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Pieces of BPE with word ends: single numbers, white space in no piece.
WORD_ENDS = CONTRACTIONS + r"|[{L}]+|[{N}]|[^{S}{L}{N}]+"


def pieces(form: str, text: str) -> list[str]:
    """The pieces of a text; sets that hold rare planes are slower and only used where such characters occur."""
    return _pattern(form, len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)).findall(text)


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others for those from U+0100 on, in byte order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]
