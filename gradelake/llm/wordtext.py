"""Words of a text as bytes, the way several operators read them: runs of 0-9, a-z and non-ASCII characters."""

from __future__ import annotations

import re

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte that is in no word into a space.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
WORD_RE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Byte start and end of each word of ``words(text)``."""
    return [m.span() for m in WORD_RE.finditer(text.encode("utf-8", "replace").translate(TABLE))]
