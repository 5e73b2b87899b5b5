"""Cutting a text into pieces that a byte-level BPE tokenizer treats on their own.

In the usual byte-level pattern a space directly before a character that is no white space always
begins a new match, and what stands before it is matched as if the text ended there. So a text may
be cut before every such space. The pieces repeat (they are mostly single words), their ids are
kept in a bounded table per worker, and a document is the concatenation of its pieces' ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Pieces kept per worker; the table starts anew when it is full. The results do not depend on it.
KEPT_PIECES = 1_000_000
KEPT_CHARS = 48


def pieces(text: str) -> list[str]:
    """`text` cut before every space that a non-space character follows; joined they are `text`."""
    parts = text.split(" ")
    out = [parts[0]]
    add = out.append
    held = 0  # spaces that belong to the end of the last piece
    for p in parts[1:]:
        if p and not p[0].isspace():
            if held:
                out[-1] += " " * held
                held = 0
            add(" " + p)
        elif p:
            out[-1] += " " * (held + 1) + p
            held = 0
        else:
            held += 1
    if held:
        out[-1] += " " * held
    return out if out[0] else out[1:]


# Fixed value: the characters of Unicode's White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The byte-level pattern treats white space before a word like this, and nothing else looks across it.
_WORDS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


def word_pieces(text: str) -> list[str]:
    """`text` cut at all white space, as the byte-level pattern itself cuts there; joined they are `text`.

    Finer than `pieces`, so more pieces repeat; only for tokenizers with exactly that pattern.
    """
    return _WORDS.findall(text)


class PieceTable:
    """Ids of pieces as bytes; missing ones are encoded together by `encode`."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cut: Callable[[str], list[str]] = pieces, kept: int = KEPT_PIECES):
        self.encode = encode
        self.cut = cut
        self.kept = kept
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        known = self.known
        missing = list(set().union(*cuts).difference(known))
        if len(known) + len(missing) > self.kept:
            known.clear()
            missing = list(set().union(*cuts))
        known.update(zip(missing, self.encode(missing), strict=True))
        out = [b"".join(map(known.__getitem__, c)) for c in cuts]
        for p in missing:
            if len(p) > KEPT_CHARS:
                del known[p]
        return out
