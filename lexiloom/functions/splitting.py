"""Boundary-aware splitting of one text, in time that grows with its length: what a task of the chunker runs on its rows.

Blanks, sentence ends and headings are those of functions/text.py.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
SENTENCE_END = re.compile(r"(?<=[다요임함])\.[\t-\r ]|(?<=[.!?])[\t-\r ]")
HEADING = re.compile(r"^#{1,6}[\t-\r ]+", re.MULTILINE)
_HIDDEN = str.maketrans("", "", "​﻿")
_TRAILING = re.compile(r"(?<![ \t])[ \t]+\n")  # tried where a run begins only
_EMPTY_LINES = re.compile(r"\n{3,}")


def normalized(text: str) -> str:
    """Without zero-width marks, blanks before line feeds, runs of empty lines and blanks at both ends."""
    return _EMPTY_LINES.sub("\n\n", _TRAILING.sub("\n", text.translate(_HIDDEN))).strip(BLANKS)


def _stripped(parts: list[str]) -> list[str]:
    return [p for p in (part.strip(BLANKS) for part in parts) if p]


def sentences(text: str) -> list[str]:
    return _stripped(SENTENCE_END.split(text))


def packed(units: list[str], size: int, joiner: str) -> list[str]:
    """Units joined greedily while a piece has at most `size` characters, the joiner counted."""
    out: list[list[str]] = []
    held = 0
    for unit in units:
        if out and held + len(joiner) + len(unit) <= size:
            out[-1].append(unit)
            held += len(joiner) + len(unit)
        else:
            out.append([unit])
            held = len(unit)
    return [joiner.join(piece) for piece in out]


def fixed(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def pieces(text: str, size: int, paragraph: str = "\n\n") -> list[str]:
    """Pieces of at most `size` characters: the whole, else paragraphs, else sentences, else fixed cuts."""
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    for piece in packed(_stripped(text.split(paragraph)), size, "\n\n"):
        for part in [piece] if len(piece) <= size else packed(sentences(piece), size, " "):
            out += [part] if len(part) <= size else fixed(part, size)
    return out


def overlapped(parts: list[str], overlap: int) -> list[str]:
    """Each piece but the first behind the last sentence of its predecessor's last `overlap` characters."""
    if overlap <= 0:
        return parts
    tails = (sentences(p[-overlap:]) for p in parts[:-1])
    return parts[:1] + [f"{tail[-1]} {p}" if tail else p for tail, p in zip(tails, parts[1:], strict=True)]


def sections(text: str) -> Iterator[tuple[str, str]]:
    """Heading and body of each heading's section; what stands before the first heading has an empty one."""
    first, *rest = HEADING.split(text)
    yield "", first.strip(BLANKS)
    for part in rest:
        heading, _, body = part.partition("\n")
        yield heading.strip(BLANKS), body.strip(BLANKS)


def chunks(text: str, size: int, overlap: int, paragraph: str = "\n\n") -> list[tuple[str, str]]:
    """Heading and text of each chunk of a text; one that isn't empty gives a chunk at least."""
    plain = normalized(text)
    out = [(heading, p) for heading, body in sections(plain) for p in overlapped(pieces(body, size, paragraph), overlap) if p]
    return out or [("", p) for p in pieces(plain, size, paragraph)]
