"""Words, lines and phrases of whole batches of texts, in numpy.

The texts of a batch lie one behind the other as code points. Every code point has a class; words, lines and the segments
of lines (list items, parts of sentences) follow from the places where classes change, hashes of words and phrases from
running sums. Nothing is done per word in Python. Texts are read whole, ``PIECE`` code points at a time: longer ones are cut at line
ends (a single line beyond that length is judged in pieces).
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Words of a phrase; a segment of fewer words is a phrase as it is.
SHINGLE = 5
#: Share of characters from which a line is code or data.
SIGNS = 0.04
PIECE = 1 << 17
LETTER, DIGIT, SPACE, SIGN, BREAK, JOIN, STOP, MARK = 1, 2, 4, 8, 16, 32, 64, 128
_SIGNS = "{}()[]=<>\"'`$@\\+&%^~:_"
_BREAKS = ",;|/•·●\t\n\r\"'()[]{}<>=:.!?、。，；！？।"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ORDERS = tuple(np.uint64(w) for w in (0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_kept: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class bits of every code point."""
    if "classes" not in _kept:
        kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        table = np.zeros(0x110000, np.uint8)
        table[(kinds == "L") | (kinds == "M")] = LETTER
        table[kinds == "N"] = DIGIT
        table[(kinds == "Z")] = SPACE
        for text, bit in ((" \t\n\r\v\f\x85", SPACE), (_SIGNS, SIGN), (_BREAKS, BREAK), ("-_", JOIN), (".!?。！？।", STOP), ("/*#-;%>+•", MARK)):
            table[[ord(c) for c in text]] |= bit
        _kept["classes"] = table
        _kept["powers"] = np.cumprod(np.full(1 << 16, _B | np.uint64(1)))
    return _kept["classes"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def name_hash(name: str) -> int:
    """A phrase hash of a name (a linked site)."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def pieces(texts: Sequence[str], most: int) -> Iterator[list[tuple[int, str]]]:
    """Groups of (number of the text, a piece of it), each group of about ``most`` code points."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + most)
            if end < len(t):
                best = t.rfind("\n", at, end)
                for mark in (",", ";", "|", "/", ". ", " "):  # a line of that length is cut where a phrase ends, if it can be
                    best = best if best >= at else t.rfind(mark, max(at, end - most // 2), end)
                end = best + 1 if best >= at else end
            group.append((i, t[at:end]))
            size += end - at
            at = end
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


@dataclass
class Scan:
    """Per text: characters, those in plain lines, words in plain lines without a sentence end, words, plain words, different plain words, and phrases (``upto``: n + 1 places)."""

    total: np.ndarray
    plain: np.ndarray
    loose: np.ndarray
    all_words: np.ndarray
    words: np.ndarray
    distinct: np.ndarray
    phrases: np.ndarray
    upto: np.ndarray


def _pairs(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, in order."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def scan(texts: Sequence[str], extra: Sequence[Sequence[int]] | None = None) -> Scan:
    """Evidence and phrases of lower-case texts; ``extra``: further phrase hashes of each text."""
    n = len(texts)
    total, plain, loose, every, words = (np.zeros(n, np.int64) for _ in range(5))
    word_at, word_of, phrase_at, phrase_of = [], [], [], []
    for group in pieces(texts, PIECE):
        t, p, f, e, w, at, word, pat, phrase = _scan_piece([s for _, s in group])
        number = np.array([i for i, _ in group])
        for whole, part in ((total, t), (plain, p), (loose, f), (every, e), (words, w)):
            np.add.at(whole, number, part)
        a, b = _pairs(number[at], word)
        word_at.append(a)
        word_of.append(b)
        a, b = _pairs(number[pat], phrase)
        phrase_at.append(a)
        phrase_of.append(b)
    if extra is not None:
        phrase_at.append(np.repeat(np.arange(n), [len(x) for x in extra]).astype(np.int64))
        phrase_of.append(np.array([h for x in extra for h in x], np.int64))
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    a, _ = _pairs(whole(word_at), whole(word_of))
    b, phrases = _pairs(whole(phrase_at), whole(phrase_of))
    return Scan(total, plain, loose, every, words, np.bincount(a, minlength=n), phrases, np.concatenate([[0], np.cumsum(np.bincount(b, minlength=n))]))


def _scan_piece(texts: list[str]):
    table = classes()
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table[np.minimum(points, 0x10FFFF)]
    size = np.array([len(t) + 1 for t in texts])
    text_end = np.cumsum(size)
    def sums(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, dtype=np.int32, out=out[1:])
        return out

    space = (kind & SPACE) > 0
    letter = (kind & LETTER) > 0

    # lines: code or data if signs are SIGNS or more of the characters behind the marks it begins with
    end = np.nonzero(points == 10)[0]
    start = np.concatenate([[0], end[:-1] + 1])
    solid = sums(~space)
    inked = solid[end] - solid[start]
    letters = np.nonzero(letter)[0]
    inner = np.nonzero((kind & (SPACE | MARK)) == 0)[0]
    first = np.minimum(np.append(inner, len(points))[np.searchsorted(inner, start)], end)
    signs = sums((kind & SIGN) > 0)
    behind = solid[end] - solid[first]
    marks = np.nonzero(~space)[0]
    last = np.searchsorted(marks, end) - 1
    closed = (last >= 0) & (inked > 0)
    closed[closed] = points[marks[last[closed]]] == ord(";")
    is_plain = (first < end) & (signs[end] - signs[first] + closed < SIGNS * behind)
    line_text = np.searchsorted(text_end, start, side="right")
    m = len(texts)
    total = np.bincount(line_text, inked, m).astype(np.int64)
    in_plain = np.bincount(line_text[is_plain], inked[is_plain], m).astype(np.int64)

    # words: runs of letters that aren't part of a code (a run of letters, digits and joiners that holds a digit)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    a, b = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    token = (kind & (LETTER | DIGIT | JOIN)) > 0
    opened = token.copy()
    opened[1:] &= ~token[:-1]
    token_of = np.cumsum(opened, dtype=np.int32)
    coded = np.zeros(token_of[-1] + 1, bool)
    coded[token_of[(kind & DIGIT) > 0]] = True
    own = ~coded[token_of[a]]
    line = np.searchsorted(end, a)
    every = np.bincount(line_text[line[own]], minlength=m)
    own &= is_plain[line]
    within = np.arange(len(letters)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    value = _mixed(points[letters].astype(np.uint64) + np.uint64(1)) * _kept["powers"][within & 0xFFFF]
    hashes = _mixed(np.add.reduceat(value, np.cumsum(b - a) - (b - a))) if len(a) else np.zeros(0, np.uint64)
    a, b, line, hashes = a[own], b[own], line[own], hashes[own]
    text = line_text[line]
    stop = (kind & STOP) > 0
    stop[:-1] &= space[1:]
    stop = sums(stop)
    free = stop[end] == stop[start]
    loose = np.bincount(text[free[line]], minlength=m)
    words = np.bincount(text, minlength=m)

    # segments: words with no break between them; a hyphen between spaces is one too
    parts = (kind & BREAK) > 0
    dash = np.nonzero(points[1:-1] == ord("-"))[0] + 1
    parts[dash[space[dash - 1] & space[dash + 1]]] = True
    parts = sums(parts)
    n = len(a)
    if not n:
        none = np.zeros(0, np.int64)
        return total, in_plain, loose, every, words, none, none, none, none
    opens = np.ones(n, bool)
    opens[1:] = parts[a[1:]] > parts[b[:-1]]
    s = np.nonzero(opens)[0]
    length = np.diff(np.append(s, n))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(hashes))])  # words of a phrase count in any order
    room = np.repeat(s + length, length) - np.arange(n)
    five = np.nonzero(room >= SHINGLE)[0]
    short = (length >= 2) & (length < SHINGLE)
    at = np.concatenate([five, s[short]])
    phrase = _mixed(np.concatenate([upto[five + SHINGLE] - upto[five], upto[(s + length)[short]] - upto[s[short]]]))
    return total, in_plain, loose, every, words, text, hashes.view(np.int64), text[at], phrase.view(np.int64)


def families(phrases: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Per text the least phrase under each of three orders (0 without phrases); copies of a file agree in most."""
    n = len(upto) - 1
    out = np.zeros((n, len(ORDERS)), np.int64)
    full = np.nonzero(np.diff(upto) > 0)[0]
    if len(full):
        for k, w in enumerate(ORDERS):
            out[full, k] = np.minimum.reduceat(phrases.view(np.uint64) * w, upto[full]).view(np.int64)
    return out
