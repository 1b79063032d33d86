"""Byte-level BPE in numpy: whole batches of texts at once.

A batch's texts lie one behind the other as bytes. Words are cut at boundaries found from the classes of neighbouring
code points; equal words are encoded once. New words go into padded matrices by length: in every round each row merges
its leftmost pair of least rank, pairs are looked up in an open-addressed hash table, and the matrix is compacted by the
one place each row has lost (rows without a pair leave).

Rows of more than ``WIDE`` bytes are cut into blocks that are merged like rows, side by side: a block's least pair may merge
in a round if no pair of the blocks beside it ranks lower. That gives the same ids as merging the whole row's least
pair first, since a block holds at least as many tokens as the longest token has bytes: a merge beyond the neighbouring
block could change a pair only by a token that covers that block. Equal pairs that overlap (a run of one token) are
paired off from the run's start, once all blocks of the run are free. So the time is in proportion to the length.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pandas as pd

#: Bytes of a word up to which it is one row of a padded matrix.
WIDE = 128
#: Bytes of text handled at once, and words a worker keeps encoded.
CHUNK_BYTES = 2_000_000
KEPT_WORDS = 400_000
TABLE_BITS = 19
_MISS = np.int32(1 << 30)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that the pattern of the tokenizer splits off after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def load_merges(path: str) -> dict[str, np.ndarray]:
    """The vocabulary file as arrays: left, right and merged id by rank, and the id of each byte."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    # byte-level vocabularies write a byte as a printable character: itself if printable, else the next from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + n)
    return checked({
        "left": np.array([vocab[a] for a, _ in pairs], np.int32),
        "right": np.array([vocab[b] for _, b in pairs], np.int32),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int32),
        "byte_id": np.array([vocab[shown[b]] for b in range(256)], np.int32),
    })


def checked(merges: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The merges, if each one comes behind those that make its parts (all that is done here depends on it), with ``longest``,
    the bytes of the longest token."""
    made: dict[int, int] = {int(i): 1 for i in merges["byte_id"]}
    for a, b, c in zip(merges["left"].tolist(), merges["right"].tolist(), merges["merged"].tolist()):
        if a not in made or b not in made or c in made:
            raise ValueError(f"the merge of {a} and {b} to {c} comes before its parts are made, or makes a token again")
        made[c] = made[a] + made[b]
    return merges | {"longest": np.array(max(made.values()))}


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table[kinds == "L"] = LETTER
    table[kinds == "N"] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


class Encoder:
    def __init__(self, merges: dict[str, np.ndarray]):
        self.byte_id, self.merged = merges["byte_id"], np.append(merges["merged"], 0).astype(np.int32)
        self.classes = _classes()
        self.block = max(64, int(merges["longest"]))
        key = merges["left"].astype(np.uint64) << np.uint64(32) | merges["right"].astype(np.uint64)
        size = 1 << TABLE_BITS
        self.keys, self.ranks, self.probes = np.full(size, np.uint64(1 << 63)), np.full(size, _MISS, np.int32), 0
        at, left = self._slot(key), np.arange(len(key))
        while len(left):  # open addressing, all keys a step at a time
            self.probes += 1
            free = self.keys[at[left]] == np.uint64(1 << 63)
            _, lead = np.unique(at[left], return_index=True)
            put = np.zeros(len(left), bool)
            put[lead] = True
            put &= free
            won = left[put]
            self.keys[at[won]], self.ranks[at[won]] = key[won], won
            left = left[~put]
            at[left] = (at[left] + 1) & (size - 1)
        rng = np.random.default_rng(7)
        self.noise = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = CHUNK_BYTES + 1
        self.powers, self.inverses = np.full(n, base), np.full(n, inverse)
        self.powers[0] = self.inverses[0] = 1
        self.powers, self.inverses = np.cumprod(self.powers), np.cumprod(self.inverses)
        self.words: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.words.clear()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_MISS`` if it doesn't merge; negative ids (padding) never do."""
        key = a.astype(np.uint64) << np.uint64(32) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], _MISS)
        todo = np.nonzero((out == _MISS) & (self.keys[at] != np.uint64(1 << 63)))
        for _ in range(self.probes - 1):
            if not len(todo[0]):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            hit = self.keys[at[todo]] == key[todo]
            out[tuple(t[hit] for t in todo)] = self.ranks[at[todo]][hit]
            more = ~hit & (self.keys[at[todo]] != np.uint64(1 << 63))
            todo = tuple(t[more] for t in todo)
        return out

    def _merge_rows(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids: rows x places, -1 after a row's end. Gives (row numbers, their final ids) in groups."""
        done, rows = [], np.arange(len(ids))
        rank = self._rank(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.zeros((len(ids), 0), np.int32)
        while len(rows):
            if not rank.shape[1]:
                done.append((rows, ids))
                break
            at = rank.argmin(axis=1)  # the leftmost of the least
            least = rank[np.arange(len(rows)), at]
            go = least != _MISS
            if not go.all():
                done.append((rows[~go], ids[~go]))
                rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
                if not len(rows):
                    break
            n, w = ids.shape
            line = np.arange(n)
            ids[line, at] = self.merged[least]
            keep = np.ones((n, w), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            if w - 1 == 1:
                done.append((rows, ids))
                break
            keep = np.ones((n, w - 1), bool)
            keep[line, np.minimum(at, w - 2)] = False
            rank = rank[keep].reshape(n, w - 2)
            left = np.nonzero(at > 0)[0]
            if len(left):
                rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.nonzero(at < w - 2)[0]
            if len(right):
                rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])
        return done

    def _merge_blocks(self, ids: np.ndarray) -> np.ndarray:
        """ids: rows one behind the other, each ended by -1. Gives their final ids likewise."""
        size = self.block
        rank = np.append(self._rank(ids[:-1], ids[1:]), _MISS)
        while True:
            n = len(ids)
            count = -(-n // size)
            whole = np.full(count * size, _MISS, np.int32)
            whole[:n] = rank
            least = np.full(count + 2, _MISS, np.int32)
            least[1:-1] = whole.reshape(count, size).min(axis=1)
            own = least[1:-1]
            free = (own != _MISS) & (own <= least[:-2]) & (own <= least[2:])
            if not free.any():
                return ids
            own = np.where(free, own, -1)
            at = np.nonzero((whole.reshape(count, size) == own[:, None]).ravel())[0]
            opens = np.ones(len(at), bool)
            opens[1:] = (np.diff(at) != 1) | (rank[at[1:]] != rank[at[:-1]])
            if not opens.all():  # runs: paired off from their start, if no block that they touch has to wait
                run = np.cumsum(opens) - 1
                first, last = at[opens], at[np.append(np.nonzero(opens)[0][1:], len(at)) - 1]
                held = np.concatenate([[0], np.cumsum(~free)])
                waits = ((first > 0) & (rank[first - 1] == rank[first])) | ((last + 1 < n) & (rank[np.minimum(last + 1, n - 1)] == rank[last]))
                waits |= held[last // size + 1] > held[first // size]
                at = at[((at - first[run]) % 2 == 0) & ~waits[run]]
            else:
                waits = ((at > 0) & (rank[at - 1] == rank[at])) | (rank[np.minimum(at + 1, n - 1)] == rank[at])
                at = at[~waits]
            ids[at] = self.merged[rank[at]]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged places are now
            rank[at] = self._rank(ids[at], ids[np.minimum(at + 1, len(ids) - 1)])
            before = at[at > 0] - 1
            rank[before] = self._rank(ids[before], ids[before + 1])

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Encode words not yet kept; their numbers in the store."""
        size = np.array([len(w) for w in new])
        text = np.frombuffer(b"".join(new), np.uint8)
        start = np.cumsum(size) - size
        result: list[np.ndarray] = [None] * len(new)  # type: ignore[list-item]
        bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for k in np.unique(bucket):
            rows = np.nonzero(bucket == k)[0]
            if (1 << k) > WIDE:
                ids = np.full(int(size[rows].sum()) + len(rows), -1, np.int32)
                ends = np.cumsum(size[rows] + 1) - 1
                inner = np.ones(len(ids), bool)
                inner[ends] = False
                ids[inner] = self.byte_id[text[np.repeat(start[rows] - (ends - size[rows]), size[rows]) + np.nonzero(inner)[0]]]
                ids = self._merge_blocks(ids)
                for r, row in zip(rows, np.split(ids, np.nonzero(ids < 0)[0] + 1)):
                    result[r] = row[:-1]
                continue
            for part in np.array_split(rows, max(1, len(rows) * (1 << k) // 1_000_000)):
                w = int(size[part].max())
                place = np.arange(w)[None, :]
                there = place < size[part][:, None]
                ids = np.where(there, self.byte_id[text[np.minimum(start[part][:, None] + place, len(text) - 1)]], -1).astype(np.int32)
                for done, got in self._merge_rows(ids):
                    n = (got >= 0).sum(axis=1)
                    for r, row, m in zip(part[done], got, n):
                        result[r] = row[:m]
        length = np.array([len(r) for r in result])
        flat = np.concatenate(result)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.int32)])
        while self.n + len(new) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(new)] = self.used + np.cumsum(length) - length
        self.length[self.n : self.n + len(new)] = length
        self.used += len(flat)
        number = np.arange(self.n, self.n + len(new))
        self.n += len(new)
        return number

    def _cuts(self, text: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Byte places where words start. text: UTF-8 of all texts; docs: byte place where each non-empty text starts."""
        ascii_only = not (text & 0x80).any()
        points = text if ascii_only else np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if ascii_only:
            place, doc = None, docs
        else:
            place = np.nonzero((text & 0xC0) != 0x80)[0]
            doc = np.searchsorted(place, docs)
        kind = self.classes[points]
        n = len(points)
        new_doc = np.zeros(n + 1, bool)
        new_doc[doc] = True
        new_doc[n] = True
        first = np.empty(n + 1, bool)
        first[1:n] = kind[1:] != kind[:-1]
        first[0] = first[n] = True
        first |= new_doc
        runs = np.nonzero(first)[0]
        begin, end = runs[:-1], runs[1:]
        start = first
        # white space before a word: its last character starts anew, and a plain space joins the word
        s = np.nonzero((kind[begin] == SPACE) & ~new_doc[end])[0]
        last = end[s] - 1
        start[last] = True
        plain = points[last] == 32
        start[end[s][plain]] = False
        # an apostrophe alone, at the start of a word, takes a short ending of the letters behind it
        q = np.nonzero((points[begin] == 39) & (end - begin == 1) & ~new_doc[end] & start[begin])[0]
        q = q[kind[end[q]] == LETTER]
        if len(q):
            letters = end[q]
            close = end[q + 1]
            c1 = points[letters]
            c2 = np.where(letters + 1 < close, points[np.minimum(letters + 1, n - 1)], 0)
            take = np.where(np.isin(c1, [ord(c) for c in SHORT_ENDINGS]), 1, 0)
            for a, b in LONG_ENDINGS:
                take = np.where((c1 == ord(a)) & (c2 == ord(b)), 2, take)
            hit = take > 0
            start[letters[hit]] = False
            start[letters[hit] + take[hit]] = True
        cuts = np.nonzero(start[:n])[0]
        return cuts if place is None else place[cuts]

    def _chunk(self, text: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of a chunk and, per word, its byte place."""
        cuts = self._cuts(text, docs)
        ends = np.append(cuts[1:], len(text))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.noise[text] * self.powers[: len(text)])])
        mark = (total[ends] - total[cuts]) * self.inverses[cuts] + (ends - cuts).astype(np.uint64)
        code, _ = pd.factorize(mark)
        lead = np.full(code.max() + 1, -1, np.int64)
        lead[code[::-1]] = np.arange(len(code))[::-1]
        # equal marks must be equal words: compare every byte with that of the word's first place
        size = ends - cuts
        same = np.arange(len(text)) + np.repeat(cuts[lead[code]] - cuts, size)
        wrong = size != size[lead[code]]
        if not wrong.any():
            differ = text != text[same]
            if differ.any():
                wrong = np.add.reduceat(differ, cuts) > 0
        raw = text.tobytes()
        names = [raw[a:b] for a, b in zip(cuts[lead].tolist(), ends[lead].tolist())]
        number = np.array([self.words.get(w, -1) for w in names], np.int64)
        todo = np.nonzero(number < 0)[0]
        if len(todo):
            new = [names[i] for i in todo]
            got = self._learn(new)
            self.words.update(zip(new, got.tolist()))
            number[todo] = got
        word = number[code]
        for i in np.nonzero(wrong)[0]:
            w = raw[cuts[i] : ends[i]]
            if w not in self.words:
                self.words[w] = int(self._learn([w])[0])
            word[i] = self.words[w]
        return word, cuts

    def encode(self, text: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """text: UTF-8 bytes; offsets: n + 1 places of n texts. Gives the ids one behind the other (empty if not ``ids``)
        and the n + 1 places of each text's ids."""
        n = len(offsets) - 1
        counts, parts = np.zeros(n, np.int64), []
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
            base = int(offsets[i])
            piece = text[base : int(offsets[j])]
            if len(piece):
                if len(piece) >= len(self.powers):
                    self._grow(len(piece) + 1)
                if self.n > KEPT_WORDS:
                    self._clear()
                at = offsets[i:j] - base
                size = offsets[i + 1 : j + 1] - offsets[i:j]
                word, cuts = self._chunk(piece, at[size > 0])
                length = self.length[word]
                upto = np.concatenate([[0], np.cumsum(length)])
                edge = np.searchsorted(cuts, np.append(at, len(piece)))
                counts[i:j] = np.diff(upto[edge])
                if ids:
                    parts.append(self.flat[np.arange(upto[-1]) + np.repeat(self.start[word] - upto[:-1], length)])
            i = j
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])

    def _grow(self, n: int) -> None:
        for name in ("powers", "inverses"):
            step = np.full(n, getattr(self, name)[1])
            step[0] = 1
            setattr(self, name, np.cumprod(step))


def encoder(merges: dict[str, np.ndarray], name: str) -> Encoder:
    """The process's encoder for a vocabulary: Python workers are reused, and so are the words they know."""
    kept = sys.__dict__.setdefault("_tidemark_encoders", {})
    if name not in kept:
        kept.clear()
        kept[name] = Encoder(merges)
    return kept[name]
