"""Ids of whole texts by the tokenizers library, which sees each distinct pre-token once per worker.

Pre-tokens don't depend on each other. Those of a slice of texts are found with array operations over its code points,
told apart by two 64-bit hashes, and looked up in a sorted table of pre-tokens that the library has encoded; what is new
there goes to the library in one call. Texts with characters beyond U+02AF, or that might hold an added token, go to it whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from fringework.llm import common
from fringework.llm.bpe import BEYOND_LATIN, LATIN, LATIN_N, SPACE

MOST_CHARS = 900_000  # of a slice
POWERS = 1 << 20  # kept; a longer slice, which is one text, computes its own
BLANK, WHITE, LETTER, NUMBER, OTHER = range(5)


def _class_table() -> np.ndarray:
    import re

    out = np.full(0x2B0, OTHER, np.uint8)
    for pattern, kind in ((f"[{LATIN}]", LETTER), (f"[{LATIN_N}]", NUMBER), (f"[{SPACE}]", WHITE), (" ", BLANK)):
        out[[c for c in range(0x2B0) if re.match(pattern, chr(c))]] = kind
    return out


_class = _class_table()
_odd = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


@functools.cache
def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_odd[k])
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of each piece."""
    up, down = _powers(k, POWERS) if len(codes) < POWERS else _powers.__wrapped__(k, len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Ids:
    """``encode`` gives the ids of each text, little-endian, in ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4", most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        self.dtype, self.most = dtype, most
        self._forget()
        #: lower-cased words without white space, or byte-level pieces with a blank before them
        self.words = [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        known = self.words or (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm)
        self.fast = known and all(t["content"].startswith("<|") for t in spec["added_tokens"])

    def _forget(self) -> None:
        """Empty the table: two hashes of each piece, ascending by the first, and where its ids lie in ``flat``."""
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held, places, size = [], [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            low = t.lower() if self.words else t
            if not self.fast or "<|" in t or len(t) > 10 * MOST_CHARS or BEYOND_LATIN.search(low) or (self.words and BEYOND_LATIN.search(t)):
                out[i] = self.whole(t)
                continue
            held.append(low)
            places.append(i)
            size += len(low)
            if size >= MOST_CHARS:
                for p, x in zip(places, self._slice(held), strict=True):
                    out[p] = x
                held, places, size = [], [], 0
        if held:
            for p, x in zip(places, self._slice(held), strict=True):
                out[p] = x
        return out

    def pieces(self, codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each pre-token. cuts: where texts begin."""
        n = len(codes)
        kind = _class[codes]
        white = kind <= WHITE
        group = np.where(white, np.uint8(WHITE), kind)
        first = np.zeros(n + 1, bool)
        first[cuts] = first[n] = True
        start = first.copy()
        start[1:n] |= group[1:] != group[:-1]
        inside = ~first[1:]  # the next character belongs to the same text
        if self.words:
            start[:n] |= kind == NUMBER
        else:
            last = np.zeros(n, bool)  # the last white character before something else
            last[:-1] = white[:-1] & ~white[1:] & inside[:-1]
            start[:n] |= last
            start[1:] &= ~(last & (kind == BLANK))
        # 's 't 'm 'd 're 've 'll are pieces if the apostrophe begins one.
        at = np.flatnonzero((codes[:-1] == 39) & start[: n - 1] & (kind[1:] == LETTER) & inside[:-1])
        if len(at):
            c1 = codes[at + 1]
            c2 = np.where(at + 2 < n, codes[np.minimum(at + 2, n - 1)], 0)
            c2[(at + 2 < n) & first[np.minimum(at + 2, n)]] = 0
            one = np.isin(c1, [115, 116, 109, 100])
            two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
            start[at[one | two] + 1] = False
            start[at[one] + 2] = start[at[two] + 3] = True
        edges = np.flatnonzero(start)
        s, e = edges[:-1], edges[1:]
        if self.words:
            keep = ~white[s]
            s, e = s[keep], e[keep]
        return s, e

    def _slice(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        cuts = np.cumsum([0, *map(len, texts)])
        s, e = self.pieces(codes, cuts[:-1])
        h = _hashes(codes, s, e, 0)
        order = np.argsort(h)
        sorted_ = h[order]
        new = np.ones(len(h), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        sample = order[new]
        second = _hashes(codes, s, e, 1)
        h1, h2 = sorted_[new], second[sample]
        if (second != h2[number]).any():
            return [self.whole(t) for t in texts]  # two pieces with one hash
        if len(self.h1) > self.most:
            self._forget()
        place = np.searchsorted(self.h1, h1)
        known = np.zeros(len(h1), bool)
        if len(self.h1):
            near = np.minimum(place, len(self.h1) - 1)
            known = self.h1[near] == h1
            if (self.h2[near[known]] != h2[known]).any():
                return [self.whole(t) for t in texts]
        starts, lengths = np.empty(len(h1), np.int64), np.empty(len(h1), np.int64)
        starts[known], lengths[known] = self.at[place[known]], self.many[place[known]]
        gone = ~known
        if gone.any():
            at = sample[gone]
            many = self._learn([joined[x:y] for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            lengths[gone] = many
            starts[gone] = self.used - many.sum() + np.cumsum(many) - many
            for name, own in (("h1", h1), ("h2", h2), ("at", starts), ("many", lengths)):
                setattr(self, name, np.insert(getattr(self, name), place[gone], own[gone]))
        many = lengths[number]
        ends = np.cumsum(many)
        source = np.repeat(starts[number] - (ends - many), many)
        source += np.arange(len(source))
        raw = self.flat[source].tobytes()
        bounds = np.concatenate([[0], ends])[np.searchsorted(s, cuts)] * self.flat.itemsize
        return [raw[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Append the ids of new pieces to ``flat``; how many each has."""
        e = self.lib.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, self.dtype)
        many = np.bincount(np.array([w for w in e.word_ids if w is not None], np.int64), minlength=len(pieces))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), self.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return many


def load(path: str, dtype: str = "<u4") -> Ids:
    """One instance, with its table, for each Python worker."""
    return common.held(("tokens", path, dtype), lambda: Ids(path, dtype))
