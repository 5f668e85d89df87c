"""BPE encoding and decoding of whole texts.

A word's symbols form a doubly linked list; candidate merges wait in a priority queue ordered by (rank, place). A popped
entry whose symbols have changed since it was pushed is stale and skipped. Decoding concatenates vocabulary strings.

The vocabulary file is a tokenizers JSON; its normalisers, pre-tokeniser and added tokens are honoured for the shape of
``word_bpe_49k.json`` (NFC, white space to a blank, lower case; word ends marked by a suffix; no decoder, so decoded
tokens are joined by blanks).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fringework.llm import common

#: Unicode White_Space, which the vocabulary files' ``\\s`` stands for.
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters and numbers up to U+02AF, for texts that have no character beyond it.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
LATIN_N = "0-9²³¹¼-¾"
BEYOND_LATIN = re.compile("[^\x00-ʯ]")
WORDS_LATIN = re.compile(rf"[{LATIN}]+|'(?:[stmd]|re|ve|ll)|[{LATIN_N}]|[^{SPACE}{LATIN}{LATIN_N}]+")


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others take the letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordCache(dict):
    """Word to encoded ids, in two generations: the older one goes when the younger one is full, so frequent words stay."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.old = most, {}

    def put(self, word, ids: bytes) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take blanks with them or are looked for after normalising aren't supported")
        self.mark = os.path.commonprefix(list(self.added))  # a text without it holds no added token
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        from tokenizers import Regex, normalizers, pre_tokenizers

        #: Which characters are letters, numbers or white space, and what their lower case is, follows the library's Unicode version.
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"]), " "), normalizers.Lowercase()])
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings = [""] * size
        for s, i in (*vocab.items(), *self.added.items()):
            self.strings[i] = s
        letters = byte_letters()
        self.inner = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + self.end, -1) for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]
        self.cache = WordCache()

    def encode_word(self, word: str) -> list[int]:
        """Merge one word: heap of ``rank, place`` over linked symbols."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, merges = self.inner, self.merges
        sym = [inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        n = len(sym)
        if n == 1:
            return sym
        heap = []
        for i in range(n - 1):
            m = merges.get(sym[i] << 32 | sym[i + 1])
            if m is not None:
                heap.append((m[0], i, m[1]))
        if not heap:
            return sym
        heapq.heapify(heap)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, new = pop(heap)
            left = sym[i]
            if left < 0:
                continue
            j = nxt[i]
            if j >= n:
                continue
            m = merges.get(left << 32 | sym[j])
            if m is None or m[1] != new:  # stale: one of the two has been merged since
                continue
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                m = merges.get(new << 32 | sym[k])
                if m is not None:
                    push(heap, (m[0], i, m[1]))
            h = prev[i]
            if h >= 0:
                m = merges.get(sym[h] << 32 | new)
                if m is not None:
                    push(heap, (m[0], h, m[1]))
        return [s for s in sym if s >= 0]

    def words(self, text: str) -> list[str]:
        lower = text.lower()
        if not text.isascii() and (BEYOND_LATIN.search(text) or BEYOND_LATIN.search(lower)):
            return [w for w, _ in self.split.pre_tokenize_str(self.normalise.normalize_str(text))]
        return WORDS_LATIN.findall(lower)  # up to U+02AF all characters are composed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.split_added and self.mark in text:
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in self.split_added.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        cache, words = self.cache, self.words(text)
        ids = list(map(cache.get, words))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    w = words[i]
                    ids[i] = cache.get(w) or cache.put(w, cache.old.get(w) or np.array(self.encode_word(w), "<u4").tobytes())
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str) -> Bpe:
    """One instance, with its cache, for each Python worker."""
    return common.held(("bpe", path), lambda: Bpe(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each row: ``id_col, ids binary (little-endian uint32), n_tokens, decoded``.

    A null text counts as the empty text; both have no tokens. Rows with a null or repeated id are encoded like any
    other; extra columns are ignored. An empty table gives an empty result.
    """
    return _run(docs, path, id_col, text_col, digests=False)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests of the ids and of the decoded text in their place."""
    return _run(docs, path, id_col, text_col, digests=True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    common.ship(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in common.slices(batches, 1):
            ids = [bpe.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                cols = {"n_tokens": n, "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string())}
            else:
                cols = {"ids": pa.array(ids, pa.binary()), "n_tokens": n, "decoded": pa.array([bpe.decode(x) for x in ids], pa.string())}
            yield pa.RecordBatch.from_arrays([b.column(0), *cols.values()], names=[id_col, *cols])

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, n_tokens long, decoded string"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {rest}")
