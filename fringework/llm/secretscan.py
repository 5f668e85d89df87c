"""Secret scans through nested encodings.

A worklist holds the layers of a text: the text itself, then what its percent escapes, Unicode escapes, base64 runs and
compressed base64 runs decode to, and so on until nothing new appears; a layer seen before in the same text is not taken
again, which ends cycles. Each layer is scanned and its finds are mapped to spans of the original text: those in escapes
character by character, those in a base64 run to the run. Compressed layers of any size are unwrapped member by member in
windows; a window ends where no token can go on, so that none is cut.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fringework.llm import common

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as ``+`` would take it
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Decoded bytes are scanned in windows of about this size; one grows while a single run goes on.
WINDOW = 4 << 20
PIECE = 1 << 20  # inflated at a time
#: After these bytes no find, run or escape goes on, in one-byte text or UTF-16; a blank between letters ends them as well.
BREAK = re.compile(rb"[^A-Za-z0-9+/_.=\-\"':%\\{}&#;\s\x00]|\x00\x00")
BLANK = re.compile(rb"[A-Za-z0-9]\x20(?=[A-Za-z]{3})")  # backwards
WIDE = re.compile(rb"(?:[\x01-\x7f]\x00){13}")

Span = tuple[str, int, int]


def find(text: str, lower: str | None = None, runs: bool = True) -> list[Span]:
    """The spans of each kind, leftmost and non-overlapping within a kind. runs: whether a run of 16 or more may occur."""
    lower = text.lower() if lower is None else lower
    out = []
    if any(w in lower for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if runs:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A decoded text and the places of the original that its characters come from, in runs.

    Run i goes from ``starts[i]`` on: where ``his[i]`` is negative, its characters are those of the original from ``los[i]``
    on, one by one; otherwise it is what the original from ``los[i]`` to ``his[i]`` stands for. Without runs the text is the
    original itself; ``whole`` is the one span that all characters come from.
    """

    __slots__ = ("text", "starts", "los", "his", "whole")

    def __init__(self, text: str, runs: tuple[list[int], list[int], list[int]] | None = None, whole: tuple[int, int] | None = None):
        self.text, self.whole = text, whole
        self.starts, self.los, self.his = runs or (None, None, None)

    def key(self) -> bytes:
        ends = self.whole or (self.span(0, len(self.text)) if self.text else (0, 0))
        return hashlib.sha256(repr((ends, self.text)).encode()).digest()

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original behind characters ``start`` to ``end``; places never go back."""
        if self.whole is not None:
            return self.whole
        if self.starts is None:
            return start, end
        i, j = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_right(self.starts, end - 1) - 1
        low = self.los[i] + (start - self.starts[i] if self.his[i] < 0 else 0)
        return low, self.his[j] if self.his[j] >= 0 else self.los[j] + end - self.starts[j]

    def replaced(self, parts: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
        """This layer with each (start, end) in the place of its decoded characters (character, start, end in this layer)."""
        text, at, size = [], 0, 0
        runs: tuple[list[int], list[int], list[int]] = ([], [], [])

        def keep(a: int, b: int) -> None:
            nonlocal size
            text.append(self.text[a:b])
            if a < b and self.starts is None:
                self._put(runs, size, a, -1)
            elif a < b:
                for i in range(bisect.bisect_right(self.starts, a) - 1, len(self.starts)):
                    s = max(self.starts[i], a)
                    if s >= b:
                        break
                    self._put(runs, size + s - a, self.los[i] + (s - self.starts[i] if self.his[i] < 0 else 0), self.his[i])
            size += b - a

        if self.whole is not None:
            for start, end, chars in parts:
                text += [self.text[at:start], *(c for c, _, _ in chars)]
                at = end
            return Layer("".join(text) + self.text[at:], None, self.whole)
        for start, end, chars in parts:
            keep(at, start)
            for c, a, b in chars:
                text.append(c)
                self._put(runs, size, *self.span(a, b))
                size += len(c)
            at = end
        keep(at, len(self.text))
        return Layer("".join(text), runs)

    @staticmethod
    def _put(runs: tuple[list[int], list[int], list[int]], start: int, lo: int, hi: int) -> None:
        for x, value in zip(runs, (start, lo, hi), strict=True):
            x.append(value)


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    raw, out, i = bytes.fromhex(m[0].replace("%", "")), [], 0
    while i < len(raw):
        size = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
        try:
            c = raw[i : i + size].decode()
        except UnicodeDecodeError:
            c, size = raw[i : i + 1].decode("latin-1"), 1
        out.append((c, m.start() + 3 * i, m.start() + 3 * (i + size)))
        i += size
    return out


def _escapes(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for u in UNIT.finditer(m[0]):
        g = next(i for i, x in enumerate(u.groups()) if x is not None)
        n = int(u.groups()[g], 10 if g == 4 else 16)
        at, end = m.start() + u.start(), m.start() + u.end()
        if 0xDC00 <= n < 0xE000 and out and len(out[-1][0]) == 1 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, start, _ = out.pop()
            out.append((chr(0x10000 + (ord(high) - 0xD800 << 10) + n - 0xDC00), start, end))
        else:
            out.append((chr(n) if n < 0x110000 else "�", at, end))
    return out


def _unbase64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _opener(raw: bytes) -> Callable | None:
    """What unwraps a compressed layer that starts so."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 5 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
        return lambda: zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if raw[:6] == b"\xfd7zXZ\x00":
        return lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    return None


def _inflate(chunks: Iterator[bytes], left: set[bytes]) -> Iterator[bytes]:
    """The content of all members of a compressed layer in pieces, up to its end or damage; ``left`` gets the head of one that
    takes too much memory to unwrap."""
    data = b""
    while True:
        while len(data) < 8 and (more := next(chunks, None)) is not None:
            data = (data + more).lstrip(b"\0")  # padding between members
        head, make = data[:64], _opener(data)
        if make is None:
            return
        d = make()
        try:
            while not d.eof:
                if not data and getattr(d, "needs_input", True) and not (data := next(chunks, b"")):
                    return
                out = d.decompress(data, PIECE)
                data = getattr(d, "unconsumed_tail", b"")
                if out:
                    yield out
        except lzma.LZMAError as e:
            if "emory" in str(e):
                left.add(head)
            return
        except (zlib.error, OSError, EOFError, ValueError):
            return
        data = (d.unused_data + data if not hasattr(d, "unconsumed_tail") else d.unused_data).lstrip(b"\0")


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes in windows that end where no token can go on; together they are all bytes."""
    held, want = bytearray(), WINDOW
    for c in chunks:
        held += c
        if len(held) >= want:
            back = bytes(held[::-1])
            if m := BREAK.search(back):
                cut = len(held) - m.start()
            elif m := BLANK.search(back):
                cut = len(held) - m.start() - 1
            else:
                want = 2 * len(held)
                continue
            yield bytes(held[:cut])
            del held[:cut]
            want = len(held) + WINDOW
    if held:
        yield bytes(held)


def _views(raw: bytes) -> Iterator[str]:
    """Bytes as text: finds are ASCII, so one byte a character shows those of all one-byte forms and UTF-8; and as UTF-16 of either
    order and alignment where some stretch has that form."""
    yield raw.decode("latin-1")
    if WIDE.search(raw):
        for at in (0, 1):
            yield (raw[at:] + b"\0" * ((len(raw) - at) % 2)).decode("utf-16-le", "replace")


def _texts(raw: bytes, left: set[bytes]) -> Iterator[str]:
    """All texts in decoded bytes: their own, and those of the compressed layers that lie in each other."""
    if _opener(raw) is None:
        yield from _views(raw)
        return
    source: Callable[[], Iterator[bytes]] = lambda: iter([raw])
    seen: set[bytes] = set()
    while True:
        digest, head = hashlib.sha256(), b""
        for window in _windows(source()):
            head = head or window
            digest.update(window)
            yield from _views(window)
        if digest.digest() in seen or _opener(head) is None:  # a compressed layer can hold itself
            return
        seen.add(digest.digest())
        source = lambda inner=source: _inflate(inner(), left)


def _wrapped(m: re.Match) -> Iterator[tuple[str, int, int, bool]]:
    """Ways to read base64 on several lines: the joined run, its place, and whether it may be too long.

    Encoders wrap at one width: lines of equal length belong together with a shorter one after them, perhaps with the rest of
    the line before; other ways count only where no closer place has the same kind of find.
    """
    lines = [(x[0], m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[A-Za-z0-9+/_=-]+", m[0])]

    def part(i: int, j: int, loose: bool) -> tuple[str, int, int, bool]:
        run = "".join(x[0] for x in lines[i:j])
        return run[: len(run) - (len(run.rstrip("=")) % 4 == 1)], lines[i][1], lines[j - 1][2], loose

    i = 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and len(lines[j][0]) == len(lines[i][0]):
            j += 1
        width = len(lines[i][0])
        more = j < len(lines) and len(lines[j][0]) < width
        whole = more and (sum(len(x[0]) for x in lines[i : j + 1])) % 4 == 0
        if width >= 16:
            if whole:
                yield part(i, j + 1, False)
            else:
                if j - i > 1:
                    yield part(i, j, False)
                if more:
                    yield part(i, j + 1, True)
            if i:
                yield part(i - 1, j + more, True)
        i = j
    yield part(0, len(lines), True)


def _decoded(layer: Layer, loose: bool, left: set[bytes]) -> Iterator[tuple[Layer, bool]]:
    """What escapes and base64 runs of a layer decode to, and whether its places may be too long."""
    if "%" in layer.text and (parts := [(*m.span(), _percent(m)) for m in PERCENT.finditer(layer.text)]):
        yield layer.replaced(parts), loose
    if ("\\" in layer.text or "&#" in layer.text) and (parts := [(*m.span(), _escapes(m)) for m in ESCAPE.finditer(layer.text)]):
        yield layer.replaced(parts), loose
    for m in RUN.finditer(layer.text):
        pieces = [m.span()]
        if any(c in m[0] for c in "/+-_"):  # a path or a name may stand before the run proper
            pieces += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[A-Za-z0-9]{16,}={0,2}", m[0]) if p.span() != (0, len(m[0]))]
        for a, b in pieces:
            if raw := _unbase64(layer.text[a:b]):
                for x in _texts(raw, left):
                    yield Layer(x, None, layer.span(a, b)), loose
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            for run, a, b, wide in _wrapped(m):
                if raw := _unbase64(run):
                    for x in _texts(raw, left):
                        yield Layer(x, None, layer.span(a, b)), loose or wide


def scan(text: str | None) -> tuple[list[Span], list[Span], int]:
    """Spans of the text itself, all spans (those found in decoded layers too), and compressed layers left (xz that takes over 256 MB to unwrap)."""
    if not text:
        return [], [], 0
    has_run = RUN.search(text) is not None
    base = find(text, runs=has_run)
    if not has_run and "%" not in text and "\\" not in text and "&#" not in text:
        return base, base, 0
    found, left = set(base), set()
    weak: set[Span] = set()  # finds whose place may be too long
    seen = {(False, Layer(text).key())}
    work = [iter([(Layer(text), False)])]  # depth first: windows of a large layer come one by one
    while work:
        if (got := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, loose = got
        if layer.starts is not None or layer.whole is not None:  # not the text itself
            if (key := (loose, layer.key())) in seen:
                continue
            seen.add(key)
            (weak if loose else found).update((kind, *layer.span(a, b)) for kind, a, b in find(layer.text))
        work.append(_decoded(layer, loose, left))
    found |= _without(weak, found)
    rank = {k: i for i, k in enumerate(KINDS)}
    found -= _inner(found) - set(base)  # beside the text's own finds, one that lies in a longer find of its kind says nothing new
    return base, sorted(found, key=lambda s: (s[1], rank[s[0]], s[2])), len(left)


def _without(weak: set[Span], found: set[Span]) -> set[Span]:
    """Those of ``weak`` that hold no find of the same kind."""
    out = set()
    for kind in KINDS if weak else ():
        spans = sorted((a, b) for k, a, b in found if k == kind)
        starts, least = [a for a, _ in spans], [b for _, b in spans]  # least: the first end among the finds from here on
        for i in range(len(least) - 2, -1, -1):
            least[i] = min(least[i], least[i + 1])
        for w in weak:
            i = bisect.bisect_left(starts, w[1])
            if w[0] == kind and (i == len(starts) or least[i] > w[2]):
                out.add(w)
    return out


def _inner(found: set[Span]) -> set[Span]:
    """The spans that lie in another one of their kind."""
    out, most = set(), dict.fromkeys(KINDS, -1)
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if b <= most[kind]:
            out.add((kind, a, b))
        most[kind] = max(most[kind], b)
    return out


def joined(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def masked(text: str, spans: list[Span], mask: str) -> str:
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind, a digest of them, all spans and layers left, for each row.

    A null text counts as the empty text and has none. Null or repeated ids are scanned row by row; extra columns are
    ignored; an empty table gives an empty result. Spans in code points, ends exclusive, by start, then kind.
    """
    common.ship(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for b in common.slices(batches, 1):
            both = [scan(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _, _ in both], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x, _, _ in both], pa.string()), pa.array([joined(x) for _, x, _ in both], pa.string()), pa.array([n for _, _, n in both], pa.int64())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_skipped"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_skipped long")


def redact(docs: DataFrame, mask: str = "[secret]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every span in the text replaced by ``mask``; overlapping spans get one mask.

    ``length_col``, where the table has it, is set to the new length of each text that changed. Null and empty texts stay as
    they are, as do all rows without a find; null or repeated ids don't matter; extra columns may have any names; an empty
    table gives an empty result.
    """
    common.ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for b in common.slices(batches, place):
            texts, sizes, changed = b.column(place).to_pylist(), None, False
            if size is not None:
                sizes = b.column(size).to_pylist()
            for i, t in enumerate(texts):
                spans = scan(t)[1]
                if spans:
                    changed, texts[i] = True, masked(t, spans, mask)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            if changed:
                b = b.set_column(place, b.schema.field(place), pa.array(texts, b.column(place).type))
                if sizes is not None:
                    b = b.set_column(size, b.schema.field(size), pa.array(sizes, b.column(size).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
