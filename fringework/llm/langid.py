"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of a word; words are cut where their script changes, and runs of more letters
than a word has (texts written without spaces) into consecutive pieces, all of which are read; a Viterbi pass over per-word scores with a switching penalty
labels each word; runs of equal labels are the spans of a text. Word scores come from character trigrams and whole words,
counted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import bisect
import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringework.llm import common

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SLICE = 4_000_000  # bytes of text labelled at a time, fewer with more than 16 languages
LONG = 64  # letters; a longer run isn't one word and is read in pieces of PIECE letters
PIECE = 16

#: First code points of ranges of letters of a script; a range ends where the next one starts.
SCRIPTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x40000, "Other"),
]
_starts, _names = [s for s, _ in SCRIPTS], [n for _, n in SCRIPTS]


def script(word: str) -> str:
    return _names[max(0, bisect.bisect_right(_starts, ord(word[0])) - 1)]


def _one_script() -> re.Pattern:
    ranges: dict[str, str] = {}
    for a, b, n in zip(_starts, [*_starts[1:], 0x110000], _names, strict=True):
        ranges[n] = ranges.get(n, "") + f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}"
    return re.compile("|".join(f"[{x}]+" for x in ranges.values()))


ONE_SCRIPT = _one_script()


def cuts(word: str) -> list[tuple[int, int]]:
    """Start and end of the pieces of a word: one for most; every letter is in one piece.

    Modifier letters and numerals have no script of their own and cut nothing.
    """
    borders = [0]
    if word.isascii() or ONE_SCRIPT.fullmatch(word):
        if len(word) <= LONG:
            return [(0, len(word))]
    else:
        now = script(word)
        for i, c in enumerate(word):
            if not 0x2B0 <= ord(c) < 0x370 and c.isalpha() and script(c) != now:
                now = script(c)
                if i:
                    borders.append(i)
    out = []
    for a, b in zip(borders, [*borders[1:], len(word)], strict=True):
        step = PIECE if b - a > LONG else LONG
        out += [(k, min(k + step, b)) for k in range(a, b, step)]
    return out


def framed(word: str, start: int, end: int) -> str:
    """A piece between its neighbours in the word, blanks at the word's ends."""
    return f"{word[start - 1] if start else ' '}{word[start:end]}{word[end] if end < len(word) else ' '}"


def grams(w: str) -> list[str]:
    """Trigrams of a framed piece, then the piece itself if it is a whole word (blanks on both sides)."""
    out = [w[i : i + 3] for i in range(len(w) - 2)]
    if len(w) > 3 and w[0] == w[-1] == " ":
        out.append(w)
    return out


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """Each three code points in a row as one number."""
    c = codes.astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]


class Model:
    """Word scores of a fitted model; ``grams[i]`` is the gram of row i of ``log``, whose last row is that of a gram not seen.

    ``scripts``: script -> whether each language is a candidate. Scores of words seen by this worker are kept in two
    generations: the older one goes when the younger one is full, so frequent words stay.
    """

    def __init__(self, langs: list[str], grams: list[str], log: np.ndarray, scripts: dict[str, np.ndarray], cap: float = 6.0, switch: float = 8.0, most: int = 300_000):
        self.langs, self.log, self.scripts, self.cap, self.switch, self.most = langs, log.astype(np.float32), scripts, cap, switch, most
        three = [i for i, g in enumerate(grams) if len(g) == 3]
        keys = _trigrams(np.frombuffer("".join(grams[i] for i in three).encode("utf-32-le", "surrogatepass"), "<u4"))[::3] if three else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], np.array(three, np.int64)[order]
        self.words = {g: i for i, g in enumerate(grams) if len(g) > 3}
        self.allowed = np.zeros((len(SCRIPTS), len(langs)), bool)
        for k, name in enumerate(_names):
            if name in scripts:
                self.allowed[k] = scripts[name]
        self.slice = SLICE * 16 // max(16, len(langs))
        self.tag = uuid.uuid4().hex
        self._forget()
        self._old: tuple[dict[str, int], np.ndarray, np.ndarray] | None = None

    def _forget(self) -> None:
        self._number: dict[str, int] = {}  # of a word of several pieces: -1 - its place in ``_many``
        self._many: list[tuple[list[int], list[tuple[int, int]]]] = []
        self._used = 0
        self._scores, self._sizes = np.zeros((1 << 16, len(self.langs)), np.float32), np.zeros(1 << 16, np.int32)

    def score(self, pieces: list[str]) -> np.ndarray:
        """Log scores of all languages for lower-cased framed pieces: 0 for the best, at least ``-cap``; all 0 if the script is unknown."""
        if not pieces:
            return np.zeros((0, len(self.langs)), np.float32)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array(list(map(len, pieces)), np.int64)
        starts = np.cumsum(lengths) - lengths
        unseen = len(self.log) - 1
        keys = _trigrams(codes)
        place = np.searchsorted(self.keys, keys)
        row = np.full(len(codes), unseen)
        if len(self.keys):
            near = np.minimum(place, len(self.keys) - 1)
            row[:-2] = np.where(self.keys[near] == keys, self.rows[near], unseen)
        values = self.log[row]
        ends = starts + lengths
        values[ends - 1] = values[ends - 2] = 0  # a trigram lies within a piece
        total = np.add.reduceat(values, starts, axis=0)
        whole = (codes[starts] == 32) & (codes[ends - 1] == 32) & (lengths > 3)
        get = self.words.get
        total[whole] += self.log[[get(pieces[i], unseen) for i in np.flatnonzero(whole).tolist()]]
        allowed = self.allowed[np.maximum(np.searchsorted(_starts, codes[starts + 1], side="right") - 1, 0)]
        total = np.where(allowed, total, -np.inf)
        best = total.max(1, keepdims=True, initial=-np.inf)
        known = allowed.any(1)
        best[~known] = 0
        out = np.maximum(total - best, np.where(allowed, -self.cap, -2 * self.cap)).astype(np.float32)
        out[~known] = 0
        return out

    def _add(self, keys: list[str], scores: np.ndarray, sizes: np.ndarray) -> None:
        end = self._used + len(keys)
        if end > len(self._scores):
            more = max(end, 2 * len(self._scores)) - len(self._scores)
            self._scores = np.concatenate([self._scores, np.zeros((more, len(self.langs)), np.float32)])
            self._sizes = np.concatenate([self._sizes, np.zeros(more, np.int32)])
        self._scores[self._used : end], self._sizes[self._used : end] = scores, sizes
        self._number.update(zip(keys, range(self._used, end), strict=True))
        self._used = end

    def _learn(self, words: set[str]) -> None:
        """Number words not seen yet, and the pieces of those that have several."""
        if self._old is not None:
            old, scores, sizes = self._old
            again = [w for w in words if old.get(w, -1) >= 0]
            if again:
                at = np.array([old[w] for w in again], np.int64)
                self._add(again, scores[at], sizes[at])
                words = words.difference(again)
        single, pieces, several = [], [], []
        for w in words:
            if len(w) <= LONG and (w.isascii() or ONE_SCRIPT.fullmatch(w)):
                single.append(w)
                pieces.append(f" {w} ")
                continue
            own = cuts(w)
            if len(own) == 1:
                single.append(w)
                pieces.append(f" {w} ")
            else:
                several.append((w, own))
        known, part = self._number, {}
        for w, own in several:  # a piece's key starts with a blank, as no word does
            for a, b in own:
                key = " " + framed(w, a, b)
                if key not in known:
                    part[key] = None
        if single or part:
            framed_ = pieces + [k[1:] for k in part]
            self._add([*single, *part], self.score(framed_), np.array([len(x) - 2 for x in framed_], np.int32))
        for w, own in several:
            known[w] = -1 - len(self._many)
            self._many.append(([known[" " + framed(w, a, b)] for a, b in own], own))

    def numbers(self, texts: list[list[str]], places: list[list[tuple[int, int]]] | None = None) -> list[np.ndarray]:
        """Row of each piece of each word of each text in the table of scores; ``places`` of words become those of pieces."""
        if self._used > self.most:
            self._old = self._number, self._scores, self._sizes
            self._forget()
        new = set(itertools.chain.from_iterable(texts)).difference(self._number)
        if new:
            self._learn(new)
        get, out = self._number.__getitem__, []
        for t, words in enumerate(texts):
            got = np.array(list(map(get, words)), np.int32)
            if len(got) and got.min() < 0:
                flat, spans, at = [], [], 0
                for i in np.flatnonzero(got < 0).tolist():
                    rows, own = self._many[-1 - got[i]]
                    flat += [got[at:i], np.array(rows, np.int32)]
                    if places is not None:
                        start = places[t][i][0]
                        spans += places[t][at:i] + [(start + a, start + b) for a, b in own]
                    at = i + 1
                got = np.concatenate([*flat, got[at:]])
                if places is not None:
                    places[t][:] = spans + places[t][at:]
            out.append(got)
        return out

    def label(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The language index and the length of each piece of each text, given as numbers."""
        if not self.langs:
            return [np.full(len(w), -1) for w in texts], [np.zeros(len(w), np.int32) for w in texts]
        labels = viterbi(texts, self._scores, self.switch) if texts else []
        return labels, [self._sizes[w] for w in texts]


def viterbi(seqs: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """Best label sequences where staying is free and switching costs ``switch``; all sequences advance together, longest first."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    lengths = np.array([len(seqs[i]) for i in order], np.int64)
    total = int(lengths.sum())
    if not total:
        return [np.zeros(0, np.int64) for _ in seqs]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    offset = np.concatenate([[0], np.cumsum(active)])
    lane = np.repeat(np.arange(len(order)), lengths)
    first = np.cumsum(lengths) - lengths
    place = offset[np.arange(total) - first[lane]] + lane
    obs = np.empty(total, np.int32)
    obs[place] = np.concatenate([seqs[i] for i in order])
    del lane
    langs = scores.shape[1]
    best_before, stayed = np.empty(total, np.int8 if langs < 128 else np.int16), np.empty((total, langs), bool)
    e = scores[obs]
    v = e[: active[0]].copy()
    ends = np.empty(len(order), np.int64)
    for t in range(1, steps):
        m, o = int(active[t]), int(offset[t])
        if m < len(v):
            ends[m : len(v)] = v[m:].argmax(1)
            v = v[:m]
        arg = v.argmax(1)
        moved = v[np.arange(m), arg][:, None] - switch
        stayed[o : o + m] = v >= moved
        best_before[o : o + m] = arg
        v = np.maximum(v, moved) + e[o : o + m]
    ends[: len(v)] = v.argmax(1)
    labels = np.empty(total, np.int32)
    now = ends.copy()
    for t in range(steps - 1, -1, -1):
        m, o = int(active[t]), int(offset[t])
        labels[o : o + m] = now[:m]
        if t:
            keep = stayed[np.arange(o, o + m), now[:m]]
            now[:m] = np.where(keep, now[:m], best_before[o : o + m])
    flat = labels[place]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
    for k, i in enumerate(order):
        out[i] = flat[first[k] : first[k] + lengths[k]]
    return out


def train(docs: DataFrame, usable: Column, per_lang: int = 4000, most_grams: int = 1 << 17, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **options) -> Model:
    """Fit on about ``per_lang`` documents of each language, chosen by a hash of their ids among the ``usable`` ones.

    Every lang value found is learned. ``per_lang`` bounds what is read for the fit; the model's table holds about
    ``most_grams`` grams, each language's commonest ones in equal parts, 256 at least, so that none goes without.
    """
    spark = docs.sparkSession
    common.ship(spark)
    own = docs.filter(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = sorted((r.lang, r.n) for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [x for x, _ in sizes]
    if not langs:
        return Model([], [], np.zeros((1, 0)), {}, **options)
    shares = spark.createDataFrame([(x, min(1.0, per_lang / n)) for x, n in sizes], "lang string, share double")
    few = len(sizes) <= 100_000  # what the driver holds of each language is far more than its share
    sample = own.join(F.broadcast(shares) if few else shares, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        total: Counter = Counter()
        for b in common.slices(batches, 0):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(WORD.findall(text.lower())).items():
                    own = cuts(w)
                    for a, e in own:
                        for g in grams(f" {w} " if len(own) == 1 else framed(w, a, e)):
                            total[lang, "g", g] += n
                        total[lang, "s", script(w[a])] += n * (e - a)
            if len(total) > 300_000:
                yield out(total)
                total.clear()
        if total:
            yield out(total)

    def out(total: Counter) -> pa.RecordBatch:
        lang, kind, value = zip(*total, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(kind), pa.array(value), pa.array(total.values(), pa.int64())], names=["lang", "kind", "value", "n"])

    counts = sample.select("text", "lang").mapInArrow(run, "lang string, kind string, value string, n long")
    counts = common.materialise(counts.groupBy("kind", "value", "lang").agg(F.sum("n").alias("n")), "grams")
    index = {x: i for i, x in enumerate(langs)}
    letters: dict[str, np.ndarray] = {}
    for r in counts.filter("kind = 's'").collect():
        letters.setdefault(r.value, np.zeros(len(langs)))[index[r.lang]] = r.n
    whole = np.maximum(sum(letters.values(), np.zeros(len(langs))), 1)
    candidates = {k: c for k, v in letters.items() if (c := v / whole >= 0.05).any()}
    commonest = Window.partitionBy("lang").orderBy(F.desc("n"), "value")
    top = counts.filter("kind = 'g'").withColumn("nth", F.row_number().over(commonest)).filter(F.col("nth") <= max(256, most_grams // len(langs)))
    used = counts.filter("kind = 'g'").join(top.select("value").distinct(), "value", "left_semi").select("value", "lang", "n").toArrow()
    names, place = np.unique(used.column("value").to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if used.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    n = np.zeros((len(names) + 1, len(langs)))
    n[place, [index[x] for x in used.column("lang").to_pylist()]] = used.column("n").to_numpy()
    log = np.log((n + 0.5) / (n.sum(0) + 0.5 * len(n)))
    common.drop_table(spark, counts)
    return Model(langs, names.tolist(), log, candidates, **options)


def _known(model: Model, words: list[str]) -> bool:
    """Whether a text with these words has a language at all: some letter (numerals may look like words)."""
    return bool(words) and bool(model.langs) and any(c.isalpha() for w in words for c in w)


def _lower(word: str) -> str:
    """Lower-cased letter by letter where the whole would change its length, so that places stay."""
    x = word.lower()
    return x if len(x) == len(word) else "".join(c.lower()[0] for c in word)


def _verdict(model: Model, known: bool, labels: np.ndarray, sizes: np.ndarray) -> tuple[str, float]:
    if not known:
        return UNKNOWN, 0.0
    letters = np.bincount(labels, weights=sizes, minlength=len(model.langs))
    k = int(letters.argmax())
    return model.langs[k], float(letters[k] / letters.sum())


def summary(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
    """Prediction, score and spans (start, end in code points, language) of each text."""
    ids, known, places = [], [], []
    for t in texts:
        found = list(WORD.finditer(t)) if t else []
        words = [_lower(m.group()) for m in found]
        own = [m.span() for m in found]
        known.append(_known(model, words))
        ids.append(words)
        places.append(own)
    ids = model.numbers(ids, places)
    preds, scores, spans = [], [], []
    for k, p, lab, sizes in zip(known, places, *model.label(ids), strict=True):
        pred, score = _verdict(model, k, lab, sizes)
        preds.append(pred)
        scores.append(score)
        own = []
        if k:
            cuts = np.flatnonzero(np.diff(lab)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
                own.append((p[a][0], p[b - 1][1], model.langs[lab[a]]))
        spans.append(own)
    return preds, scores, spans


def verdicts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    ids, known = [], []
    for t in texts:
        words = WORD.findall(t.lower()) if t else []
        known.append(_known(model, words))
        ids.append(words)
    both = [_verdict(model, k, lab, sizes) for k, lab, sizes in zip(known, *model.label(model.numbers(ids)), strict=True)]
    return [x for x, _ in both], [x for _, x in both]


def _here(shared) -> Model:
    """The broadcast model, one for each worker, so that its table of words lasts from task to task."""
    model = shared.value
    return common.held(("language", model.tag), lambda: model)


def predict(docs: DataFrame, model: Model, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score[, spans]`` of each row from its text alone.

    A null text or one without a letter is ``und`` with score 0; ``score`` is the share of the text's letters in spans of
    the predicted language; ties go to the first language by name. Null or repeated ids are predicted row by row; extra
    columns are ignored; an empty table gives an empty result; without any labelled document all rows are ``und``.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.select(id_col).dtypes[0][1]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(shared)
        for b in common.slices(batches, 1, own.slice):
            texts = b.column(1).to_pylist()
            more = []
            if spans:
                p, s, found = summary(own, texts)
                more = [pa.array([[{"start": x, "end": y, "lang": z} for x, y, z in f] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))]
            else:
                p, s = verdicts(own, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.string()), pa.array(s, pa.float64()), *more], names=[id_col, "lang_pred", "score", *(["spans"] * spans)])

    rest = ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double{rest}")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of at least ``least``.

    Null texts and texts without a letter go, as does every row where no language was learned; rows with null or repeated
    ids are judged row by row; no column is looked at but the text, so extra ones may have any names; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    common.ship(spark)
    place = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(shared)
        for b in common.slices(batches, place, own.slice):
            p, s = verdicts(own, b.column(place).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and y >= least for x, y in zip(p, s, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
