"""Language-model scoring by a hidden Markov model over words.

Words are counted over all training texts. The most frequent ones (the head, a bounded table) have an emission probability
of their own in every latent state; in the first rounds all others share one symbol per state, by their counts.
The last round estimates emissions of these too, each its own: expected counts by chunk of texts are summed by buckets of
words and go back to the chunks, so no task or driver holds more of them than a bucket and a chunk.
Baum-Welch: every task runs forward and backward over its whole texts, expected counts are summed over all tasks, and the
model is re-estimated from them. A text's likelihood is the exact scaled forward recursion over all its tokens and its end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringework.llm import common

END = " "  # no word holds a blank
MOST_BYTES = 64  # of a head word
BATCH_TOKENS = 1_000_000


@dataclass
class Vocabulary:
    """Counts of all training tokens as a table, and the bounded head on the driver."""

    counts: DataFrame  # word, c
    tokens: int  # N
    words: int  # V
    least: int  # head words have this count or more
    head: list[str]
    head_counts: np.ndarray

    @property
    def tail_tokens(self) -> int:
        return self.tokens - int(self.head_counts.sum())

    @property
    def tail_words(self) -> int:
        return self.words - len(self.head)

    @property
    def buckets(self) -> int:
        """How many buckets the words beyond the head are dealt to by their hashes, of about 50,000 each."""
        return self.tail_words // 50_000 + 1


def count_words(docs: DataFrame, training: Column, most_head: int = 1 << 17, text_col: str = "text") -> Vocabulary:
    """Counts over all training texts. ``most_head`` bounds the head: words of at most ``MOST_BYTES`` whose count reaches
    the least power of ``2 ** 0.25``, from 2 on, that no more than ``most_head`` words reach. Words seen once stay outside,
    so that what the head leaves over stands for words not seen."""
    spark = docs.sparkSession
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(total.values(), pa.int64())], names=["word", "c"])

        for b in common.slices(batches, 0):
            for t in b.column(0).to_pylist():
                total.update(common.words_of(t))
                total[END.encode()] += 1
                if len(total) > 250_000:
                    yield out()
                    total.clear()
        if total:
            yield out()

    counts = common.materialise(docs.filter(training).select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "words", sweep=True)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = counts.filter(F.octet_length("word") <= MOST_BYTES)
    level = F.floor(F.log2("c") * 4 + 1e-9).cast("int")
    steps = sorted(((r.level, r.n) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, cut = 0, None
    for at, many in steps:
        if total + many > most_head or at < 4:
            break
        total, cut = total + many, at
    rows = short.filter(level >= cut).orderBy(F.desc("c"), "word").toArrow() if cut is not None else None
    head = rows.column("word").to_pylist() if rows else []
    return Vocabulary(counts, n, v, cut if cut is not None else 0, head, np.asarray(rows.column("c"), np.int64) if rows else np.zeros(0, np.int64))


def encode(docs: DataFrame, vocabulary: Vocabulary, extra: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts in chunks of about ``BATCH_TOKENS`` tokens, written to the shared folder.

    A row is a chunk: its number ``chunk``; arrays of the ids and the ``extra`` columns; ``lengths`` of the texts in tokens
    (int32); ``ids`` (uint32) of all its tokens, head numbers, or ``len(head)`` and above: places in ``words``, the distinct
    other words of the chunk, which lie by bucket (as ``_bucket`` deals them), ``sizes`` (int32) of them in each.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared, buckets = spark.sparkContext.broadcast(vocabulary.head), vocabulary.buckets
    own = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in extra.items()), F.col(text_col).alias("text"))
    fields = own.schema.fields[:-1]
    names = ["chunk", *(f.name for f in fields), "lengths", "ids", "words", "sizes"]
    kinds = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in fields)
    place = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = {w.encode(): i for i, w in enumerate(shared.value)}
        other, end, get = len(head), END.encode(), head.get
        chunk = TaskContext.get().partitionId() << 40
        number: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        parts: list[pa.RecordBatch] = []
        total = 0

        def out() -> pa.RecordBatch:
            words, flat, rows = list(number), np.concatenate(ids), pa.Table.from_batches(parts).combine_chunks()
            of = np.fromiter(map(_bucket, words, repeat(buckets)), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            beyond = flat >= other
            flat[beyond] = other + rank[flat[beyond] - other]
            one = pa.array([0, rows.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()),
                    *(pa.ListArray.from_arrays(one, c.combine_chunks()) for c in rows.columns),
                    pa.array([np.array([len(x) for x in ids], "<i4").tobytes()], pa.binary()),
                    pa.array([flat.astype("<u4").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(order))),
                    pa.array([np.bincount(of, minlength=buckets).astype("<i4").tobytes()], pa.binary()),
                ],
                names=names,
            )

        for b in common.slices(batches, place):
            start = 0
            for i, t in enumerate(b.column(place).to_pylist()):
                words = common.words_of(t)
                words.append(end)
                found = list(map(get, words))
                if None in found:
                    found = [other + number.setdefault(words[k], len(number)) if x is None else x for k, x in enumerate(found)]
                ids.append(np.array(found, np.int64))
                total += len(found)
                if total >= BATCH_TOKENS:
                    parts.append(b.slice(start, i + 1 - start).select(range(place)))
                    yield out()
                    number, ids, parts, total, start, chunk = {}, [], [], 0, i + 1, chunk + 1
            if start < b.num_rows:
                parts.append(b.slice(start).select(range(place)))
        if ids:
            yield out()

    return common.materialise(own.mapInArrow(run, f"chunk long, {kinds}, lengths binary, ids binary, words array<string>, sizes binary"), "encoded")


def _bucket(word: bytes, buckets: int) -> int:
    return crc32(word) % buckets


def _sequences(ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, np.cumsum(lengths)[:-1])


class Lanes:
    """Sequences side by side, longest first, stored step by step: ``offset[t]`` is the place of step t, ``active[t]`` its width.

    ``place``: of each token, in the sequences' own order. ``blocks``: ranges of steps of about ``most`` tokens, which bound
    what the recursions hold at a time. ``tail``: places, ascending, of tokens with emissions of their own, and these as ratios
    to that of all other words.
    """

    def __init__(self, seqs: list[np.ndarray], most: int = BATCH_TOKENS):
        own = np.array([len(s) for s in seqs], np.int64)
        order = np.argsort(-own, kind="stable")
        total, steps = int(own.sum()), int(own.max(initial=0))
        self.active = np.searchsorted(-own[order], -np.arange(steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        at = np.empty(len(seqs), np.int64)
        at[order] = np.arange(len(seqs))
        self.lane = np.repeat(np.arange(len(seqs)), own)
        self.place = self.offset[np.arange(total) - (np.cumsum(own) - own)[self.lane]] + at[self.lane]
        self.obs = np.empty(total, np.int64)
        if total:
            self.obs[self.place] = np.concatenate(seqs)
        self.count, self.blocks, t = len(seqs), [], 0
        while t < steps:
            end = max(t + 1, int(np.searchsorted(self.offset, self.offset[t] + most, side="right")) - 1)
            self.blocks.append((t, min(end, steps)))
            t = end
        self.tail: tuple[np.ndarray, np.ndarray] | None = None

    def set_tail(self, places: np.ndarray, ratios: np.ndarray) -> None:
        order = np.argsort(places)
        self.tail = places[order], ratios[order]


@dataclass
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # (head + 1) x K, float32; the last row: all other words
    share: np.ndarray | None = None  # K: the states' shares of the tokens of all other words

    def _emissions(self, lanes: Lanes, t0: int, t1: int) -> np.ndarray:
        a, b = int(lanes.offset[t0]), int(lanes.offset[t1])
        e = self.emit[lanes.obs[a:b]]
        if lanes.tail is not None:
            i, j = np.searchsorted(lanes.tail[0], [a, b])
            e[lanes.tail[0][i:j] - a] *= lanes.tail[1][i:j]
        return e

    def _run(self, e: np.ndarray, lanes: Lanes, t0: int, t1: int, a: np.ndarray | None, scale: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The scaled forward recursion over a block of steps from ``a``, the variables before it; the last ones, and all if ``keep``."""
        move, first = self.move.astype(np.float32), int(lanes.offset[t0])
        alpha = np.empty_like(e) if keep else None
        active, offset = lanes.active[t0:t1].tolist(), (lanes.offset[t0:t1] - first).tolist()
        for t, (m, o) in enumerate(zip(active, offset, strict=True), t0):
            x = e[o : o + m]
            a = (self.start.astype(np.float32) if t == 0 else a[:m] @ move) * x
            s = a.sum(1)
            a /= s[:, None]
            scale[first + o : first + o + m] = s
            if keep:
                alpha[o : o + m] = a
        return a, alpha

    def forward(self, lanes: Lanes, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list, np.ndarray | None]:
        """log10 likelihood of each sequence, the scales, the variables before each block, and all of a lone block if ``keep``."""
        scale, before, a, alpha = np.empty(len(lanes.obs), np.float32), [], None, None
        for t0, t1 in lanes.blocks:
            before.append(a)
            a, alpha = self._run(self._emissions(lanes, t0, t1), lanes, t0, t1, a, scale, keep and len(lanes.blocks) == 1)
        return np.bincount(lanes.lane, weights=np.log10(scale.astype(np.float64))[lanes.place], minlength=lanes.count), scale, before, alpha

    def expected(self, lanes: Lanes, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Expected counts of starts, moves and emissions over whole sequences; of the tokens at the places ``others``, the states'
        probabilities. Only a block of steps is held at a time: forward variables are run again from the one before it."""
        _, scale, before, kept = self.forward(lanes, keep=True)
        k, size = len(self.start), len(self.emit)
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
        states = None if others is None else np.empty((len(others), k), np.float32)
        rank = None if others is None else np.argsort(others)
        back, later = self.move.T.astype(np.float32), None
        for (t0, t1), a in zip(reversed(lanes.blocks), reversed(before), strict=True):
            lo, hi = int(lanes.offset[t0]), int(lanes.offset[t1])
            u = self._emissions(lanes, t0, t1)
            alpha = self._run(u, lanes, t0, t1, a, scale, True)[1] if kept is None else kept
            u /= scale[lo:hi, None]  # becomes emission times backward variable over scale
            beta = np.ones_like(u)
            active, offset = lanes.active[t0:t1].tolist(), (lanes.offset[t0 : t1 + 1] - lo).tolist()
            if later is not None:
                beta[offset[-2] : offset[-2] + len(later)] = later @ back
            for t in range(t1 - t0 - 1, 0, -1):
                m, o, o1 = active[t], offset[t], offset[t - 1]
                x = u[o : o + m]
                x *= beta[o : o + m]
                beta[o1 : o1 + m] = x @ back
            first = active[0]
            u[:first] *= beta[:first]
            later = u[:first].copy()
            if a is not None:
                moves += a[:first].T.astype(np.float64) @ later.astype(np.float64)
            if t1 - t0 > 1:
                shift = np.repeat(np.array(offset[1:-1], np.int64) - np.array(offset[:-2], np.int64), np.array(active[1:], np.int64))
                moves += alpha[np.arange(first, hi - lo) - shift].T.astype(np.float64) @ u[first:].astype(np.float64)
            beta *= alpha
            beta /= beta.sum(1, keepdims=True)
            if a is None:
                starts += beta[:first].sum(0, dtype=np.float64)
            for j in range(k):
                emits[:, j] += np.bincount(lanes.obs[lo:hi], weights=beta[:, j], minlength=size)
            if others is not None:
                i, j = np.searchsorted(others, [lo, hi], sorter=rank)
                states[rank[i:j]] = beta[others[rank[i:j]] - lo]
        return starts, moves * self.move, emits, states


def first_guess(vocabulary: Vocabulary, states: int) -> Hmm:
    """Sticky states that emit words by their counts, each word favoured by some states; the same for the same words."""
    base = np.append(vocabulary.head_counts, max(1, vocabulary.tail_tokens)).astype(np.float64)
    random = np.random.default_rng(len(base)).gamma(0.7, 1.0, (len(base), states)) + 0.05
    emit = base[:, None] * random
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, (emit / emit.sum(0)).astype(np.float32))


def train(encoded: DataFrame, vocabulary: Vocabulary, states: int = 8, rounds: int = 3, prior: float = 2000.0, all_words: bool = True, listed: bool = True) -> tuple[Hmm, DataFrame]:
    """Baum-Welch over all rows of ``encoded`` (those of ``training``, if there is such a column), whole texts: the model, and
    what the last round counted of the words beyond its head, as ``_summed`` gives it: by chunk, and if ``listed`` as a table.
    With ``all_words`` these come with the states' shares of their tokens, and the model with those of all their tokens.

    ``prior``: pseudo-tokens, shared out by the words' counts, added to each emission.
    """
    spark = encoded.sparkSession
    model, other = first_guess(vocabulary, states), len(vocabulary.head)
    size = other + 1
    base = np.append(vocabulary.head_counts, max(1, vocabulary.tail_tokens)).astype(np.float64)
    base /= base.sum()
    words, chosen = None, "training" in encoded.columns
    for turn in range(rounds):
        shared, last = spark.sparkContext.broadcast(model), turn == rounds - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            hmm, total = shared.value, np.zeros((size + 1 + states, states))
            for row in _rows(batches):
                flat, lengths = np.frombuffer(row["ids"], "<u4").astype(np.int64), np.frombuffer(row["lengths"], "<i4")
                if chosen:
                    of = np.array(row["training"], bool)
                    flat, lengths = flat[np.repeat(of, lengths)], lengths[of]
                beyond = np.flatnonzero(flat >= other)
                local = flat[beyond] - other
                flat[beyond] = other
                probable = None
                if len(flat):
                    lanes = Lanes(_sequences(flat, lengths))
                    starts, moves, emits, probable = hmm.expected(lanes, lanes.place[beyond] if last and all_words else None)
                    total[:size] += emits
                    total[size] += starts
                    total[size + 1 :] += moves
                if last:
                    sizes = np.frombuffer(row["sizes"], "<i4")
                    c = np.bincount(local, minlength=int(sizes.sum())).astype(np.int64)
                    q = np.zeros((len(c), states if all_words else 0))
                    if probable is not None:
                        for j in range(states):
                            q[:, j] = np.bincount(local, weights=probable[:, j], minlength=len(c))
                    q = (q / np.maximum(c, 1)[:, None]).astype("<f2")
                    at = np.flatnonzero(sizes)
                    stops = np.cumsum(sizes)[at]
                    starts = stops - sizes[at]
                    edges = pa.array(np.append(starts, len(c)), pa.int32())
                    spans = list(zip(starts.tolist(), stops.tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int64()), pa.array([row["chunk"]] * len(at), pa.int64()), pa.array(starts, pa.int32()), pa.ListArray.from_arrays(edges, row["words"]), pa.array([c[i:j].astype("<u4").tobytes() for i, j in spans], pa.binary()), pa.array([q[i:j].tobytes() for i, j in spans], pa.binary())],
                        names=PARTS,
                    )
            # The model's own counts go as blocks of rows, to buckets of negative numbers.
            at = [i for i in range(0, len(total), BLOCK) if total[i : i + BLOCK].any()]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in at], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.binary()), pa.array([total[i : i + BLOCK].astype("<f4").tobytes() for i in at], pa.binary())], names=PARTS)

        parts = encoded.select(*(["training"] if chosen else []), "chunk", "lengths", "ids", *(["words", "sizes"] if last else [])).mapInArrow(run, PART_KINDS)
        got = common.materialise(_summed(parts, states if all_words else 0, states, listed), "expected", sweep=True)
        total = np.zeros((size + 1 + states, states))
        for r in got.filter("bucket < 0").select("bucket", "q").toArrow().to_pylist():
            x = np.frombuffer(r["q"], np.float64).reshape(-1, states)
            total[-1 - r["bucket"] :][: len(x)] = x
        if last:
            words = got
        else:
            common.drop_table(spark, got)
        shared.unpersist()
        emit = total[:size] + prior * base[:, None]
        move, start = total[size + 1 :] + 0.1, total[size] + 0.1
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), (emit / emit.sum(0)).astype(np.float32), _shares(total[other]))
    return model, words


PARTS = ["bucket", "chunk", "start", "words", "c", "q"]
PART_KINDS = "bucket long, chunk long, start int, words array<string>, c binary, q binary"
BLOCK = 2048  # rows of the model that a task sends at once


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one at a time; of lists of texts the Arrow array, of other columns the value."""
    for b in batches:
        for i in range(b.num_rows):
            yield {k: c[i].values if k == "words" else c[i].as_py() for k, c in zip(b.schema.names, b.columns, strict=True)}


def _shares(counts: np.ndarray) -> np.ndarray:
    return np.maximum(counts / max(counts.sum(), 1e-300), 1e-12)


def _summed(parts: DataFrame, width: int, states: int, listed: bool) -> DataFrame:
    """``parts`` (one for each chunk and bucket: the words at ``start`` and after among the chunk's, how often each occurs, and
    ``width`` shares of it) with the counts and shares of all chunks, without the words. If ``listed``, each bucket also has
    a row without a chunk that holds its distinct words. Blocks of the model (negative buckets) are added up.

    A task holds one bucket at a time, which is a bounded part of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held, block = None, {}, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            if now < 0:
                yield pa.RecordBatch.from_pylist([{"bucket": now, "q": block.tobytes()}], schema)
                return
            n = len(number)
            c, k = np.zeros(n, np.int64), np.zeros((n, width))
            for _, _, at, own, q in held:  # a chunk has a word once
                own = np.frombuffer(own, "<u4")
                c[at] += own
                k[at] += np.frombuffer(q, "<f2").reshape(len(at), width) * own[:, None].astype(np.float64)
            q = (k / np.maximum(c, 1)[:, None]).astype("<f2")
            if listed:
                yield pa.RecordBatch.from_pylist([{"bucket": now, "words": list(number), "c": c.tobytes(), "q": q.tobytes()}], schema)
            for i in range(0, len(held), 256):
                yield pa.RecordBatch.from_pylist([{"bucket": now, "chunk": chunk, "start": start, "c": c[at].tobytes(), "q": q[at].tobytes()} for chunk, start, at, _, _ in held[i : i + 256]], schema)

        for b in batches:
            for row in _rows(b.slice(i, 1) for i in range(b.num_rows)):
                if row["bucket"] != now:
                    yield from out()
                    now, number, held, block = row["bucket"], {}, [], 0.0
                if now < 0:
                    block = block + np.frombuffer(row["q"], "<f4").astype(np.float64)
                else:
                    at = np.array([number.setdefault(w, len(number)) for w in row["words"].to_pylist()], np.int32)
                    held.append((row["chunk"], row["start"], at, row["c"], row["q"]))
        yield from out()

    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.string())), ("c", pa.binary()), ("q", pa.binary())])
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PART_KINDS)


def _ratios(c: np.ndarray, q: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Emissions of words beyond the head in each state, as ratios to their shares of all other words by count.

    A word's share of the other words' tokens in a state is its expected count there plus one, all over those of all such
    words and one unknown word; expected counts are scaled so that each state has as many tokens beyond the head as the
    texts. A word's ratio is then 1 if it is unknown, and the shares of a state sum to 1.
    """
    c = c[:, None].astype(np.float64)
    return (c * q / share + 1) / (c + 1)


def tail_emissions(words: DataFrame, vocabulary: Vocabulary, states: int) -> DataFrame:
    """``word, c, r`` of the words listed by ``train``: each word beyond the head with its count and ``_ratios``."""
    listed = words.filter("bucket >= 0 AND chunk IS NULL")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states)
        for row in _rows(batches):
            total += np.frombuffer(row["c"], np.int64) @ np.frombuffer(row["q"], "<f2").reshape(-1, states).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["k"])

    share = _shares(sum((np.array(r.k) for r in listed.select("c", "q").mapInArrow(sums, "k array<double>").collect()), np.zeros(states)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = np.frombuffer(row["c"], np.int64)
            r = _ratios(c, np.frombuffer(row["q"], "<f2").reshape(-1, states).astype(np.float64), share)
            yield pa.RecordBatch.from_arrays([row["words"], pa.array(c), pa.array(r.tolist(), pa.list_(pa.float64()))], names=["word", "c", "r"]).filter(pa.array(c > 0))

    return listed.select("words", "c", "q").mapInArrow(run, "word string, c long, r array<double>")


def score(docs: DataFrame, training: Column, states: int = 8, rounds: int = 3, most_head: int = 1 << 16, all_words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, training, n_tokens, n_known, train_tokens, base_score, score`` of each row; the model learns from the ``training`` rows.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's. All words have emissions of their own,
    those beyond the head of ``most_head`` from the last round, unless ``all_words`` is false. A null text counts as the empty
    text, which is the end alone. Null and repeated ids are scored row by row; extra columns are ignored; an empty table gives
    an empty result. With no training rows both scores know no word and give each token probability 1.
    """
    spark = docs.sparkSession
    vocabulary = count_words(docs, training, most_head, text_col)
    encoded = encode(docs, vocabulary, {"training": F.coalesce(training, F.lit(False))}, id_col, text_col)
    model, words = train(encoded, vocabulary, states, rounds, all_words=all_words, listed=False)
    n, v, size, width = vocabulary.tokens, vocabulary.words, len(vocabulary.head), states if all_words else 0
    bottom = math.log10(n + v + 1)
    tail_bottom = math.log10(vocabulary.tail_tokens + vocabulary.tail_words + 1)
    shared = spark.sparkContext.broadcast((model, vocabulary.head_counts))
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, counts = shared.value
        logs = np.append(np.log10(counts + 1.0), 0.0) - bottom
        held: list[tuple[int, bytes, bytes]] = []
        for b in batches:
            for i in range(b.num_rows):
                c, q, start, lengths, ids = (b.column(k)[i].as_py() for k in range(2, 7))
                if ids is None:  # the words of the chunk come before it
                    held.append((start, c, q))
                    continue
                held.sort()
                c = np.frombuffer(b"".join(x for _, x, _ in held), np.int64)
                q = np.frombuffer(b"".join(x for _, _, x in held), "<f2").reshape(len(c), width)
                held = []
                flat, lengths = np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(lengths, "<i4").astype(np.int64)
                cuts = np.cumsum(lengths) - lengths
                beyond = np.flatnonzero(flat >= size)
                local = flat[beyond] - size
                flat[beyond] = size
                lanes = Lanes(_sequences(flat, lengths))
                if width and len(beyond):
                    lanes.set_tail(lanes.place[beyond], _ratios(c, q, hmm.share).astype(np.float32)[local])
                others, gain = np.zeros(len(flat), np.int64), np.zeros(len(flat))
                others[beyond], gain[beyond] = 1, np.log10(c + 1.0)[local]
                unknown = np.zeros(len(flat), np.int64)
                unknown[beyond] = c[local] == 0
                others, unknown, gain = (np.add.reduceat(x, cuts) for x in (others, unknown, gain))
                base = np.add.reduceat(logs[flat], cuts) + gain
                own = hmm.forward(lanes)[0] - others * tail_bottom + gain
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k)[i].values for k in (7, 8)), pa.array(lengths), pa.array(lengths - unknown), pa.array(base), pa.array(own)],
                    names=["doc_id", "training", "n_tokens", "n_known", "base_score", "score"],
                )

    # Each chunk meets the counts of its words beyond the head in one shuffle; only a bucket and a chunk are held at a time.
    texts = encoded.select("chunk", F.lit(True).alias("last"), *(F.lit(None).cast(t).alias(k) for k, t in (("c", "binary"), ("q", "binary"), ("start", "int"))), "lengths", "ids", "doc_id", "training")
    counted = words.filter("bucket >= 0").select("chunk", F.lit(False).alias("last"), "c", "q", "start", *(F.lit(None).cast(texts.schema[k].dataType).alias(k) for k in ("lengths", "ids", "doc_id", "training")))
    both = counted.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "last")
    out = both.mapInArrow(run, f"doc_id {kind}, training boolean, n_tokens long, n_known long, base_score double, score double")
    out = out.select(F.col("doc_id").alias(id_col), "training", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    return common.result(out, "scores", encoded, vocabulary.counts, words, sweep=True)
