"""Quality rules by weak supervision.

Each rule votes good or bad on a document, or abstains. Expectation-maximisation over the counts of vote patterns (at most
``3 ** len(RULES)`` numbers, however many documents) of those that pass the base rules estimates how common good documents
are and how often each rule, where it votes, votes bad on good and on bad documents. The posterior probability of good then
decides, in place of a filter that all rules must pass.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.llm import common

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SLICE = 2_000_000  # bytes of text measured at a time

_classes = {
    "symbol": SYMBOLS,
    "bar": b"|",
    "bang": b"!?",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "stop": b".",
    "digit": bytes(range(48, 58)),
    "space": b" \t\n\x0b\x0c\r",
}
_tables = {}
for _k, _v in _classes.items():
    _t = np.zeros(256, np.uint8)
    _t[list(_v)] = 1
    _tables[_k] = _t


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


#: name -> (bad, good) as conditions on the metrics m; where neither holds, the rule abstains.
RULES = {
    "word_length": (lambda m: (_share(m["word_chars"], m["n_words"]) > 15) | (_share(m["word_chars"], m["n_words"]) < 2), lambda m: (_share(m["word_chars"], m["n_words"]) <= 10) & (_share(m["word_chars"], m["n_words"]) >= 3)),
    "symbols": (lambda m: _share(m["n_symbols"], m["n_words"]) > 0.25, lambda m: _share(m["n_symbols"], m["n_words"]) < 0.05),
    "bars": (lambda m: _share(m["bar"], m["n_words"]) > 0.2, lambda m: _share(m["bar"], m["n_words"]) < 0.05),
    "bangs": (lambda m: _share(m["bang"], m["n_words"]) > 0.3, lambda m: _share(m["bang"], m["n_words"]) < 0.1),
    "capitals": (lambda m: _share(m["upper"], m["upper"] + m["lower"]) > 0.5, lambda m: _share(m["upper"], m["upper"] + m["lower"]) < 0.2),
    "letters": (lambda m: _share(m["letters"], m["word_chars"]) < 0.75, lambda m: _share(m["letters"], m["word_chars"]) > 0.85),
    "digits": (lambda m: _share(m["digit"], m["word_chars"]) > 0.3, lambda m: _share(m["digit"], m["word_chars"]) < 0.1),
    "repeated_lines": (lambda m: (m["n_dup_lines"] >= 3) & (_share(m["n_dup_lines"], m["n_lines"]) > 0.3), lambda m: _share(m["n_dup_lines"], m["n_lines"]) < 0.1),
    "variety": (lambda m: (m["n_words"] >= 30) & (m["n_distinct"] < 0.25 * np.minimum(m["n_words"], 200)), lambda m: m["n_distinct"] >= 0.4 * np.minimum(m["n_words"], 200)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(ids: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each document, its words that lie in a ``window`` of words found twice or more in it. ids: of all words, in order."""
    n, docs = len(ids), len(lengths)
    out = np.zeros(docs, np.int64)
    if n < window:
        return out
    doc = np.repeat(np.arange(docs), lengths)
    starts = np.arange(n - window + 1)
    starts = starts[doc[starts] == doc[starts + window - 1]]
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        key = doc[starts].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(window):
            key = (key ^ spread[starts + k]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    same = key[order[:-1]] == key[order[1:]]
    a, b = a[same], b[same]
    real = doc[a] == doc[b]
    for k in range(window):  # a window counts by its words, not by its hash
        real &= ids[a + k] == ids[b + k]
    marks = np.zeros(n + 1, np.int64)
    for s in (a[real], b[real]):
        np.add.at(marks, s, 1)
        np.add.at(marks, s + window, -1)
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=docs)


def metrics(col: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text of an Arrow string column; a null text counts as one without words."""
    texts = col.to_pylist()
    raw = [t.encode() if t else b"" for t in texts]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
    data = np.frombuffer(b"".join(raw), np.uint8)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[cuts[1:]] - total[cuts[:-1]]

    m = {k: per_doc(t[data]) for k, t in _tables.items()}
    m["n_symbols"] = m.pop("symbol")
    m["word_chars"] = per_doc((data & 0xC0) != 0x80) - m.pop("space")
    m["letters"] = m["upper"] + m["lower"] + per_doc(data >= 0xC0)  # beyond ASCII nearly all are
    words = [x.split() for x in raw]
    m["n_words"] = lengths = np.array([len(w) for w in words], np.int64)
    number = defaultdict(itertools.count().__next__)
    m["n_distinct"] = np.array([len(set(w)) for w in words], np.int64)
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(lengths.sum()))
    m["n_repeat_words"] = repeated(ids, lengths)
    lines, dups = [], []
    for x in raw:
        own = [y for y in x.split(b"\n") if y.strip()]  # bytes.strip strips what separates words
        lines.append(len(own))
        dups.append(len(own) - len(set(own)))
    m["n_lines"], m["n_dup_lines"] = np.array(lines, np.int64), np.array(dups, np.int64)
    return m


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def patterns(m: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all rules as digits of a number to base 3: 0 bad, 1 abstains, 2 good."""
    out = np.zeros(len(m["n_words"]), np.int64)
    for bad, good in RULES.values():
        is_bad = bad(m)
        out = 3 * out + np.where(is_bad, 0, np.where(good(m), 2, 1))
    return out


@dataclass
class Estimate:
    """What the data say: the share of good documents, and for each rule how often its vote is bad on good and on bad documents."""

    good: float
    bad_on_good: np.ndarray
    bad_on_bad: np.ndarray
    posterior: dict[int, float]  # of good, by pattern


def _votes(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], 1)


def estimate(counts: dict[int, int], rounds: int = 500) -> Estimate:
    """Expectation-maximisation over the counted patterns.

    It starts from the rules' meaning: documents with a bad vote are thought good with probability 0.1, others with 0.95.
    From there on only the counts speak; each rate gets one pseudo-vote each way, so that none becomes 0 or 1. A rule that
    abstains on a document says nothing about it. Patterns counted as none get a posterior too.
    """
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in keys.tolist()], np.float64)
    votes = _votes(keys)
    bad, good_vote = (votes == 0).astype(np.float64), (votes == 2).astype(np.float64)
    good = np.where(bad.any(1), 0.1, 0.95)
    for _ in range(rounds):
        share = (n @ good + 1) / (n.sum() + 2)
        rate = []
        for w in (n * good, n * (1 - good)):
            rate.append((w @ bad + 1) / (w @ (bad + good_vote) + 2))
        odds = np.log(share) - np.log1p(-share) + bad @ np.log(rate[0] / rate[1]) + good_vote @ (np.log1p(-rate[0]) - np.log1p(-rate[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done, good = np.abs(new - good).max(initial=0) < 1e-9, new
        if done:
            break
    return Estimate(float(share), rate[0], rate[1], dict(zip(keys.tolist(), good.tolist(), strict=True)))


def fit(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of good for each pattern counted."""
    return estimate(counts).posterior if counts else {}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts, base_failed and the vote pattern of each row."""
    common.ship(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for b in common.slices(batches, 1, SLICE):
            m = metrics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in BASE), pa.array(base_failed(m)), pa.array(patterns(m))], names=["doc_id", *BASE, "base_failed", "pattern"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in BASE)}, base_failed boolean, pattern long")


def count_patterns(votes: DataFrame) -> dict[int, int]:
    """Documents by pattern: all patterns, with those that the base rules reject anyway counted as none."""
    return {r.pattern: r.n for r in votes.groupBy("pattern").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n")).collect()}


def score(docs: DataFrame, keep: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``quality`` (posterior probability of good) and ``kept`` for each row.

    A row is kept if its base rules hold and its probability is at least ``keep``. A null text has no words and fails.
    Null and repeated ids are scored row by row; equal texts get equal results; extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    m = common.materialise(measured(docs, id_col, text_col), "votes")
    rows = sorted(fit(count_patterns(m)).items())
    known = spark.createDataFrame(rows, "pattern long, quality double")
    out = m.join(F.broadcast(known), "pattern", "left")  # at most 3 ** len(RULES) rows
    out = out.select(F.col("doc_id").alias(id_col), *BASE, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= keep)).alias("kept"))
    return common.result(out, "quality", m)


def keep_good(docs: DataFrame, keep: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``score`` keeps. The texts are read twice and never shuffled.

    Null texts have no words and go, as do texts that break a base rule; rows with null or repeated ids are judged row by row;
    no column is looked at but the text, so extra ones may have any names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.ship(spark)
    place = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(fit(count_patterns(measured(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        quality = shared.value
        for b in common.slices(batches, place, SLICE):
            m = metrics(b.column(place))
            yield b.filter(pa.array(~base_failed(m) & np.array([quality[p] >= keep for p in patterns(m).tolist()], bool)))

    return docs.mapInArrow(run, docs.schema)
