"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints of 64 bits link at ``most`` (3) or fewer differing bits. By the pigeonhole principle two such fingerprints
agree on one of four bands, so a band's value is a bucket; a bucket with more than ``block`` fingerprints is split by the
same principle on its remaining bits, up to three times, and after that into blocks of Gray order whose pairs are pruned
by their shared bits. Within a bucket the fingerprints are sorted by Gray rank, which puts codes with equal bits next to
each other; groups of ``FAN`` neighbours form a node that holds the bits all of them share, and nodes form upper nodes. A
search goes down the tree, adds up the differences to the shared bits that upper nodes don't hold already, and prunes a
whole group once they exceed the limit. Groups already linked to the query as a whole are passed over: links serve to find
components, not to list pairs.

Texts alike by a share of their five-word shingles (``similar_groups``) differ in more bits than bands can find. There the
fingerprint has 1,024 bits over the distinct shingles; a bucket holds the texts that agree on the least hashes of ``ROWS``
permutations of their shingles, with ``BANDS`` such buckets a text, and is searched by the same index under the rising limits
``WIDE_MOST``. Under the first limit texts are alike beyond doubt. Of the other pairs a bucket gives ``FORESTS`` forests
without a pair in common that span its components, nearly the nearest first, so that a group isn't listed pair by pair, and
the shingles of these pairs are compared. What the index leaves apart is then looked at by an exact way, so that no link is
lost to bands, limits or forests: two sets with a share in common have one of their first shingles in common, in any order
of all shingles, of which the commonest come last; pairs of different components that meet in one, at places and of sizes
that allow the share, are looked at (``_rest``). Bit maps of their sets say of most that too many shingles differ
(``_map_allows``); the others are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fringework.llm import common
from fringework.operators import components

FAN = 16
DEPTHS = (64, 48, 36)  # remaining bits at each pigeonhole split; a quarter of them is the band
FRONTIER = 2_000_000  # query-node pairs held at a time, of 64 bits each

#: Two texts of Jaccard similarity 0.8 have a cosine of 0.889 and differ in 0.151 of all bits, 155 of 1,024 with a standard
#: deviation of 11.5: the last limit lies 2.5 of these above, the first 4.8 below.
WIDE_WORDS, WIDE_MOST = 16, (100, 135, 160, 184)
FORESTS = 8
#: A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8**5)**16 = 0.998.
BANDS, ROWS = 16, 5
ROUND = 2040  # shingles counted at a time: eight rows of 255, which a byte can count


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, BANDS * ROWS + WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
WIDE_SEEDS, FACTORS = _STEPS[:WIDE_WORDS], _mixed(_STEPS[WIDE_WORDS:]) | np.uint64(1)


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, some at a time; fewer words than ``shingle`` are one shingle."""
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        some = words[at : at + (1 << 16) + shingle - 1]
        parts = zip(*(some[i:] for i in range(shingle)), strict=False) if len(some) >= shingle else [some]
        yield np.fromiter((digest(b" ".join(x), 42) for x in parts), np.uint64)


def wide_fingerprint(text: str | None, shingle: int = 5) -> tuple[int, list[int], bytes]:
    """Of the distinct shingles of a text: a signed number that equal sets share, the ``BANDS`` bucket numbers, the fingerprint.

    A text without words has number 0 and no bucket.
    """
    return _wide(shingle_set(text, shingle))


def _wide(h: np.ndarray) -> tuple[int, list[int], bytes]:
    if not len(h):
        return 0, [], bytes(8 * WIDE_WORDS)
    ones, least = np.zeros(64 * WIDE_WORDS, np.int64), np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), ROUND):
        some = h[at : at + ROUND]
        np.minimum(least, (some[:, None] * FACTORS).min(0), out=least)
        bits = np.unpackbits(_mixed(some[:, None] ^ WIDE_SEEDS).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(some), 255):
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    wide = np.packbits(2 * ones > len(h), bitorder="little").tobytes()
    bands = [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, BANDS * ROWS, ROWS)]
    return set_number(h), [_signed(x) for x in bands], wide


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of a text in ascending order; none without words."""
    words = common.words_of(text)
    return np.unique(np.concatenate(list(_hashes(words, shingle)))) if words else np.zeros(0, np.uint64)


def parity_map(hashes: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes ends in each number of 6 or more bits, two to four such numbers a hash. Two
    maps of a width differ in as many bits as hashes that one set has alone, at most; half of a map on the other is the map
    of half the width."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def _map_allows(one: bytes, two: bytes, sizes: int, share: int) -> bool:
    """False only if sets of these maps and this sum of sizes have less than ``share`` thousandths in common."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (one, two)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (1000 + share) <= sizes * (1000 - share)


def set_number(hashes: np.ndarray) -> int:
    """A signed number that names a set of shingles; 0 for none."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), 42)) if len(hashes) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash, as a signed number, of the ``shingle``-word shingles of a text; 0 without words."""
    words = common.words_of(text)
    if not words:
        return 0
    parts = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)] if len(words) >= shingle else [b" ".join(words)]
    n, total, digest = len(parts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(s, 42) for s in parts[at : at + (1 << 16)]), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, code`` of each row; the code is the fingerprint as a signed 64-bit number."""
    common.ship(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "code"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    x = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Index:
    """Gray-order hierarchical index over the codes of many buckets at once. ``bucket``: ascending numbers from 0; ``codes``:
    a number each, or a row of them, of which the first gives the order."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes if codes.ndim == 1 else codes[:, 0]), bucket))
        self.order, self.bucket, self.codes = order, bucket[order], codes[order]
        n = len(codes)
        full = np.full(codes.shape, np.uint64(0xFFFFFFFFFFFFFFFF))
        #: levels[0] are the codes; each level: bucket, shared mask, pattern, first child, end of children, end of codes
        self.levels = [(self.bucket, full, self.codes, np.arange(n), np.arange(n) + 1, np.arange(n) + 1)]
        while True:
            b, mask, pattern, _, _, end = self.levels[-1]
            first_of = np.searchsorted(b, b, side="left")
            nth = np.arange(len(b)) - first_of
            if not nth.any():
                break
            starts = np.flatnonzero(nth % FAN == 0)
            ends = np.append(starts[1:], len(b))
            ones = np.bitwise_and.reduceat(pattern, starts)
            # A bit is shared if all children share it and it is 1 in all or 0 in all.
            shared = np.bitwise_and.reduceat(mask, starts)
            zeros = np.bitwise_and.reduceat(mask & ~pattern, starts)
            up = shared & (ones | zeros)
            self.levels.append((b[starts], up, ones & up, starts, ends, end[ends - 1]))
        # What a node adds to the bits that the nodes above it hold.
        self.residual = [lv[1] for lv in self.levels]
        for k in range(len(self.levels) - 1):
            _, up, _, first, last, _ = self.levels[k + 1]
            self.residual[k] = self.levels[k][1] & ~np.repeat(up, last - first, axis=0)

    def components(self, most: int) -> np.ndarray:
        """For each code in index order, a number that codes linked by ``most`` or fewer bits share (an index of the component)."""
        label = np.arange(len(self.codes))
        self._link(label, most)
        return label

    def forests(self, limits: tuple[int, ...], number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links ``a, b`` (places in index order) and whether each is within the first limit: a forest of those that are, and
        up to ``number`` forests of further ones that span the components, without a link in common."""
        n = len(self.codes)
        near, joins = np.arange(n), []
        self._link(near, limits[0], joins)
        out, seen, active = [(a, b, np.ones(len(a), bool)) for a, b in joins], np.zeros(0, np.int64), np.ones(n, bool)
        for _ in range(number):
            label, joins = near.copy(), []
            for most in limits[1:]:
                self._link(label, most, joins, seen, active)
            if not sum(len(a) for a, _ in joins):
                break
            a, b = (np.concatenate(x) for x in zip(*joins, strict=True))
            out.append((a, b, np.zeros(len(a), bool)))
            seen, active = np.union1d(seen, a * n + b), np.isin(self.bucket, self.bucket[a])
        return tuple(np.concatenate([o[k] for o in out] + [np.zeros(0, (np.int64, np.int64, bool)[k])]) for k in range(3))

    def _link(self, label: np.ndarray, most: int, pairs: list[tuple[np.ndarray, np.ndarray]] | None = None, seen: np.ndarray | None = None, active: np.ndarray | None = None) -> None:
        """Unite what ``most`` or fewer bits link, in place. ``pairs`` gets the links that joined two components each; links
        ``seen`` (place of the first times the codes, plus that of the second) are passed over, as are codes not ``active``."""
        top = len(self.levels) - 1
        roots = np.searchsorted(self.levels[top][0], self.bucket)
        sizes = np.searchsorted(self.bucket, self.bucket, side="right") - np.searchsorted(self.bucket, self.bucket, side="left")
        queries = np.flatnonzero(sizes > 1 if active is None else (sizes > 1) & active)
        if not len(queries):
            return
        chunk, frontier = max(256, -(-len(queries) // 64)), FRONTIER // (1 if self.codes.ndim == 1 else self.codes.shape[1])
        for at in range(0, len(queries), chunk):
            q = queries[at : at + chunk]
            whole = self._whole(label)
            acc = _ones((self.codes[q] ^ self.levels[top][2][roots[q]]) & self.residual[top][roots[q]])
            stack = [(top, q, roots[q], acc)]
            while stack:
                level, q, node, acc = stack.pop()
                if not level:
                    if seen is not None and len(seen):
                        new = ~np.isin(q * len(label) + node, seen)
                        q, node = q[new], node[new]
                    _unite(label, q, node, pairs)
                    continue
                _, _, _, first, last, _ = self.levels[level]
                count = last[node] - first[node]
                if count.sum() > frontier and len(q) > 1:
                    half = len(q) // 2
                    stack += [(level, q[half:], node[half:], acc[half:]), (level, q[:half], node[:half], acc[:half])]
                    continue
                q, acc = np.repeat(q, count), np.repeat(acc, count)
                node = np.repeat(first[node] - (np.cumsum(count) - count), count) + np.arange(len(q))
                below = level - 1
                acc = acc + _ones((self.codes[q] ^ self.levels[below][2][node]) & self.residual[below][node])
                keep = (acc <= most) & (self.levels[below][5][node] > q + 1) & (whole[below][node] != label[q])
                stack.append((below, q[keep], node[keep], acc[keep]))

    def _whole(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the label that all its codes share, or -1."""
        out = [label.copy()]
        for _, _, _, first, last, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], first), np.maximum.reduceat(out[-1], first)
            out.append(np.where((low == high), low, -1))
        return out


def _ones(x: np.ndarray) -> np.ndarray:
    """How many bits are 1 in each number or row of numbers."""
    n = np.bitwise_count(x)
    return n.astype(np.int64) if x.ndim == 1 else n.sum(-1, dtype=np.int64)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
    """Merge the components of the pairs, in place; labels are roots (label[label] == label) before and after. ``pairs`` gets
    those that joined two components."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        if pairs is not None:
            order = np.lexsort((low, high))
            joins = order[np.unique(high[order], return_index=True)[1]]
            pairs.append((a[joins], b[joins]))
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _bands(bits: int) -> Column:
    """The four (band number, its value, the other bits) of ``rest``, which has ``bits`` bits."""
    width = bits // 4
    rest, out = F.col("rest"), []
    for j in range(4):
        low, high = j * width, (j + 1) * width
        value = F.shiftrightunsigned(rest, low) if low else rest
        value = value.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        upper = F.shiftleft(F.shiftrightunsigned(rest, high), low) if high < 64 else F.lit(0).cast("long")
        lower = rest.bitwiseAND(F.lit((1 << low) - 1).cast("long"))
        out.append(F.struct(F.lit(j + 1).alias("band"), value.alias("value"), upper.bitwiseOR(lower).alias("rest")))
    return F.explode(F.array(*out))


def _split(rows: DataFrame, bits: int) -> DataFrame:
    width = bits // 4
    return rows.select("path", "key", "code", _bands(bits).alias("x")).select(
        (F.col("path") * 5 + F.col("x.band")).alias("path"), F.shiftleft("key", width).bitwiseOR(F.col("x.value")).alias("key"), F.col("x.rest").alias("rest"), "code"
    )


def _links(units: DataFrame, *most: int) -> DataFrame:
    """Edges ``a, b`` from each code to the smallest one of its component within its unit (path, key). If a column ``wide``
    holds the fingerprints that the codes name, the edges are those of ``Index.forests`` and have ``near``."""
    spark = units.sparkSession
    common.ship(spark)
    named = "wide" in units.columns
    ready = units.select("path", "key", "code", *(["wide"] if named else [])).repartition("path", "key").sortWithinPartitions("path", "key")

    def out(paths: list[np.ndarray], keys: list[np.ndarray], codes: list[np.ndarray], *wide: list[np.ndarray]) -> pa.RecordBatch:
        path, key, code = np.concatenate(paths), np.concatenate(keys), np.concatenate(codes)
        new = np.ones(len(path), bool)
        new[1:] = (path[1:] != path[:-1]) | (key[1:] != key[:-1])
        index = Index(np.cumsum(new) - 1, np.concatenate(wide[0]) if named else code.view(np.uint64))
        own = code[index.order]
        if named:
            one, two, near = index.forests(most, FORESTS)
            return pa.RecordBatch.from_arrays([pa.array(own[one]), pa.array(own[two]), pa.array(near)], names=["a", "b", "near"])
        label = index.components(*most)
        root = own.copy()
        np.minimum.at(root, label, own)
        root = root[label]
        differ = root != own
        return pa.RecordBatch.from_arrays([pa.array(own[differ]), pa.array(root[differ])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        held: list[list[np.ndarray]] = [[] for _ in range(4 if named else 3)]
        rows, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(c, np.int64) for c in b.columns[:3]]
            if named:
                cols.append(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, -1))
            if rows >= 100_000:  # whole units only: what belongs to the last one waits
                cut = int(np.searchsorted((cols[0] != last[0]) | (cols[1] != last[1]), True)) if (cols[0][0], cols[1][0]) == last else 0
                if cut < len(cols[0]):
                    for h, c in zip(held, cols, strict=True):
                        h.append(c[:cut])
                    yield out(*held)
                    held, rows, cols = [[] for _ in held], 0, [c[cut:] for c in cols]
            for h, c in zip(held, cols, strict=True):
                h.append(c)
            rows += len(cols[0])
            last = int(cols[0][-1]), int(cols[1][-1])
        if rows:
            yield out(*held)

    return ready.mapInArrow(run, "a long, b long, near boolean" if named else "a long, b long")


def _blocks(rows: DataFrame, block: int, most: int) -> DataFrame:
    """Units of two blocks each for buckets too large even after all splits: ``path, key, code``.

    Buckets are range-partitioned in Gray order and cut into blocks; a block pair is kept only if the bits that each block
    shares differ in ``most`` places at most.
    """
    codes = rows.select("path", "key", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            cols = [np.asarray(c, np.int64) for c in b.columns[:3]]
            ids = np.empty(b.num_rows, np.int64)
            for i, now in enumerate(zip(cols[0].tolist(), cols[1].tolist(), strict=True)):
                if now != last or filled == block:
                    number, filled, last = number + 1, 0, now
                ids[i] = number
                filled += 1
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(ids)], names=["path", "key", "code", "block"])

    rank = F.col("code")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    spread = codes.withColumn("rank", rank).repartitionByRange(F.col("path"), F.col("key"), F.col("rank")).sortWithinPartitions("path", "key", "rank").select("path", "key", "code")
    cut = common.materialise(spread.mapInArrow(run, "path long, key long, code long, block long"), "blocks")
    nodes = cut.groupBy("path", "key", "block").agg(F.bit_and("code").alias("ones"), F.bit_or("code").alias("any"))
    nodes = common.materialise(nodes.withColumn("mask", F.col("ones").bitwiseOR(F.bitwise_not("any"))), "nodes")
    other = nodes.select("path", "key", *(F.col(c).alias(f"{c}2") for c in ("block", "ones", "mask")))
    far = F.bit_count(F.col("ones").bitwiseXOR(F.col("ones2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    pairs = nodes.join(other, ["path", "key"]).filter((F.col("block") <= F.col("block2")) & (far <= most))
    pairs = common.materialise(pairs.select("block", "block2"), "pairs")
    ends = pairs.select(F.col("block").alias("at"), "block", "block2").unionByName(pairs.filter("block <> block2").select(F.col("block2").alias("at"), "block", "block2"))
    return cut.select(F.col("block").alias("at"), "code").join(ends, "at").select(F.col("block").alias("path"), F.col("block2").alias("key"), "code")


def links(codes: DataFrame, most: int = 3, block: int = 4096, used: list[DataFrame] | None = None) -> DataFrame:
    """Edges between distinct codes (long column ``code``) whose components are those of all pairs within ``most`` bits (3 or fewer).

    ``used`` gets the tables that can be dropped once the edges are written.
    """
    if most > 3:
        raise ValueError("four bands find pairs of at most 3 differing bits")
    used = [] if used is None else used
    rows = codes.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key"), F.col("code").alias("rest"), "code")
    found: list[DataFrame] = []
    for depth, bits in enumerate(DEPTHS):
        rows = _split(rows, bits)
        large = common.materialise(rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block).drop("n"), f"large{depth}")
        used.append(large)
        if large.isEmpty():
            found.append(_links(rows, most))
            break
        found.append(_links(rows.join(large, ["path", "key"], "left_anti"), most))
        rows = common.materialise(rows.join(large, ["path", "key"], "left_semi"), f"rows{depth}")
        used.append(rows)
    else:
        found.append(_links(_blocks(rows, block, most), most))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def groups(docs: DataFrame, shingle: int = 3, most: int = 3, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, code, root, component_id`` of each row.

    ``component_id`` is the smallest id of the documents reachable by links (equal fingerprints link too), ``root`` the
    smallest code there. A null text has no words and fingerprint 0, which links like any other. Rows with a null id get
    the id of their component, null if it has none; repeated ids and rows are kept row by row; extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = common.materialise(fingerprints(docs, shingle, id_col, text_col), "codes")
    codes = common.materialise(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "distinct")
    used: list[DataFrame] = []
    return _grouped(rows, codes, links(codes, most, block, used), used)


def _grouped(rows: DataFrame, codes: DataFrame, linked: DataFrame, used: list[DataFrame]) -> DataFrame:
    edges = common.materialise(linked, "links")
    star = components.stars(edges)
    rooted = common.result(codes.join(star, codes["code"] == star["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root")), "rooted", codes, edges, star, *used)
    ids = common.materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    whole = common.result(rooted.join(ids, "root").select("code", "root", "component_id"), "labels", rooted, ids)
    return common.result(rows.join(whole, "code").select("doc_id", "code", "root", "component_id"), "groups", rows, whole)


def _wide_links(codes: DataFrame, most: tuple[int, ...], block: int, used: list[DataFrame]) -> DataFrame:
    """Pairs ``a < b, near`` of classes ``code, bands, wide`` that share a bucket and joined two components of it.

    Buckets of one class go before fingerprints are looked up. One of more than ``block`` classes is dealt to blocks, and
    each pair of blocks is a unit, so that a task holds at most two blocks of it and no link is lost.
    """
    entries = codes.select("code", F.explode("bands").alias("key"))
    sizes = common.materialise(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared", sweep=True)
    used.append(sizes)
    members = entries.join(sizes, "key").join(codes.select("code", "wide"), "code")
    pieces = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("code"), pieces)
    both = F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda j: F.least(own, j) * pieces + F.greatest(own, j))
    units = members.select(F.explode(F.when(F.col("n") > block, both).otherwise(F.array(F.lit(0).cast("long")))).alias("path"), "key", "code", "wide")
    out = common.materialise(_links(units, *most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "near").distinct(), "candidates", sweep=True)
    used.append(out)
    return out


def _alike(docs: DataFrame, codes: DataFrame, pairs: DataFrame, shingle: int, share: float, name: str) -> DataFrame:
    """The pairs that are ``near``, and those whose sets of shingles have ``share`` or more in common, as a table. Only texts of
    the latter are read again, one a class. docs: ``doc_id, text``; codes: ``code, least`` with the id of a row of each class."""
    sure, pairs = pairs.filter("near").select("a", "b"), pairs.filter("not near").select("a", "b")
    wanted = common.materialise(pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct().join(codes.select("code", "least"), "code"), "wanted", sweep=True)
    texts = docs.join(wanted.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for b in common.slices(batches, 0):
            found = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            hashes = pa.LargeListArray.from_arrays(ends, np.concatenate(found).view(np.int64)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([set_number(h) for h in found], pa.int64()), hashes], names=["code", "hashes"])

    # Rows of one id can have several texts, so the classes are looked at again.
    sets = texts.mapInArrow(run, "code long, hashes array<long>").join(wanted.select("code"), "code", "left_semi").groupBy("code").agg(F.first("hashes").alias("hashes"))
    sets = common.result(sets, "sets", wanted, sweep=True)
    one, two = (sets.select(F.col("code").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    common_ones = F.size(F.array_intersect("of_a", "of_b"))
    all_ones = F.size("of_a") + F.size("of_b") - common_ones
    alike = pairs.join(one, "a").join(two, "b").filter(common_ones.cast("long") * 1000 >= all_ones.cast("long") * round(share * 1000)).select("a", "b").unionByName(sure)
    return common.result(alike, name, sets, sweep=True)


#: Shingles that come last in the order of all shingles: those that ``COMMON_LEAST`` or more of a ``COMMON_PART``-th of the
#: texts have, the commonest ``MOST_COMMON`` at most. Which ones do is a matter of cost, not of what is found.
COMMON_PART, COMMON_LEAST, MOST_COMMON = 16, 3, 1 << 17


def _common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The commonest shingles, the commonest last, of a sample of the different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for b in common.slices(batches, 0):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], names=["h"])

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(COMMON_PART)) == 0).select("text").distinct()
    found = common.materialise(some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_LEAST), "common", sweep=True)
    out = np.asarray(found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow().column("h"), np.int64).view(np.uint64)[::-1]
    common.drop_table(texts.sparkSession, found)
    return out


def _first_shingles(h: np.ndarray, last: np.ndarray, place: np.ndarray, share: int) -> np.ndarray:
    """Of a set, in ascending order, the shingles of which a set with ``share`` thousandths in common has one, too. ``last``:
    the common shingles in ascending order, ``place``: their places in the order of all."""
    many = len(h) - -(-len(h) * share // 1000) + 1 if len(h) else 0
    if not len(last):
        return h[:many]
    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
    late = last[at] == h
    rare = h[~late]
    return rare[:many] if len(rare) >= many else np.concatenate([rare, h[late][np.argsort(place[at[late]])][: many - len(rare)]])


def _rest(codes: DataFrame, star: DataFrame, share: float) -> DataFrame:
    """Pairs ``a, b, near`` of classes in different components that can be alike: all those that have one of their first
    shingles in common, but for pairs whose sizes, places of that shingle or maps show that they aren't.

    codes: ``code, size, first, map``; star: ``node, root``. If two sets have the shingle at place i of a set of n as the
    first one in common, n - i at most are common, so that the other has ``most`` shingles at most.
    """
    spark, of = codes.sparkSession, round(share * 1000)
    rooted = codes.filter("size > 0").join(star, F.col("code") == F.col("node"), "left").select("code", "size", F.coalesce("root", "code").alias("root"), F.posexplode("first").alias("i", "key"))
    most = F.floor((F.col("size") - F.col("i")) * (1000 + of) / of) - F.col("size")
    entries = rooted.select("key", "code", "root", "size", most.alias("most"))
    keys = entries.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least_size"), F.max("most").alias("most_most"))
    keys = common.materialise(keys.filter("low < high").drop("low", "high"), "keys", sweep=True)
    met = entries.join(keys, "key").filter("most >= least_size and size <= most_most").drop("least_size", "most_most")
    met = common.result(met, "met", keys, sweep=True)
    one, two = (met.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("code", "root", "size", "most"))) for x in "ab")
    fits = (F.col("size_b") <= F.col("most_a")) & (F.col("size_a") <= F.col("most_b")) & (F.col("code_a") < F.col("code_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = common.result(one.join(two, "key").filter(fits).select(F.col("code_a").alias("a"), F.col("code_b").alias("b")).distinct(), "pairs", met, sweep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_map_allows(x, y, n, of) for x, y, n in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own, other = (codes.select(F.col("code").alias(x), F.col("map").alias(f"map_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
    looked = pairs.join(own, "a").join(other, "b").select("a", "b", "map_a", "map_b", (F.col("size_a") + F.col("size_b")).alias("sizes"))
    out = looked.mapInArrow(run, "a long, b long").withColumn("near", F.lit(False))
    return common.result(out, "rest", pairs, sweep=True)


def similar_groups(docs: DataFrame, shingle: int = 5, share: float = 0.8, most: tuple[int, ...] = WIDE_MOST, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``groups``, but texts link that have ``share`` or more of their distinct ``shingle``-word shingles in common.

    ``most``: rising limits of differing bits, fit for a share of 0.8: within the first a pair is taken as alike, within the
    others it is a candidate. Pairs that these leave apart are found by their first shingles. ``code`` names the set of shingles. Texts without words (null ones too) are one group. Nulls, repeated
    rows, extra columns and empty tables: as ``groups``.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.select(id_col).dtypes[0][1]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    late = _common_shingles(texts, shingle)
    order = np.argsort(late)
    shared, of = spark.sparkContext.broadcast((late[order], order)), round(share * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        last, place = shared.value
        for b in common.slices(batches, 1):
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            code, bands, wide = zip(*map(_wide, sets), strict=True)
            first = [_first_shingles(h, last, place, of) for h in sets]
            ends = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
            first = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(first).view(np.int64)))
            parity = pa.array([parity_map(h) if len(h) else b"" for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.array(map(len, sets), pa.int64()), first, parity], names=["doc_id", "code", "bands", "wide", "size", "first", "map"])

    whole = common.materialise(texts.mapInArrow(run, f"doc_id {kind}, code long, bands array<long>, wide binary, size long, first array<long>, map binary"), "whole")
    rows = common.materialise(whole.select("doc_id", "code"), "codes")
    codes = common.result(whole.groupBy("code").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("bands", "wide", "size", "first", "map"))), "distinct", whole, sweep=True)
    used: list[DataFrame] = []
    candidates = _wide_links(codes, most, block, used)
    found = _alike(texts, codes, candidates, shingle, share, "found")
    for t in used:
        common.drop_table(spark, t)
    star = components.stars(found)
    rest = _rest(codes, star, share)
    least = common.result(codes.select("code", "least"), "least", codes, star)
    more = _alike(texts, least, rest, shingle, share, "more")
    return _grouped(rows, least, found.unionByName(more), [found, more, rest])


def hexadecimal(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


#: A table of ids up to this size is broadcast; a larger one meets the texts in a shuffle join.
FEW_IDS, FEW_BYTES = 1_000_000, 32 << 20


def keep_one(docs: DataFrame, shingle: int = 3, most: int = 3, block: int = 4096, few_ids: int = FEW_IDS, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """All columns of one row of each component: that with the smallest id (null if it has no other), of several such rows one
    with the smallest code.

    With a ``share`` groups are those of ``similar_groups``, without those of ``groups``.
    Null and empty texts have fingerprint 0 and are one component. Of repeated rows one stays. Extra columns may have any
    names; an empty table gives an empty result. Texts are shuffled only if over ``few_ids`` ids go, but for those of ids
    that several rows share.
    """
    spark = docs.sparkSession
    common.ship(spark)
    if share is None:
        rows = groups(docs, shingle, most, block, id_col, text_col)
    else:
        rows = similar_groups(docs, shingle, share, WIDE_MOST, block, id_col, text_col)
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.filter(own).groupBy("root").agg(F.min(F.struct("code", "doc_id")).alias("x")).select(F.col("x.code").alias("kept_code"), F.col("x.doc_id").alias("kept_id"))
    first = common.materialise(first, "kept")
    # An id can be kept as a whole or not at all if one row has it; ids of several rows are looked at row by row.
    ids = rows.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    chosen = first.select("kept_id").distinct()
    ids = ids.join(chosen, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").filter("several").unionByName(ids.join(chosen, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_anti").withColumn("several", F.lit(False)))
    ids = common.result(ids, "ids", rows)
    names = docs.columns
    whole = docs.toDF(*(f"c{i}" for i in range(len(names))))
    place, key = names.index(text_col), F.col(f"c{names.index(id_col)}")
    many, size = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("doc_id").cast("string"))), F.lit(0))).first()
    few = many <= few_ids and size <= FEW_BYTES
    out = whole.join(F.broadcast(ids) if few else ids, key.eqNullSafe(F.col("doc_id")), "left_anti")
    several = ids.filter("several")
    if not several.isEmpty():
        code_of = fingerprint if share is None else lambda t, k: set_number(shingle_set(t, k))
        mixed = whole.join(F.broadcast(several) if few else several, key.eqNullSafe(F.col("doc_id")), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches, place):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([code_of(t, shingle) for t in b.column(place).to_pylist()], pa.int64())], names=[*b.schema.names, "code"])

        mixed = mixed.mapInArrow(run, StructType([*whole.schema.fields, StructField("code", LongType())]))
        mixed = mixed.join(first, (F.col("code") == F.col("kept_code")) & key.eqNullSafe(F.col("kept_id")), "left_semi")
        out = out.unionByName(mixed.dropDuplicates([f"c{names.index(id_col)}", "code"]).drop("code"))
    return out.toDF(*names)
