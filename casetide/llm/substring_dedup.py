"""Repeated passages: MinHash banding of paragraphs, confirmed similarity, clusters by components.

Quoted passages seldom begin and end at a text's own line breaks, so texts are cut into paragraphs in three ways: by content,
before each word whose hash (with its successor's) is the least among ``LONG_REACH`` words on either side, into lines, and at
blank lines. Cuts by content depend on the passage alone, wherever it stands. Each of these levels has clusters of its
own; paragraphs of ``LEAST_WORDS`` words or more are taken.

1. A text whose words all equal those of another (a lesser id's) is one span; only the least id of equal texts goes on, so
   thousands of copies cost a row each from here.
2. Each paragraph has a hash of its words and ``BANDS`` band keys of ``ROWS`` minima over its five-word shingles. At a
   similarity of 0.8 a pair is missed with probability (1 - 0.8 ** ROWS) ** BANDS, 0.6 %. Equal paragraphs need no more
   than their hash.
3. Keys held by two different paragraphs or more join their paragraphs with a few centres of the bucket, so a hot
   passage costs pairs for each variant of it, not for each occurrence.
4. Pairs are confirmed by the exact Jaccard coefficient of their shingles, and become clusters by components. Members of one
   bucket that are in different components by then go through ``minhash.rivals``, which loses no link. Before
   pairs are confirmed, those go whose sizes, or ``PARITY`` bits that tell how many shingles fall on each an odd number of times,
   rule the similarity out: every differing bit needs a shingle that only one side has, so none is lost by it.
5. Of each cluster the first occurrence stays: the least id, in it the first place. The others are removed.
6. Exact passages don't depend on the cuts: every run of ``PASSAGE`` words that an earlier place holds, too (a lesser id,
   or the same text ``PASSAGE`` words before or more), is removed to the word. Runs are compared only where the least hash of their
   ``SEED``-word sequences occurs twice; equal runs have the same, so none is lost by it. Runs next to one another with one
   seed are a block, one row. Equal blocks are compared once, by their first occurrence, and only its runs become rows.
7. What is removed in a text and overlaps or follows one another is one span; spans of ``LEAST_WORDS`` words or more are returned.

What goes on is told by bitmaps whose size follows the number of hashes, up to ``MOST_BITS``; a bit too many costs
rows, never a result.

Letters of ASCII are folded, and all but letters and digits separates words. Result: one row per span to remove. Null
and empty texts have no paragraphs, rows without an id take no part, and rows repeated whole count once. Rows of one id
with different texts take no part, since a span names its text by the id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_WORD, SPACE, Words, materialize, minima, mix64, passing_tables, seeds, shingle_hashes, short_batches, text_bytes
from .components import components
from .minhash import BROADCAST_IDS, confirmed, rivals, stars

LONG_REACH = 24
REACH, BANDS, ROWS, SHINGLE, PERCENT, LEAST_WORDS = 6, 5, 2, 5, 80, 24
#: Words of the exact passages that are found wherever they stand, and of the sequences that pick them.
PASSAGE, SEED = 51, 32
#: Bits of the parity sketch of a paragraph.
PARITY = 128
#: Bits of a filter for each hash in it, and in all at least and at most (64 MB); a row of the table that builds it has a part.
BITS_EACH, LEAST_BITS, MOST_BITS, PART_BITS = 16, 1 << 20, 1 << 29, 1 << 15

_PLANES = [f"parity{k}" for k in range(PARITY // 64)]

_STEP = 0x9E3779B97F4A7C15 | 1


def paragraph_starts(hashes: np.ndarray, rows: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The first words of paragraphs among the words of all rows, in order."""
    n = len(hashes)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    rank = mix64(hashes * seeds(1, 31)[0] + np.append(hashes[1:], np.uint64(0)) * seeds(1, 37)[0])
    place = np.arange(n) - rows[row] if n else np.zeros(0, np.int64)
    left = rows[row + 1] - np.arange(n) if n else place
    at = np.flatnonzero((place > reach) & (left > reach + 1))  # whose neighbours are all in their row
    if len(at):
        least = _window_minima(rank, reach)
        at = at[(rank[at] < least[at - reach]) & (rank[at] <= least[at + 1])]
    return np.union1d(at, rows[:-1][np.diff(rows) > 0])


def _window_minima(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` values next to one another, by their first."""
    width = 1
    while 2 * width <= span:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    return np.minimum(values[: len(values) - span + width], values[span - width :])


_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        up, down = np.full(max(n, 1 << 18), _STEP, np.uint64), np.full(max(n, 1 << 18), pow(_STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


class _Sequences:
    """Hashes of word sequences of any length, in constant time each."""

    def __init__(self, hashes: np.ndarray):
        up, self._down = _powers(len(hashes) + 1)
        self._sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self._sums[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[first]) * self._down[first] + (end - first).astype(np.uint64))


class Passages:
    """Runs of ``PASSAGE`` words of a batch of texts: first word, row, and the hash of the run's seed."""

    def __init__(self, words: Words, sequences: _Sequences):
        self.hash_of = sequences
        n = len(words.hashes)
        row = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
        self.first = np.flatnonzero(row[: max(n - PASSAGE + 1, 0)] == row[PASSAGE - 1 :])
        self.row = row[self.first]
        self.seed = np.zeros(0, np.int64)
        if len(self.first):
            at = np.arange(n - SEED + 1)
            rank = self.hash_of(at, at + SEED) >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)  # of equal ones the first
            rank = _window_minima(rank, PASSAGE - SEED + 1)
            self.seed = (rank[self.first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.at = self.first - words.rows[self.row]
        self.head = np.flatnonzero(np.append(True, self.seed[1:] != self.seed[:-1])[: len(self.seed)])

    def seeds(self) -> np.ndarray:
        """The hash of each block's seed."""
        at = self.seed[self.head]
        return self.hash_of(at, at + SEED).view(np.int64)

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the blocks ``which``, and where blocks begin among them, with an end."""
        head = self.head[which]
        size = np.append(self.head[1:], len(self.first))[which] - head
        stops = np.append(0, np.cumsum(size))
        return np.repeat(head - stops[:-1], size) + np.arange(stops[-1]), stops


class Paragraphs:
    """Paragraphs of a batch of texts: row, first word in it, words, hash and byte range, with shingles on demand."""

    def __init__(self, words: Words, sequences: _Sequences, at: np.ndarray, first: np.ndarray, end: np.ndarray, level: int):
        self.level, self._hashes, self._first = level, words.hashes, first
        self.row = np.searchsorted(words.rows, first, "right") - 1
        self.words = end - first
        self.lo = words.begins[first] - at[self.row]
        self.hi = words.ends[end - 1] - at[self.row]
        self.at = first - words.rows[self.row]
        self.hash = mix64(sequences(first, end) + np.uint64(level)).view(np.int64)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the paragraphs ``which``, in that order."""
        words = self.words[which]
        stops = np.append(0, np.cumsum(words))
        return shingle_hashes(self._hashes[np.repeat(self._first[which] - stops[:-1], words) + np.arange(stops[-1])], stops, SHINGLE)


#: By byte: 1 where it isn't white space.
_FILLED = (~np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))).astype(np.uint8)


def line_starts(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first words of lines, and those after a blank line."""
    first = np.zeros(len(words.hashes), bool)
    first[words.rows[:-1][np.diff(words.rows) > 0]] = True
    blank = first.copy()
    feeds = np.flatnonzero(data == 10)
    if len(first):
        after = np.searchsorted(words.begins, feeds)
        first[after[after < len(first)]] = True
        filled = np.maximum.reduceat(_FILLED[data], feeds) if len(feeds) else feeds
        after = after[:-1][filled[:-1] == 0]
        blank[after[after < len(first)]] = True
    return np.flatnonzero(first), np.flatnonzero(blank)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Words]]:
    for whole in batches:
        for i in range(0, whole.num_rows, 128):
            part = whole.slice(i, 128)
            data, at = text_bytes(part.column(1))
            yield part, data, at, Words(data, at, separators=NON_WORD)


def _paragraphs(data: np.ndarray, at: np.ndarray, words: Words, sequences: _Sequences) -> Iterator[Paragraphs]:
    lines, blank = line_starts(data, words)
    for level, first in enumerate((paragraph_starts(words.hashes, words.rows, LONG_REACH), lines, blank)):
        end = np.append(first[1:], len(words.hashes))
        long = end - first >= LEAST_WORDS
        if level == 2:  # a paragraph of one line is taken as a line
            long &= np.searchsorted(lines, end) - np.searchsorted(lines, first) > 1
        yield Paragraphs(words, sequences, at, first[long], end[long], level)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, low, high, words, lo, hi): 128 bits of each text's words, and where they begin and end."""
    for batch, _, at, words in _slices(batches):
        first, end = words.rows[:-1], words.rows[1:]
        digests = [_Sequences(mix64(words.hashes * seeds(1, salt)[0]))(first, end).view(np.int64) for salt in (47, 53)]
        some = end > first
        lo, hi = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        lo[some] = words.begins[first[some]] - at[:-1][some]
        hi[some] = words.ends[end[some] - 1] - at[:-1][some]
        columns = [batch.column(0), *map(pa.array, (*digests, *(x.astype(np.int32) for x in (end - first, lo, hi))))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "low", "high", "words", "lo", "hi"])


ENTRIES = "hash long, n int, keys array<long>"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph and, without keys, for each seed of passages, once a batch with how often it occurs."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    for _, data, at, words in _slices(batches):
        sequences = _Sequences(words.hashes)
        for p in _paragraphs(data, at, words, sequences):
            hashes, first, n = np.unique(p.hash, return_index=True, return_counts=True)
            least = mix64(minima(*p.shingles(first), seeds(BANDS * ROWS, 41))).reshape(-1, BANDS, ROWS)
            keys = mix64((least * seeds(ROWS, 59)).sum(axis=2, dtype=np.uint64) + seeds(BANDS, 43) + np.uint64(p.level))
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))], names=names)
        hashes, n = np.unique(Passages(words, sequences).seeds(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.list_(pa.int64()))], names=names)


def _distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, none of them empty, and where rows begin among them. ``values`` are sorted in place."""
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.append(True, values[1:] != values[:-1])
    new[rows[:-1]] = True
    return values[new], np.append(0, np.cumsum(np.add.reduceat(new, rows[:-1], dtype=np.int64)))


def _parities(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``PARITY`` bits of each row in words of 64: whether an odd number of its ``values`` fall on each."""
    n = len(rows) - 1
    place = (mix64(values) % np.uint64(PARITY)).astype(np.int64) + np.repeat(np.arange(n) * PARITY, np.diff(rows))
    odd = (np.bincount(place, minlength=n * PARITY) & 1).astype(np.uint8).reshape(n, PARITY)
    return np.packbits(odd, axis=1).view(np.int64).T.copy()


def _parity(members: np.ndarray) -> list[int]:
    return _parities(members, np.array([0, len(members)])).ravel().tolist()


class Filter:
    """A bitmap of hashes: true for all that were put in, and for few others."""

    def __init__(self, hashes: DataFrame):
        n = hashes.count()
        self.size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
        slot = F.pmod("hash", F.lit(self.size))
        parts = hashes.select((slot / PART_BITS).cast("int").alias("part"), (slot % PART_BITS).alias("bit")).groupBy("part")
        self.bits = np.zeros((self.size // PART_BITS, PART_BITS // 8), np.uint8)
        for r in parts.agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():  # MOST_BITS in all at most
            self.bits[r.part] = np.frombuffer(r.bits, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes % self.size
        return np.flatnonzero(self.bits.ravel()[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def _shared_entries(shared: Filter) -> Callable:
    """(key, id) of the paragraphs' keys whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column(1).flatten().to_numpy(), batch.column(0).to_numpy()
            k = shared(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[k]), pa.array(hashes[k // BANDS])], names=["key", "id"])

    return run


def _wanted(picked: Filter) -> Callable:
    """(id, members, n, parity): shingle sets of the paragraphs whose bit is set, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at, words in _slices(batches):
            for p in _paragraphs(data, at, words, _Sequences(words.hashes)):
                held = picked(p.hash)
                _, first = np.unique(p.hash[held], return_index=True)
                held = held[first]
                if len(held):
                    values, rows = _distinct(*p.shingles(held))
                    sets = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((8 * rows).astype(np.int32)), pa.py_buffer(values)])
                    columns = [pa.array(p.hash[held]), sets, pa.array(np.diff(rows)), *map(pa.array, _parities(values, rows))]
                    yield pa.RecordBatch.from_arrays(columns, names=["hash", "members", "n", *_PLANES])

    return run


def _members(hashes: DataFrame, texts: DataFrame) -> DataFrame:
    """(hash, members, n, parity): the shingle sets of the paragraphs named.

    They are taken from the texts where they are, by a filter, so no text is shuffled.
    """
    schema = "hash long, members binary, n long, " + ", ".join(f"{c} long" for c in _PLANES)
    found = texts.mapInArrow(_wanted(Filter(hashes)), schema)
    return materialize(found.join(hashes, "hash", "left_semi").dropDuplicates(["hash"]))


def _confirmed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of paragraph hashes whose shingles are similar enough."""
    for side in ("a", "b"):
        facts = [F.col(c).alias(f"{side}_{c}") for c in ("n", *_PLANES)]
        pairs = pairs.join(members.select(F.col("hash").alias(side), *facts), side)
    both = F.col("a_n") + F.col("b_n")
    differ = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _PLANES)
    sized = 100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n")
    pairs = materialize(pairs.where(sized & (differ * (100 + PERCENT) <= both * (100 - PERCENT))).select("a", "b"))
    return materialize(confirmed(pairs, _sets(members), PERCENT))


def _sets(members: DataFrame) -> DataFrame:
    return members.select(F.col("hash").alias("id"), "members")


def _links(crowded: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between similar members of the buckets ``crowded`` (key, id), enough to join all that belong together."""
    found = _confirmed(stars(crowded), members)
    root = components(found).withColumnRenamed("node", "id")
    placed = materialize(crowded.join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    return found.unionByName(rivals(placed, lambda ids: _sets(members), PERCENT))


#: Kinds of places: a paragraph, a block of runs of ``PASSAGE`` words, and runs that the same text holds before.
PARAGRAPH, BLOCK, AGAIN = 0, 1, 2
#: Blocks have the hash and the bytes of each run besides, and whether their text has no equal block before.
PLACES = "kind int, hash long, id long, at int, words int, lo int, hi int, fresh boolean, runs array<long>, begins array<int>, ends array<int>"


def _again(row: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which runs their own text holds ``PASSAGE`` words before or more."""
    order = np.lexsort((at, hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))[: len(row)]
    first = at[order][np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
    return order[at[order] >= first + PASSAGE]


def _places(paragraphs: Filter, seeds_: Filter) -> Callable:
    """The places of paragraphs, and of blocks of runs of ``PASSAGE`` words, whose hash's or seed's bit is set."""
    names = [c.split()[0] for c in PLACES.split(", ")]

    def rows(batch: pa.RecordBatch, kind: int, hashes: np.ndarray, row: np.ndarray, *numbers: np.ndarray, block: tuple = ()) -> pa.RecordBatch:
        n = len(row)
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(hashes), batch.column(0).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in numbers]]
        block = block or (pa.nulls(n, pa.bool_()), pa.nulls(n, pa.list_(pa.int64())), *[pa.nulls(n, pa.list_(pa.int32()))] * 2)
        return pa.RecordBatch.from_arrays([*columns, *block], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at, words in _slices(batches):
            sequences = _Sequences(words.hashes)
            for p in _paragraphs(data, at, words, sequences):
                k = paragraphs(p.hash)
                yield rows(batch, PARAGRAPH, p.hash[k], p.row[k], p.at[k], p.words[k], p.lo[k], p.hi[k])
            p = Passages(words, sequences)
            k, stops = p.blocks(seeds_(p.seeds()))
            first, row, place = p.first[k], p.row[k], p.at[k]
            hashes = p.hash_of(first, first + PASSAGE).view(np.int64)
            begins, ends = words.begins[first] - at[row], words.ends[first + PASSAGE - 1] - at[row]
            a, b = stops[:-1], stops[1:] - 1
            whole = p.hash_of(first[a], first[b] + PASSAGE).view(np.int64)
            offsets = pa.array(stops.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes, begins.astype(np.int32), ends.astype(np.int32))]
            fresh = np.zeros(len(a), bool)
            fresh[_fresh(row[a], whole)] = True
            yield rows(batch, BLOCK, whole, row[a], place[a], first[b] + PASSAGE - first[a], begins[a], ends[b], block=(pa.array(fresh), *lists))
            own = np.sort(_again(row, hashes, place))
            a = np.append(True, first[own][1:] != first[own][:-1] + 1)[: len(own)]
            a, b = own[a], own[np.append(a[1:], True)[: len(own)]]
            yield rows(batch, AGAIN, hashes[a], row[a], place[a], first[b] + PASSAGE - first[a], begins[a], ends[b])

    return run


def _fresh(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first place of each hash in each row."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    return order[np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))[: len(row)]]


def _repeated_runs(places: DataFrame) -> DataFrame:
    """(id, keep_id, at, words, lo, hi): the runs of ``PASSAGE`` words that an earlier place holds, too, a piece for each block.

    The runs of a block begin within ``PASSAGE`` words, so those removed overlap and are one piece from the first to the last.
    """
    blocks, piece = places.where(F.col("kind") == BLOCK), ["id", "keep_id", "at", "words", "lo", "hi"]
    with passing_tables(places.sparkSession) as keep:
        firsts = materialize(blocks.groupBy("hash").agg(F.min("id").alias("id"), F.max("id").alias("last")))
        runs = blocks.where("fresh").select("hash", "id", "runs").join(firsts, ["hash", "id"]).select("hash", "id", "last", F.posexplode("runs").alias("k", "run"))
        runs = materialize(runs)
        kept = runs.groupBy("run").agg(F.min("id").alias("keep_id"), F.max("last").alias("last")).where("keep_id < last").drop("last")
        held = keep(runs.select("hash", "k", "run").join(kept, "run").groupBy("hash").agg(F.collect_list(F.struct("k", "keep_id")).alias("held")))  # a block's runs, few
    later = F.filter("held", lambda r: r["keep_id"] != F.col("id"))
    found = blocks.select("hash", "id", "at", "begins", "ends").join(held, "hash").withColumn("held", later).where(F.size("held") > 0)
    a, b = F.array_min(F.transform("held", lambda r: r["k"])), F.array_max(F.transform("held", lambda r: r["k"]))
    found = found.withColumns({"a": a, "b": b, "keep_id": F.array_min(F.transform("held", lambda r: r["keep_id"]))})
    found = found.select("id", "keep_id", (F.col("at") + F.col("a")).alias("at"), (F.col("b") - F.col("a") + PASSAGE).alias("words"), F.get("begins", F.col("a")).alias("lo"), F.get("ends", F.col("b")).alias("hi"))
    again = places.where(F.col("kind") == AGAIN).withColumn("keep_id", F.col("id"))
    return found.select(*piece).unionByName(again.select(*piece))


def _repeated_paragraphs(places: DataFrame, root: DataFrame) -> DataFrame:
    """(id, keep_id, at, words, lo, hi): the paragraphs of each cluster but its first."""
    placed = places.join(root, "hash", "left").withColumn("cluster", F.coalesce("root", "hash")).drop("root", "hash")
    clusters = materialize(placed.groupBy("cluster").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    first = Window.partitionBy("id", "cluster").orderBy("at", "lo")
    copies = placed.join(clusters, "cluster").withColumn("k", F.row_number().over(first)).where("id <> keep_id OR k > 1")
    return copies.select("id", "keep_id", "at", "words", "lo", "hi")


def _equal_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole texts that repeat another's words, as pieces (id, keep_id, at, words, lo, hi); and the texts that go on, one row an id."""
    own = F.struct("low", "high", "words", "lo", "hi")
    found = materialize(texts.mapInArrow(_documents, "id long, low long, high long, words int, lo int, hi int"))
    ids = materialize(found.groupBy("id").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.count(F.lit(1)).alias("n")).select("id", "n", (F.col("a") != F.col("b")).alias("mixed"), "a.*"))
    digest = ["low", "high", "words"]
    one = ids.where(~F.col("mixed") & (F.col("words") >= LEAST_WORDS))
    firsts = materialize(one.groupBy(*digest).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    copies = materialize(one.drop("n").join(firsts, digest).where("id <> keep_id").select("id", "keep_id", F.lit(0).alias("at"), "words", "lo", "hi"))
    few = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    left = texts.join(few(materialize(ids.where("mixed").select("id").unionByName(copies.select("id")))), "id", "left_anti")
    again = materialize(ids.where("n > 1 AND NOT mixed").select("id"))
    if again.count():
        again = few(again)
        left = left.join(again, "id", "left_anti").unionByName(left.join(again, "id", "left_semi").dropDuplicates(["id"]))
    return copies, left


def _spans(pieces: DataFrame) -> DataFrame:
    """The ``pieces`` (id, keep_id, at, words, lo, hi) of each text, those that overlap or follow one another as one."""
    order = Window.partitionBy("id").orderBy("at", "words", "keep_id")
    before = F.max(F.col("at") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.coalesce((F.col("at") > F.col("before")).cast("int"), F.lit(1))).over(order)
    runs = pieces.withColumn("before", before).withColumn("run", run)
    return runs.groupBy("id", "run").agg(
        F.min("keep_id").alias("keep_id"), F.min("lo").alias("byte_from"), F.max("hi").alias("byte_to"),
        (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("long").alias("words"),
    )


def _repeated_hashes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id) of the buckets that different paragraphs share; (hash, paragraph) of paragraphs and of seeds that occur twice."""
    with passing_tables(texts.sparkSession) as keep:
        table = materialize(texts.mapInArrow(_entries, ENTRIES))
        paragraphs = table.where("keys IS NOT NULL").select("hash", "keys")
        entries = paragraphs.select("hash", F.explode("keys").alias("key"))
        shared = materialize(entries.groupBy("key").agg(F.min("hash").alias("x"), F.max("hash").alias("y")).where("x < y").select("key"))
        entries = paragraphs.mapInArrow(_shared_entries(Filter(shared.select(F.col("key").alias("hash")))), "key long, id long")
        crowded = keep(entries.distinct().join(shared, "key", "left_semi"))
        counted = table.groupBy("hash", F.isnotnull("keys").alias("paragraph")).agg(F.sum("n").alias("n")).where("n > 1")
        return crowded, keep(counted.select("hash", "paragraph"))


def _roots(crowded: DataFrame, texts: DataFrame) -> DataFrame:
    """(hash, root) of the paragraphs that are linked with others."""
    with passing_tables(texts.sparkSession) as keep:
        members = _members(materialize(crowded.select(F.col("id").alias("hash")).distinct()), texts)
        return keep(components(_links(crowded, members)).withColumnRenamed("node", "hash"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per span to remove: id, keep_id (the least whose text keeps any of it), bytes from and to, words."""
    short_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    with passing_tables(docs.sparkSession) as keep:
        copies, texts = _equal_texts(texts)
        copies = keep(copies)
        crowded, twice = _repeated_hashes(texts)
        root = keep(_roots(crowded, texts))
        repeated = materialize(twice.unionByName(root.select("hash", F.lit(True).alias("paragraph"))))
        filters = [Filter(repeated.where(c).select("hash")) for c in ("paragraph", "NOT paragraph")]
        places = keep(texts.mapInArrow(_places(*filters), PLACES))
    found = _repeated_paragraphs(places.where(F.col("kind") == PARAGRAPH).select("hash", "id", "at", "words", "lo", "hi"), root).unionByName(_repeated_runs(places))
    spans = _spans(found.unionByName(copies))
    return spans.where(F.col("words") >= least_words).select(F.col("id").alias(id_col), "keep_id", "byte_from", "byte_to", "words")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of the text; rows and other columns unchanged."""
    spans = repeated_passages(docs, id_col, text_col, least_words)
    lists = spans.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct("byte_from", "byte_to"))).alias("__spans"))
    raw = F.encode(F.col(text_col), "UTF-8")
    edges = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["byte_to"]))
    ends = F.concat(F.transform("__spans", lambda s: s["byte_from"]), F.array(F.octet_length(raw)))
    kept = F.aggregate(F.arrays_zip(edges.alias("a"), ends.alias("b")), F.lit(b""), lambda out, s: F.concat(out, F.substring(raw, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0)))))
    joined = docs.join(lists, docs[id_col] == F.col("__id"), "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.decode(kept, "UTF-8"))
    return joined.withColumn(text_col, text).drop("__id", "__spans")
