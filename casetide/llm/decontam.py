"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated query set; it is taken in blocks of items with at most ``BLOCK_WORDS`` words, so
everything the driver holds or ships has a fixed bound (vocabulary x latent dimensions).

1. One pass over all texts counts in how many documents each word of the block occurs (for the inverse document
   frequencies, over all documents). Then the rarest words of each item are its keys: so many that a stretch with a share of
   ``PARAPHRASE`` of the item's words, in order, must hold ``HITS`` of them. A second pass keeps the regions around
   stretches that hold as many keys of one item, so neither copy nor paraphrase is lost by it. Regions keep word
   numbers, not text.
2. Randomised SVD: with A the TF-IDF matrix of all passages of the regions and of the items, each partition adds
   its part of A'(A Omega); the Nystrom form gives the leading right singular vectors from that one sketch.
3. Each passage's latent vector is compared by cosine with those of all passages of the items, in blocks.
4. Candidates above ``COSINE`` that have enough of the item's words (``needed`` of the item) go to the longest common
   subsequence of item and neighbourhood. An item whose share of common words in order reaches ``COPY`` is a
   copy; from ``PARAPHRASE`` on it is a paraphrase if the answer, too, is there to ``ANSWER``. The answer is the
   item's last sentence, unless a column of answers is named. An item of one sentence and ``LONG`` words or more has no answer
   apart, so its share alone decides; a shorter one is its own answer and found as a copy only, since chance has 0.6 of a few words.

Result: one row per (document, item) found. Letters are folded and punctuation separates words. Null and empty
texts match nothing; items of fewer than ``SHORTEST`` words are left out, since chance repeats them. Rows without
an id are searched and returned with a null id. Repeated rows give one row per id and item (the best).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import NON_WORD, Words, materialize, short_batches, text_bytes

BLOCK_WORDS, SHORTEST, LONG = 20_000, 5, 12
LATENT, OVERSAMPLE = 64, 8
#: Keys of an item that a stretch holds at least; no more than the words that ``PARAPHRASE`` keeps of the shortest item.
HITS = 3
COSINE = 0.5
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
RESULT = "doc_id long, item_id long, verdict string, lcs double, answer double, cosine double, word_at long"


def reach_of(n: int) -> int:
    """Words of the stretch in which an item of ``n`` words is looked for."""
    return n + n // 4 + 1


def kept_of(n: int) -> int:
    """Words that a paraphrase keeps at least of an item of ``n`` words."""
    return int(np.ceil(PARAPHRASE * n - 1e-9))


def needed(n: int, window: int) -> int:
    """The item's words that one window at least holds of a stretch that has ``PARAPHRASE`` of an item of ``n`` words."""
    whole, rest = divmod(reach_of(n), window)
    kept = kept_of(n)
    return max(1, max(m + 1 for m in range(window) if m * whole + min(m, rest) < kept))


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Block:
    """Items of one length class, numbered words, and the shape of passages."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    apart: list[bool]
    terms: np.ndarray
    window: int
    stride: int

    @property
    def need(self) -> int:
        return min(needed(len(w), self.window) for w in self.words)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words = Words(*text_bytes(pa.array(texts, pa.string())), separators=NON_WORD, fold=False)
    return [words.hashes[words.rows[i] : words.rows[i + 1]] for i in range(len(texts))]


def blocks(items: list[Row]) -> list[Block]:
    """``items``: rows of (item_id, text, answer), text in lower case, answer null for the last sentence."""
    rows = sorted({(r.item_id, r.text, r.answer) for r in items if r.text and r.item_id is not None}, key=lambda r: (r[0], r[1]))
    answers = [r[2] or next((p for p in reversed(re.split(r"(?<=[.!?])\s+", r[1].strip())) if re.search(r"\w", p)), r[1]) for r in rows]
    words, ends = _hashes([r[1] for r in rows]), _hashes(answers)
    apart = [bool(r[2]) or len(e) < len(w) or len(w) < LONG for r, w, e in zip(rows, words, ends, strict=True)]
    out = []
    for least, most, window, stride in ((SHORTEST, LONG, 4, 1), (LONG, 1 << 40, 12, 4)):
        chosen = [i for i in range(len(rows)) if least <= len(words[i]) < most]
        while chosen:
            size, n = 0, 0
            while n < len(chosen) and (n == 0 or size + len(words[chosen[n]]) <= BLOCK_WORDS):
                size += len(words[chosen[n]])
                n += 1
            part, chosen = chosen[:n], chosen[n:]
            terms = np.unique(np.concatenate([words[i] for i in part]))
            number = lambda h, t=terms: np.where(t[np.minimum(np.searchsorted(t, h), len(t) - 1)] == h, np.searchsorted(t, h), -1).astype(np.int32)
            out.append(Block([rows[i][0] for i in part], [number(words[i]) for i in part], [number(ends[i]) for i in part], [apart[i] for i in part], terms, window, stride))
    return out


class _Numbers:
    """Word hash to number of the term, or -1, by a table of the hashes' leading bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.shift = np.uint64(64 - max(12, int(len(terms)).bit_length() + 6))
        slots = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.first = np.searchsorted(terms, slots).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(terms))).max())

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int32)
        for k in range(self.most):
            spot = np.minimum(at + k, len(self.terms) - 1)
            out = np.where(self.terms[spot] == hashes, spot, out)
        return out


def _frequencies(block: Block) -> Callable:
    """(term, n): in how many documents of the task each term occurs, and at the number after the last how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, size = _Numbers(block.terms), len(block.terms)
        counts = np.zeros(size + 1, np.int64)
        for batch in (whole.slice(i, 100) for whole in batches for i in range(0, whole.num_rows, 100)):
            words = Words(*text_bytes(batch.column(1)), separators=NON_WORD, fold=False)
            term = numbers(words.hashes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.rows))
            inside = term >= 0
            counts[:size] += np.bincount(np.unique(row[inside] * size + term[inside]) % size, minlength=size)
            counts[size] += batch.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["term", "n"])

    return run


@dataclass
class Keys:
    """The key words of a block's items: hashes in order, and the items of word k at first[k] to first[k + 1]."""

    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    reach: np.ndarray


def keys_of(block: Block, frequency: np.ndarray) -> Keys:
    """Of any ``kept_of(n)`` words of an item of n words, ``HITS`` are among its ``n - kept_of(n) + HITS`` rarest."""
    pairs = set()
    for i, words in enumerate(block.words):
        rarest = np.argsort(frequency[words], kind="stable")[: len(words) - kept_of(len(words)) + HITS]
        pairs |= {(int(t), i) for t in words[rarest]}
    term, items = np.array(sorted(pairs), np.int64).T.copy()
    used, first = np.unique(term, return_index=True)
    return Keys(block.terms[used], np.append(first, len(term)), items, np.array([reach_of(len(w)) for w in block.words]))


def stretches(place: np.ndarray, item: np.ndarray, row: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, item) of ``HITS`` keys of one item, one after the other, that lie in one row within its reach."""
    order = np.lexsort((place, item))
    place, item = place[order], item[order]
    n = max(len(place) - HITS + 1, 0)
    first, last = place[:n], place[HITS - 1 :] if n else place[:0]
    near = (item[:n] == item[len(item) - n :]) & (last - first < reach[item[:n]])
    near[near] = row[first[near]] == row[last[near]]
    return first[near], last[near], item[:n][near]


def _regions(block: Block, keys: Keys) -> Callable:
    """(id, at, data): the word numbers of the stretches in which an item may be, from word ``at`` of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, key_numbers = _Numbers(block.terms), _Numbers(keys.terms)
        many = np.diff(keys.first)
        for batch in (whole.slice(i, 100) for whole in batches for i in range(0, whole.num_rows, 100)):
            words = Words(*text_bytes(batch.column(1)), separators=NON_WORD, fold=False)
            key = key_numbers(words.hashes)
            place = np.flatnonzero(key >= 0)
            key = key[place]
            stops = np.cumsum(many[key])
            item = keys.items[np.repeat(keys.first[key] - stops + many[key], many[key]) + np.arange(stops[-1] if len(stops) else 0)]
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.rows))
            first, last, item = stretches(np.repeat(place, many[key]), item, row, keys.reach)
            if not len(first):
                continue
            around = keys.reach[item] + block.window
            lo = np.maximum(last - around, words.rows[row[first]])
            hi = np.minimum(first + around, words.rows[row[first] + 1])
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.append(True, lo[1:] >= hi[:-1])
            lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:], len(hi)) - 1]
            data = [numbers(words.hashes[a:b]).tobytes() for a, b in zip(lo, hi, strict=True)]
            columns = [batch.column(0).take(pa.array(row[lo])), pa.array(lo - words.rows[row[lo]]), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "at", "data"])

    return run


def _joined(blobs: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of several regions in one array, ``window`` unknown words after each, and where each begins."""
    gap = np.full(window, -1, np.int32)
    parts = [np.frombuffer(b.as_buffer(), np.int32) for b in blobs]
    begins = np.concatenate([[0], np.cumsum([len(p) + window for p in parts])]).astype(np.int64)
    return np.concatenate([x for p in parts for x in (p, gap)] or [gap]), begins


def _passages(term: np.ndarray, window: int, stride: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Where passages with enough known words begin, one a stride at most, and their words."""
    known = np.concatenate([[0], np.cumsum(term >= 0)])
    begin = np.flatnonzero(known[window:] - known[:-window] >= need)
    begin = begin[np.append(True, np.diff(begin // stride) > 0)] if len(begin) else begin
    return begin, np.lib.stride_tricks.sliding_window_view(term, window)[begin]


def _latent(passages: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``matrix`` (its last row is zero, for unknown words) over each passage's words."""
    out = np.zeros((len(passages), matrix.shape[1]), np.float32)
    for k in range(passages.shape[1]):
        out += matrix[passages[:, k]]
    return out


def _sketch_of(passages: np.ndarray, weighted: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A Omega) of ``passages`` to ``out``; rows of A have unit length."""
    norm = np.sqrt(np.maximum((idf[passages] ** 2).sum(axis=1), 1e-12))
    seen = _latent(passages, weighted) / norm[:, None] ** 2
    for k in range(passages.shape[1]):
        order = np.argsort(passages[:, k], kind="stable")
        number = passages[order, k]
        first = np.flatnonzero(np.append(True, np.diff(number) != 0)) if len(number) else number
        if len(first):
            out[number[first]] += np.add.reduceat(seen[order], first, axis=0) * idf[number[first]][:, None]


def _item_passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(item, words) of every passage of every item, a stride apart at most."""
    owner, words = [], []
    for i, w in enumerate(block.words):
        begins = sorted({*range(0, len(w) - block.window + 1, block.stride), len(w) - block.window})
        owner += [i] * len(begins)
        words += [w[b : b + block.window] for b in begins]
    return np.array(owner), np.array(words, np.int32)


def _search(block: Block, matrix: np.ndarray, idf: np.ndarray) -> Callable:
    window, stride, need = block.window, block.stride, block.need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, words = _item_passages(block)
        unit = lambda z: z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)
        targets = unit(_latent(words, matrix)).T.copy()
        member = np.zeros((len(block.ids), len(matrix)), bool)
        for i, w in enumerate(block.words):
            member[i, w] = True
        enough = np.array([needed(len(w), window) for w in block.words])
        item_words = [w.tolist() for w in block.words]
        answer_words = [w.tolist() for w in block.answers]
        for batch in batches:
            docs, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            term, regions = _joined(batch.column(2), window)
            begins, passages = _passages(term, window, stride, need)
            pairs: dict[tuple[int, int, int], float] = {}
            for p in range(0, len(begins), 4096):
                part = passages[p : p + 4096]
                cosine = unit(_latent(part, matrix)) @ targets
                x, y = np.divmod(np.flatnonzero(cosine >= COSINE), len(owner))
                near = np.flatnonzero(member[owner[y][:, None], part[x]].sum(axis=1) >= enough[owner[y]])
                where = begins[p + x[near]]
                for k, region, begin in zip(near.tolist(), (np.searchsorted(regions, where, "right") - 1).tolist(), where.tolist(), strict=True):
                    item = int(owner[y[k]])  # one look for each item and neighbourhood
                    spot = (region, item, (begin - int(regions[region])) // max(1, len(item_words[item]) // 2))
                    pairs[spot] = max(pairs.get(spot, 0.0), float(cosine[x[k], y[k]]))
            best: dict[tuple[int, int], tuple] = {}
            held: dict[tuple[int, int], np.ndarray] = {}
            for (region, item, spot), value in pairs.items():
                a, place = item_words[item], (region, item)
                if best.get(place, (0.0,))[0] == 1.0:
                    continue
                own = term[regions[region] : regions[region + 1] - window]
                half, reach = max(1, len(a) // 2), reach_of(len(a))
                if place not in held:  # how many words before each are the item's
                    held[place] = np.append(0, np.cumsum(member[item, own]))
                starts = np.arange(max(0, (spot - 2) * half), min((spot + 1) * half + 1, len(own)), max(1, len(a) // 8))
                inside = held[place][np.minimum(starts + reach, len(own))] - held[place][starts]
                for s in starts[inside >= PARAPHRASE * len(a) - 1e-9].tolist():  # fewer can't hold a subsequence that long
                    stretch = own[s : s + reach].tolist()
                    share = lcs_length(a, stretch) / len(a)
                    if share >= PARAPHRASE and share > best.get(place, (0.0,))[0]:
                        end = answer_words[item]
                        best[place] = (share, lcs_length(end, stretch) / max(1, len(end)), value, s)
            found = [
                (docs[region], block.ids[item], "copy" if share >= COPY else "paraphrase", share, answer, value, places[region] + spot)
                for (region, item), (share, answer, value, spot) in best.items()
                if share >= COPY or answer >= ANSWER or not block.apart[item]
            ]
            names = [c.split()[0] for c in RESULT.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _sketch(block: Block, weighted: np.ndarray, idf: np.ndarray) -> Callable:
    window, need = block.window, block.need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(weighted.shape, np.float32)
        for batch in batches:
            _, passages = _passages(_joined(batch.column(0), window)[0], window, window, need)
            for i in range(0, len(passages), 8192):
                _sketch_of(passages[i : i + 8192], weighted, idf, out)
        used = np.flatnonzero(out[:-1].any(axis=1))
        names = ["term", *[f"y{k}" for k in range(out.shape[1])]]
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(out[used, k].astype(np.float64)) for k in range(out.shape[1])]], names=names)

    return run


def right_vectors(sketch: np.ndarray, omega: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading eigenvectors of A'A from sketch = A'A omega, by the Nystrom form."""
    shift = 1e-7 * max(float(np.linalg.norm(sketch)), 1e-12)
    moved = sketch + shift * omega
    core = omega.T @ moved
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-12 * max(values.max(), 1e-300)
    left = np.linalg.svd(moved @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0]
    return left[:, :k]


def _search_block(docs: DataFrame, block: Block) -> DataFrame:
    n = len(block.terms)
    frequency = np.zeros(n + 1)
    counted = docs.mapInArrow(_frequencies(block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # at most one row for each term of the block
        frequency[r.term] = r.n
    regions = materialize(docs.mapInArrow(_regions(block, keys_of(block, frequency)), "id long, at long, data binary"))
    idf = np.append(np.log((frequency[n] + 1) / (frequency[:n] + 1)) + 0.1, 0).astype(np.float32)
    width = min(LATENT + OVERSAMPLE, n)
    omega = np.linalg.qr(np.random.default_rng(3).normal(size=(n, width)))[0]
    weighted = np.vstack([omega, np.zeros(width)]).astype(np.float32) * idf[:, None]
    names = [f"y{k}" for k in range(width)]
    sums = regions.select("data").mapInArrow(_sketch(block, weighted, idf), "term long, " + ", ".join(f"{c} double" for c in names))
    table = sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row for each term at most
    sketch = np.zeros((n + 1, width), np.float32)
    _sketch_of(_item_passages(block)[1], weighted, idf, sketch)
    sketch = sketch[:n].astype(np.float64)
    sketch[table["term"].to_numpy()] += table[names].to_numpy()
    vectors = right_vectors(sketch, omega, LATENT)
    matrix = np.vstack([vectors, np.zeros(vectors.shape[1])]).astype(np.float32) * idf[:, None]
    return regions.mapInArrow(_search(block, matrix, idf), RESULT)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per document and item found in it (see the module)."""
    spark = docs.sparkSession
    short_batches(spark)
    answer = F.lower(F.col(answer_col)) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.lower(F.col(item_text)).alias("text"), answer.alias("answer")).collect()  # the stated query set
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text"))
    found = spark.createDataFrame([], RESULT)
    for block in blocks(items):
        found = found.unionByName(_search_block(texts, block))
    best = F.max_by(F.struct("verdict", "lcs", "answer", "cosine", "word_at"), F.struct("lcs", "answer", "cosine", -F.col("word_at"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(F.col("doc_id").alias(id_col), "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found; columns unchanged."""
    gone = find_leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__gone")).where("__gone IS NOT NULL").distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
