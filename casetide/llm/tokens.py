"""Token ids in a succinct binary format: one wavelet matrix per shard.

Texts are dealt by ranges of their id and encoded in order; each task cuts its tokens into shards of about
``SHARD_TOKENS`` tokens, whole documents each. A shard's file holds the sorted alphabet of its ids, one bit plane
for each bit of an id's place in that alphabet (each stably partitioned by the plane before), how many zeros each
plane has, and counts of ones before every ``BLOCK`` bits. From the file alone ``WaveletMatrix`` gives the token at a
place, how often an id occurs before a place, and the place of its k-th occurrence, in a step for each plane.

Files are rows of a Parquet table, since executors reach a shared store through Spark's writers only. The number of
tokens before a task's first one comes from the tasks' totals, one number each.

A text is encoded piece by piece (see ``Encoder``), so frequent pieces are looked up; the ids are those of encoding
the whole text. Null text is empty and yields the end id alone. Rows without an id
come first. Rows of one id are ordered by a hash of their text. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, short_batches, text_bytes

END_ID = 2
SHARD_TOKENS = 1 << 18
#: Bits between two counts of the directory.
BLOCK = 512
#: Pieces kept with their ids, in each worker; bits of a place in their table (42 MB); words encoded as one text.
REMEMBERED, SLOT_BITS, JOINED = 1_000_000, 21, 2_000
MAGIC = b"WVLTMTX1"


class WaveletMatrix:
    """A sequence of ids as bit planes with rank and select."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.bincount(ids, minlength=1) if len(ids) else np.zeros(1, np.int64)
        alphabet = np.flatnonzero(present).astype(np.uint32)
        place = np.zeros(len(present), np.uint32 if len(alphabet) > 65536 else np.uint16)
        place[alphabet] = np.arange(len(alphabet))
        code = place[ids]
        bits = max(1, int(max(len(alphabet) - 1, 1)).bit_length())
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (code >> b) & 1 == 1
            planes.append(np.packbits(bit, bitorder="little"))
            low = code[~bit]
            zeros.append(len(low))
            code = np.concatenate([low, code[bit]])
        planes = np.array(planes, np.uint8).reshape(bits, -1)
        return cls(len(ids), alphabet, np.array(zeros, np.uint32), planes, cls._directory(planes))

    @staticmethod
    def _directory(planes: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        blocks = -(-planes.shape[1] // step)
        padded = np.zeros((len(planes), blocks * step), np.uint8)
        padded[:, : planes.shape[1]] = planes
        ones = np.bitwise_count(padded).reshape(len(planes), blocks, step).sum(axis=2, dtype=np.uint32)
        return np.concatenate([np.zeros((len(planes), 1), np.uint32), np.cumsum(ones, axis=1, dtype=np.uint32)], axis=1)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.alphabet), len(self.planes), self.planes.shape[1], self.ranks.shape[1]], np.uint32)
        return MAGIC + b"".join(x.tobytes() for x in (head, self.alphabet, self.zeros, self.ranks, self.planes))

    @classmethod
    def from_bytes(cls, file: bytes) -> WaveletMatrix:
        if bytes(file[:8]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, letters, bits, width, blocks = np.frombuffer(file, np.uint32, 5, 8).tolist()
        at = 28
        parts = []
        for count in (letters, bits, bits * blocks):
            parts.append(np.frombuffer(file, np.uint32, count, at))
            at += 4 * count
        planes = np.frombuffer(file, np.uint8, bits * width, at).reshape(bits, width)
        return cls(n, parts[0], parts[1], planes, parts[2].reshape(bits, blocks))

    def __len__(self) -> int:
        return self.n

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before bit i."""
        block = i // BLOCK
        count, at = int(self.ranks[plane, block]), block * BLOCK // 8
        count += int(np.bitwise_count(self.planes[plane, at : i // 8]).sum())
        return count + (int(self.planes[plane, i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(len(self.planes)):
            bit = int(self.planes[p, i // 8]) >> i % 8 & 1
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _descend(self, code: int, i: int) -> int:
        for p in range(len(self.planes)):
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if code >> (len(self.planes) - 1 - p) & 1 else i - ones
        return i

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before place i."""
        code = self._code(token)
        return 0 if code is None else self._descend(code, i) - self._descend(code, 0)

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        return self.rank(token, self.n if end is None else end) - self.rank(token, begin)

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of ``token``."""
        code = self._code(token)
        if code is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._descend(code, 0) + k
        for p in range(len(self.planes) - 1, -1, -1):
            one = code >> (len(self.planes) - 1 - p) & 1
            target = i - int(self.zeros[p]) if one else i
            lo, hi = 0, self.n - 1  # the bit of that rank, by halving
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._ones(p, mid + 1)
                if (ones if one else mid + 1 - ones) > target:
                    hi = mid
                else:
                    lo = mid + 1
            i = lo
        return i

    def decode(self) -> np.ndarray:
        """All ids in order."""
        code = np.zeros(self.n, np.uint32 if len(self.alphabet) > 65536 else np.uint16)
        for p in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            zeros = int(self.zeros[p])
            before = np.empty_like(code)
            before[~bit] = code[:zeros]
            before[bit] = code[zeros:] | code.dtype.type(1 << (len(self.planes) - 1 - p))
            code = before
        return self.alphabet[code]


#: Kinds of bytes: 0 white space, 1 ASCII letter, 2 other ASCII, 3 the rest; and ASCII letters folded.
_KIND = np.array([0 if i in (32, 9, 10, 11, 12, 13) else 3 if i > 127 else 1 if chr(i).isalpha() else 2 for i in range(256)], np.uint8)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


#: The tokenizer in whose vocabulary pieces can be looked up (fixed values of its file).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"


def splits_at_pieces(tokenizer) -> bool:
    """Whether the tokenizer folds letters, drops white space and ends a token wherever ``Encoder`` cuts pieces."""
    spec = json.loads(tokenizer.to_str())
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    before = spec["pre_tokenizer"] or {}
    return (
        (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS
        and before.get("pretokenizers", [])[:1] == [split]
        and [x["type"] for x in before["pretokenizers"][1:]] == ["ByteLevel"]
        and not (before["pretokenizers"][1]["add_prefix_space"] or before["pretokenizers"][1]["use_regex"])
        and spec["model"]["type"] == "BPE"
        and spec["model"].get("end_of_word_suffix") == _WORD_END
        and spec["truncation"] is None
        and all(x["content"].startswith("<|") and not x["normalized"] for x in spec["added_tokens"])
    )


@cache
def encoder(path: str) -> Encoder:
    """The process's own encoder of a tokenizer file: what one task has learned serves the next."""
    return Encoder(path)


class _Table:
    """Numbers of short byte strings, packed in two integers each with their length, by open addressing."""

    MOST = 15

    def __init__(self) -> None:
        self.low, self.high = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint64)
        self.number = np.full(1 << SLOT_BITS, -1, np.int32)

    @staticmethod
    def packed(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``data`` ends with 16 bytes more than the strings need."""
        at = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
        return at[begin] & _FIRST_BYTES[np.minimum(size, 8)], at[begin + 8] & _FIRST_BYTES[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)

    @staticmethod
    def _slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix64(low ^ high * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers, -1 for those that aren't there."""
        slot, out, open_ = self._slots(low, high), np.full(len(low), -1, np.int32), np.arange(len(low))
        while len(open_):
            number = self.number[slot]
            used = number >= 0
            same = used & (self.low[slot] == low[open_]) & (self.high[slot] == high[open_])
            out[open_[same]] = number[same]
            on = used & ~same
            open_, slot = open_[on], slot[on] + 1 & (1 << SLOT_BITS) - 1
        return out

    def put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Strings that differ from one another and from those that are there."""
        slot, open_ = self._slots(low, high), np.arange(len(low))
        while len(open_):
            free = self.number[slot] < 0
            self.number[slot[free]] = number[open_[free]]
            won = self.number[slot] == number[open_]
            self.low[slot[won]], self.high[slot[won]] = low[open_[won]], high[open_[won]]
            open_, slot = open_[~won], slot[~won] + 1 & (1 << SLOT_BITS) - 1


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Encoder:
    """Ids of whole texts, by looking up their pieces.

    Where ``splits_at_pieces`` holds, a token ends at white space and where an ASCII letter meets another ASCII sign, and
    letters are folded, so pieces between such places, folded, have the ids they have in the text. Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = splits_at_pieces(self.tokenizer)
        words = self.tokenizer.get_vocab() if self.by_pieces else {}
        self._ends_word = np.zeros(1 + max(words.values(), default=0), bool)
        self._ends_word[[i for w, i in words.items() if w.endswith(_WORD_END)]] = True
        self.short, self.long = _Table(), {}
        self.n = 0  # pieces known; the ids of piece k are flat[ends[k]:ends[k + 1]]
        self.flat, self.ends = np.zeros(1 << 20, np.uint32), np.zeros(REMEMBERED + 1, np.int64)

    def _forget(self) -> None:
        """Keep the pieces met first: frequent ones are among them."""
        self.n = REMEMBERED // 2
        old, self.short = self.short, _Table()
        kept = (old.number >= 0) & (old.number < self.n)
        self.short.put(old.low[kept], old.high[kept], old.number[kept])
        self.long = {p: k for p, k in self.long.items() if k < self.n}

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids, and how many each has. Pieces of letters are one word each and are encoded as one text."""
        letters = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        words = [p for p, x in zip(pieces, letters.tolist(), strict=True) if x]
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        stops = np.flatnonzero(self._ends_word[ids]) + 1
        if len(stops) != len(words):  # folding has split a word
            letters[:] = False
            ids, stops = ids[:0], stops[:0]
        rest = self.tokenizer.encode_batch_fast([p for p, x in zip(pieces, letters.tolist(), strict=True) if not x], add_special_tokens=False)
        others = np.fromiter(chain.from_iterable(e.ids for e in rest), np.uint32)
        sizes = np.zeros(len(pieces), np.int64)
        sizes[letters] = np.diff(stops, prepend=0)
        sizes[~letters] = [len(e.ids) for e in rest]
        out = np.empty(len(ids) + len(others), np.uint32)
        of_words = np.repeat(letters, sizes)
        out[of_words], out[~of_words] = ids, others
        return out, sizes

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers that the pieces get."""
        ids, sizes = self._ids_of(list(map(bytes.decode, pieces)))
        stops = self.ends[self.n] + np.cumsum(sizes)
        while self.n + len(pieces) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while stops[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.ends[self.n] : stops[-1]] = ids
        self.ends[self.n + 1 : self.n + 1 + len(pieces)] = stops
        self.n += len(pieces)
        return np.arange(self.n - len(pieces), self.n, dtype=np.int32)

    def _whole(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the lookup, for texts that may hold the special tokens' strings and for other tokenizers."""
        raw = data.tobytes()
        found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], add_special_tokens=False)
        sizes = np.array([len(e.ids) for e in found], np.int64)
        return np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32, int(sizes.sum())), sizes

    def _numbers(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of the pieces; new ones are learned."""
        low, high = _Table.packed(data, begin, size)
        fits = size <= _Table.MOST
        numbers = np.full(len(begin), -1, np.int32)
        numbers[fits] = self.short.find(low[fits], high[fits])
        raw = data.tobytes()
        piece = lambda k: raw[begin[k] : begin[k] + size[k]]
        long = np.flatnonzero(~fits).tolist()
        numbers[long] = [self.long.get(piece(k), -1) for k in long]
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            pieces = list(map(piece, new))
            first = {p: k for p, k in zip(reversed(pieces), reversed(new), strict=True)}
            learned = self._learn(list(first))
            of = dict(zip(first, learned.tolist(), strict=True))
            numbers[new] = [of[p] for p in pieces]
            where = np.fromiter(first.values(), np.int64, len(first))
            fit = fits[where]
            self.short.put(low[where[fit]], high[where[fit]], learned[fit])
            self.long.update((p, k) for p, k in of.items() if len(p) > _Table.MOST)
        return numbers

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a byte column, and how many each row has."""
        if not self.by_pieces or b"<|" in data.tobytes():
            return self._whole(data, at)
        if self.n > REMEMBERED:
            self._forget()
        kind = np.append(_KIND[data], np.uint8(0))  # white space after the end
        word = kind > 0
        head = word.copy()
        head[1:] &= ~word[:-1] | ((kind[:-1] == 1) & (kind[1:] == 2))
        head[at] = word[at]
        begin = np.flatnonzero(head)
        size = np.flatnonzero(word[:-1] & (head[1:] | ~word[1:])) + 1 - begin
        number = self._numbers(np.append(_LOWER[data], np.zeros(16, np.uint8)), begin, size)
        first = self.ends[number]
        sizes = self.ends[number + 1] - first
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(first - stops[:-1], sizes) + np.arange(stops[-1])]
        return ids, np.diff(stops[np.searchsorted(begin, at)])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by ``end_id``."""
    out = np.insert(ids, np.cumsum(counts), end_id)
    return out, counts + 1


SHARDS = "part int, shard int, token_from long, doc_ids array<long>, counts array<long>, file binary"


def _writer(path: str, end_id: int, shard_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list = []
        counts: list[int] = []
        size, number, before = 0, 0, 0

        def shard() -> pa.RecordBatch:
            file = WaveletMatrix.build(np.concatenate(held)).to_bytes()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [c.split()[0] for c in SHARDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, number, before, ids, counts, file), kinds, strict=True)], names=names)

        for batch in (whole.slice(i, 50) for whole in batches for i in range(0, whole.num_rows, 50)):
            tokens, sizes = with_end(*encode(*text_bytes(batch.column(1))), end_id)
            held.append(tokens)
            ids += batch.column(0).to_pylist()
            counts += sizes.tolist()
            size += len(tokens)
            if size >= shard_tokens:
                yield shard()
                number, before = number + 1, before + size
                held, ids, counts, size = [], [], [], 0
        if counts:
            yield shard()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs`` and read their table back: one file a row, in the order of (part, shard)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", "digest", "row"]  # so rows without an id, or of one id, are split, too
    keyed = rows.withColumns({"digest": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    return materialize(ordered.mapInArrow(_writer(tokenizer_path, end_id, shard_tokens), SHARDS))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part, before, ids, counts, file = (c[i] for c in batch.columns)
            tokens = WaveletMatrix.from_bytes(file.as_buffer()).decode().astype("<u4")
            sizes = np.array(counts.as_py(), np.int64)
            stops = np.concatenate([[0], np.cumsum(sizes)])
            crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(stops[:-1], stops[1:], strict=True)]
            columns = [pa.array([part.as_py()] * len(sizes), pa.int32()), ids.values, pa.array(stops[:-1] + before.as_py()), pa.array(sizes), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "id", "place", "n_tokens", "ids_crc32"])


def read_tokens(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the shards' files."""
    spark = shards.sparkSession
    totals = shards.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before, starts = 0, []
    for row in sorted(totals.collect()):  # a number for each task that wrote
        starts.append((row.part, before))
        before += row.n
    offsets = spark.createDataFrame(starts, "part int, before long")
    read = shards.select("part", "token_from", "doc_ids", "counts", "file").mapInArrow(_reader, "part int, id long, place long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(offsets), "part").select(F.col("id").alias(id_col), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
