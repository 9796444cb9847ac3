"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts gives each document the size and a 128-bit digest of its set of shingles, the keys
   of its bands, and a signature that keeps the two low bits of each minimum, packed in words of 64 bits.
2. Documents with equal sets form a class; only the least id of a class goes on, so thousands of copies cost
   one row from here. Grouping by digest combines map-side.
3. Band keys that two classes or more share give candidates. Each member is paired with a few centres of its
   bucket, not with every other member: those that come first in orders of all ids, the same in each bucket.
4. Candidates must fit in size and pass the similarity that bit counts of the signatures estimate, corrected for
   chance collisions of two bits (the bound lies 4.5 standard deviations below the threshold: 3e-6).
5. What is left is confirmed on the full sets, in whole numbers, and linked classes become components.
6. Members of a bucket that are in different components by then are told apart by what each differs in from one centre
   of the bucket (see ``rivals``): exact links come out of it, whatever the choice of centres, and no list of all pairs.

With 32 bands of five rows a pair at the threshold of 0.8 is missed with probability 3e-6.

Null and empty texts and texts of white space have an empty set and are linked with nothing. A text of fewer
words than a shingle has its whole sequence as one. Rows without an id are returned with a null component and
kept. Repeated rows share their id's component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, distinct_by_row, materialize, minima, mix64, seeds, shingle_hashes, short_batches, text_bytes
from .components import components

BANDS, ROWS = 32, 5
#: Minima of the signature (those of the bands among them), and 64-bit words of one plane of it.
MINIMA = 512
PLANE = MINIMA // 64
#: Centres of a bucket.
CENTRES = 4
#: Times that the holders of a member in which they differ from a centre meet one of them, before the rest meet one another.
HEADS = 2
#: Words of 64 bits that tell how many members of a set fall on each bit an odd number of times.
PARITY = 4
_PARITY = [f"p{k}" for k in range(PARITY)]
#: Ids broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Standard deviations that the estimate may lie below the threshold.
SIGMAS = 4.5


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*text_bytes(column))
    return distinct_by_row(*shingle_hashes(words.hashes, words.rows, size))


def _digest(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, by two sums of mixed members."""
    out = []
    for salt in (3, 5):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix64(values * seeds(1, salt)[0] + np.uint64(salt)), out=sums[1:])
        out.append(mix64(sums[rows[1:]] - sums[rows[:-1]]))
    return out[0], out[1]


def _slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _sketcher(size: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = seeds(MINIMA, 7)
        turn = seeds(ROWS, 13)
        salt = seeds(BANDS, 17)
        for batch in (part for whole in batches for part in _slices(whole)):
            values, rows = _sets(batch.column(1), size)
            least = minima(values, rows, multipliers)
            banded = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS)
            keys = salt + np.zeros((len(least), BANDS), np.uint64)
            for r in range(ROWS):
                keys += mix64(banded[:, :, r]) * turn[r]
            keys = mix64(keys)
            mixed = mix64(least)
            planes = []
            for bit in (0, 1):
                bits = ((mixed >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
                planes.append(np.packbits(bits, axis=1).view(np.int64).reshape(len(least), PLANE))
            low, high = _digest(values, rows)
            columns = [batch.column(0), pa.array(np.diff(rows).astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))]
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())))
            columns += [pa.array(np.ascontiguousarray(p[:, k])) for p in planes for k in range(PLANE)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "low", "high", "bands", *_signature()])

    return sketch


def _signature() -> list[str]:
    return [f"s{bit}{k}" for bit in (0, 1) for k in range(PLANE)]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n, low, high, bands and the words of the signature of every row."""
    short_batches(docs.sparkSession)
    schema = "id long, n long, low long, high long, bands array<long>, " + ", ".join(f"{c} long" for c in _signature())
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketcher(size), schema)


def _set_table(docs: DataFrame, size: int) -> DataFrame:
    """(id, members): the sorted hashes of each document's set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            values, rows = _sets(batch.column(1), size)
            blobs = [values[rows[i] : rows[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "members"])

    return docs.mapInArrow(run, "id long, members binary")


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, members) of the documents whose ``id`` is in ``ids``. ``docs``: (id, text), one row an id."""
    ids = materialize(ids.select("id").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return materialize(_set_table(docs.join(ids, "id", "left_semi"), size))


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) that sizes and bit counts allow."""
    facts = ["n", *_signature()]
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in facts]), side)
    total = MINIMA
    differ = sum(
        F.bit_count(F.col(f"a_s0{k}").bitwiseXOR(F.col(f"b_s0{k}")).bitwiseOR(F.col(f"a_s1{k}").bitwiseXOR(F.col(f"b_s1{k}")))) for k in range(PLANE)
    )
    threshold = percent / 100
    agree = 0.25 + 0.75 * threshold
    spread = (agree * (1 - agree) / total) ** 0.5
    similar = ((1 - differ / total) - 0.25) / 0.75
    return pairs.where(
        (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (similar >= threshold - SIGMAS * spread / 0.75)
    ).select("a", "b")


def with_members(pairs: DataFrame, members: DataFrame, sides: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``pairs`` with the sets of both sides; ``members``: (id, members)."""
    for side in sides:
        pairs = pairs.join(members.select(F.col("id").alias(side), F.col("members").alias(f"members_{side}")), side)
    return pairs


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough."""
    return with_members(pairs, members).select("a", "b", "members_a", "members_b").mapInArrow(_confirm(percent), "a long, b long")


def stars(placed: DataFrame) -> DataFrame:
    """(a, b): members of a bucket and its centres. ``placed``: (key, id)."""
    first = [F.min(F.struct((F.xxhash64("id", F.lit(k)) if k else F.col("id")).alias("order"), "id")).alias(f"c{k}") for k in range(CENTRES)]
    centres = placed.groupBy("key").agg(*first).select("key", F.array_distinct(F.array(*[F.col(f"c{k}.id") for k in range(CENTRES)])).alias("centres"))
    met = placed.join(centres, "key").select("id", F.explode("centres").alias("c")).where("id <> c")
    return met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _deltas(percent: int) -> Callable:
    """(id, c, root, home, n, d, base, near, delta): the members of a set that its centre's hasn't, and the other way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, deltas, parity = [], [], []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                deltas.append(np.setxor1d(x, y, assume_unique=True))
                sizes.append((len(x), len(deltas[-1]), len(y)))
                parity.append(np.bincount((mix64(x) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1)
            n, d, base = np.array(sizes, np.int64).reshape(-1, 3).T.copy()
            near = (100 + percent) * d <= (100 - percent) * (n + base)
            offsets = pa.array(np.append(0, np.cumsum(d)).astype(np.int32))
            flat = np.concatenate(deltas).view(np.int64) if deltas else np.zeros(0, np.int64)
            planes = np.packbits(np.array(parity, np.uint8).reshape(-1, 64 * PARITY), axis=1).view(np.int64).T.copy()
            columns = [*batch.columns[:4], *map(pa.array, (n, d, base, near)), pa.ListArray.from_arrays(offsets, pa.array(flat)), *map(pa.array, planes)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "c", "root", "home", "n", "d", "base", "near", "delta", *_PARITY])

    return run


def rivals(placed: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) of similar members of one bucket that are in different components, or links that join them.

    ``placed``: (key, id, root); ``sets``: a function from ids to (id, members).

    A bucket's centre c is the least member of its largest component. With D(x) the members that x or c has, but not
    both, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| members. Two that are similar to c are linked by it. Of any
    other pair one, x, isn't similar to c, and then sizes alone tell how many members D(x) and D(y) must share at least.
    So they share one of the rarest of D(y), as many as D(y) may lack and one more, and one of the rarest of D(x); and
    from the place of the first shared one in the common order, rarest first, so many must still be left in both. Every bit
    of the sets' parity that differs needs a member that only one side has.
    Members that c and its variants have in common are in no D, and what one variant has of its own is shared by none: pairs that
    meet are few even where a bucket is large and its members are nearly similar enough. No link is lost.

    Two components may be joined by many links, one of which will do. So those that share a member of D first meet one of
    them only, a few times over, and all others only where they are in different components still.
    """
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("c"))
    centres = materialize(parts.groupBy("key").agg(F.max_by(F.struct("c", F.col("root").alias("home")), F.struct("n", -F.col("c"))).alias("at"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "at.*"))
    pairs = materialize(placed.join(centres, "key").where("id <> c").select("id", "c", "root", "home").distinct())
    members = sets(pairs.select("id").unionByName(pairs.select(F.col("c").alias("id"))))
    given = with_members(pairs.withColumn("a", F.col("id")).withColumn("b", F.col("c")), members).select("id", "c", "root", "home", "members_a", "members_b")
    deltas = materialize(given.mapInArrow(_deltas(percent), "id long, c long, root long, home long, n long, d long, base long, near boolean, delta array<long>, " + ", ".join(f"{p} long" for p in _PARITY)))
    links = deltas.where("near AND root <> home").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))

    elements = deltas.select("c", "id", F.explode("delta").alias("e"))
    common = elements.groupBy("c", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    order = Window.partitionBy("c", "id").orderBy("f", "e")
    rank, shared = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy("c", "id"))
    less, more = 100 - percent, 100 + percent
    least = F.greatest(F.lit(1), F.ceil((less * F.col("base") + more * F.col("d") - less * F.col("n")) / (2 * more)))
    lacking = F.floor(less * F.col("n") / percent)
    ranked = elements.join(common, ["c", "e"]).withColumns({"rank": rank, "shared": shared}).join(deltas.drop("delta"), ["c", "id"])
    ranked = ranked.withColumn("at", F.col("d") - F.col("shared") + F.col("rank"))
    indexed = F.col("at") <= F.least("within", F.col("d") - least + 1)
    ranked = materialize(ranked.withColumn("within", F.least(lacking + 1, F.col("d"))).where("at <= within").select("c", "e", "id", "root", "n", "d", "at", "near", *_PARITY, indexed.alias("indexed")))
    sized = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    left = 1 + F.least(F.col("x_d") - F.col("x_at"), F.col("y_d") - F.col("y_at"))
    enough = 2 * more * left >= more * (F.col("x_d") + F.col("y_d")) - less * (F.col("x_n") + F.col("y_n"))
    differ = sum(F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in _PARITY)
    similar = (F.col("x_root") != F.col("y_root")) & sized & enough & (more * differ <= less * (F.col("x_n") + F.col("y_n")))
    facts = ["id", "root", "n", "d", "at", "near", *_PARITY]
    side = lambda s: ["c", "e", *[F.col(k).alias(f"{s}_{k}") for k in facts]]

    def linked(probe: DataFrame, index: DataFrame, once: Column) -> DataFrame:
        met = probe.join(index, ["c", "e"]).where(similar & once)
        met = materialize(met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct())
        return materialize(confirmed(met, members, percent))

    own, now = materialize(placed.select("id", "root").distinct()), ranked
    for k in range(HEADS):
        heads = now.where("indexed").groupBy("c", "e").agg(F.min_by(F.struct(*facts), F.xxhash64("root", "id", F.lit(k))).alias("y"))
        links = links.unionByName(linked(now.where("NOT near").select(*side("x")), heads.select("c", "e", *[F.col(f"y.{f}").alias(f"y_{f}") for f in facts]), F.lit(True)))
        ends = links
        for end in ("a", "b"):
            ends = ends.join(own.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end)
        moved = materialize(components(ends, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("moved")))
        now = ranked.join(moved, "root", "left").withColumn("root", F.coalesce("moved", "root")).drop("moved")
    probe, index = now.where("NOT near").select(*side("x")), now.where("indexed").select(*side("y"))
    return links.unionByName(linked(probe, index, F.col("y_near") | (F.col("x_id") < F.col("y_id"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (see the module)."""
    table = materialize(sketches(docs, id_col, text_col, size))
    linked = table.where("n > 0 AND id IS NOT NULL")
    keys = ["low", "high", "n"]
    members = linked.groupBy(*keys).agg(F.min("id").alias("class_id"))
    of_class = materialize(linked.select("id", *keys).join(members, keys).select("id", "class_id").distinct())
    heads = of_class.where("id = class_id").select("id").distinct()
    classes = materialize(linked.join(heads, "id", "left_semi").dropDuplicates(["id"]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")

    entries = classes.select("id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key")
    crowded = materialize(entries.join(shared, "key"))
    sets = lambda ids: sets_of(ids, texts, size)
    met = materialize(_plausible(stars(crowded), classes, percent))
    found = materialize(confirmed(met, sets(met.select(F.explode(F.array("a", "b")).alias("id"))), percent))
    root = components(found).withColumnRenamed("node", "id")
    placed = materialize(crowded.join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    root = materialize(components(found.unionByName(rivals(placed, sets, percent))).withColumnRenamed("node", "id"))

    final = of_class.join(root.withColumnRenamed("id", "class_id"), "class_id", "left").groupBy("id").agg(F.min(F.coalesce("root", "class_id")).alias("root"))
    out = table.select("id", "n").join(final, "id", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("root"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one per component stays, the least id; columns unchanged.

    Rows without an id stay, and so do rows that share an id with another: their id doesn't tell which text it names.
    """
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, size, percent)
    gone = groups.groupBy(F.col(id_col).alias("__gone")).agg(F.count(F.lit(1)).alias("n"), F.every("kept").alias("kept")).where("n = 1 AND NOT kept").select("__gone")
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
