"""Document scores by cross-entropy difference of two n-gram models with one vocabulary.

Both models are bigram models over the ids of a public tokenizer: the target from the documents that the labels call
good, the background from all documents. They share vocabulary, order and smoothing:

    p(w)     = (c(w) + 1) / (N + V)
    p(w | v) = (c(v, w) + MASS p(w)) / (c(v) + MASS)

A document's score is the mean over its tokens (the first after the end mark) of log2 p_background - log2 p_target:
cross-entropy under the target less that under the background. Low scores are like the target.

Texts are dealt to blocks of about ``BLOCK_CHARS`` characters by a hash of their id, once, together with the labels of
their block, and encoded there. From then on blocks stay where they are, in a table bucketed by block:

* each block's distinct bigrams with their counts are summed over all blocks;
* each block gets back the sums of its own bigrams, and no others, and scores its documents.

So no model of unbounded size is broadcast, whatever the number of distinct bigrams; only unigram counts are, two
numbers for each id of the vocabulary. Null and empty texts have no tokens and a null score. Rows without an id
are scored; they have no label. Repeated rows are counted and scored each. With no label of the target, its model is
uniform. Labels of one document that differ count as good if any does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_folder, short_batches, text_bytes
from .tokens import encoder

BLOCK_CHARS = 8_000_000
MASS = 64.0
#: Buckets of the blocks' table at most (80 GB of text with a block in each; beyond that blocks share buckets).
MOST_BUCKETS = 10_000
VOCABULARY = 49_408
#: The mark before a text's first token.
MARK = VOCABULARY - 1
RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _encode(path: str) -> Callable:
    def run(docs: pa.Table, labels: pa.Table) -> pa.Table:
        encode = encoder(path)
        good = set(labels.column("id").to_pylist())
        ids = docs.column("id").to_pylist()
        pieces, counts = [], []
        for batch in docs.select(["text"]).to_batches(200):
            tokens, sizes = encode(*text_bytes(batch.column(0)))
            pieces.append(tokens.astype(np.uint16))
            counts += sizes.tolist()
        row = {
            "block": [docs.column("block")[0].as_py() if len(docs) else -1],
            "ids": [ids],
            "good": [[i is not None and i in good for i in ids]],
            "counts": [counts],
            "tokens": [np.concatenate(pieces).tobytes() if pieces else b""],
        }
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        table = pa.table({k: pa.array(v, kind) for (k, v), kind in zip(row.items(), kinds, strict=True)})
        return table if len(docs) else table.slice(0, 0)

    return run


def _pairs(counts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Each token with the one before it as one number; the mark stands before a text's first."""
    before = np.concatenate([[MARK], tokens[:-1]]).astype(np.uint32) if len(tokens) else tokens.astype(np.uint32)
    starts = np.cumsum(counts)[:-1]
    starts = np.concatenate([[0], starts])[counts > 0]
    if len(starts):
        before[starts] = MARK
    return before * np.uint32(VOCABULARY) + tokens


def _row(batch: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    get = lambda name: batch.column(batch.schema.get_field_index(name))[i]
    counts = np.array(get("counts").as_py(), np.int64)
    tokens = np.frombuffer(get("tokens").as_buffer(), np.uint16)
    return counts, np.repeat(np.array(get("good").as_py(), bool), counts), tokens, get("ids").as_py()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            counts, good, tokens, _ = _row(batch, i)
            pairs = _pairs(counts, tokens)
            number, place = np.unique(pairs, return_inverse=True)
            total = np.bincount(place, minlength=len(number))
            target = np.bincount(place, weights=good, minlength=len(number)).astype(np.int64)
            block = batch.column(batch.schema.get_field_index("block"))[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(number), block)), pa.array(number.astype(np.int64)), pa.array(total), pa.array(target)], names=["block", "pair", "background", "target"]
            )


def _scorer(unigrams: np.ndarray, contexts: np.ndarray) -> Callable:
    single = (unigrams + 1) / (unigrams.sum(axis=1, keepdims=True) + VOCABULARY)

    def run(blocks: pa.Table, sums: pa.Table) -> pa.Table:
        sums = sums.combine_chunks()
        pair = sums.column("pair").to_numpy()
        order = np.argsort(pair)
        pair = pair[order]
        bits = np.zeros((2, len(pair)))
        for m, name in enumerate(("background", "target")):
            count = sums.column(name).to_numpy()[order]
            before, word = np.divmod(pair, VOCABULARY)
            bits[m] = -np.log2((count + MASS * single[m, word]) / (contexts[m, before] + MASS))
        out: list[tuple] = []
        for i in range(blocks.num_rows):
            counts, _, tokens, ids = _row(blocks, i)
            stops = np.concatenate([[0], np.cumsum(counts)])
            low = 0
            while low < len(ids):  # a part of the documents at a time bounds the memory
                high = max(low + 1, int(np.searchsorted(stops, stops[low] + 1_000_000, "right")) - 1)
                own = tokens[stops[low] : stops[high]]
                place = np.searchsorted(pair, _pairs(counts[low:high], own).astype(np.int64))
                losses = [np.concatenate([[0], np.cumsum(bits[m, place])])[stops[low : high + 1] - stops[low]] for m in (0, 1)]
                for k in range(low, high):
                    n = int(counts[k])
                    b, t = (float(x[k - low + 1] - x[k - low]) / n if n else None for x in losses)
                    out.append((ids[k], n, t, b, t - b if n else None))
                low = high
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


def score(docs: DataFrame, labels: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: id, n_tokens, losses under both models in bits a token, and their difference."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars, n_rows = rows.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    dealt = lambda salt: F.pmod(F.xxhash64(F.col("id"), salt), F.lit(n_blocks))
    # rows without an id are dealt by their text; all others by their id alone, as labels are
    rows = rows.withColumn("block", F.when(F.col("id").isNull(), dealt(F.xxhash64("text"))).otherwise(dealt(F.lit(0))))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    good = good.withColumn("block", dealt(F.lit(0)))
    encoded = rows.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(
        _encode(tokenizer_path), "block long, ids array<long>, good array<boolean>, counts array<long>, tokens binary"
    )
    name = f"casetide_blocks_{uuid.uuid4().hex}"
    buckets = min(n_blocks, MOST_BUCKETS)
    encoded.repartition(buckets, "block").write.option("path", shared_folder(spark)).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)

    own = materialize(blocks.mapInArrow(_counted, "block long, pair long, background long, target long"))
    sums = materialize(own.groupBy("pair").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    unigrams, contexts = np.zeros((2, VOCABULARY)), np.zeros((2, VOCABULARY))
    word, before = F.pmod("pair", F.lit(VOCABULARY)), F.floor(F.col("pair") / VOCABULARY)
    for into, key in ((unigrams, word), (contexts, before)):  # a row for each id of the vocabulary at most
        table = sums.groupBy(key.alias("k")).agg(F.sum("background").alias("b"), F.sum("target").alias("t")).toPandas()
        into[0, table["k"]], into[1, table["k"]] = table["b"], table["t"]
    back = own.select("block", "pair").join(sums, "pair")
    scored = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scorer(unigrams, contexts), RESULT)
    return scored.withColumnRenamed("doc_id", id_col)
