"""Phrase collocations by dynamic itemset counting.

Texts lie in a cycle of shards, scanned one a step, round and round. Words count from
the first step. A longer phrase is counted from the step after both its subphrases (all
words but the last, all but the first) have reached the threshold in what was counted so
far, in the same scans as the shorter ones, and for exactly one cycle, so that its count
is whole. The scans end when no phrase is left that has not had its cycle.

What has reached the threshold is known to the scans as a table of slots: the slot of a
phrase's hash holds the step in which it, or another phrase of that slot, first reached
it. A slot is set once and never changes, so each phrase has one starting step, and a
shared slot only makes phrases count that need not. The table has a fixed largest size.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtrail.llm.common import shuffle_parts
from backtrail.session import drop_scratch, scratch_path

#: What ends a piece of text: punctuation and U+000A to U+000D.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Slots of a table at most (one byte each); beyond, phrases share slots and more of them are counted.
MAX_SLOTS = 1 << 25
#: Slots for each phrase that reaches the threshold in the first step in which any does.
SLOTS_EACH = 32
#: Bytes of text that a task counts together.
BATCH_BYTES = 8 << 20
#: Parts of a language that are ranked apart before its best phrases meet.
PARTS = 32
#: Bytes of text for each bucket in which counts meet.
BUCKET_BYTES = 8 << 20

_NEVER = 255
_BLANKS = bytes.maketrans(SEPARATORS + b"\t", b"\n" * len(SEPARATORS) + b" ")
_COUNTS = "lang string, n int, start int, phrase string, f long"
_ARROW = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("start", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of phrases, of the hash of all words but the last and that of the last."""
    found = (left ^ (left >> np.uint64(29))) * _MIX + right
    return (found ^ (found >> np.uint64(32))) * _MIX


def _slots(hashes: np.ndarray, table_size: int) -> np.ndarray:
    return (hashes >> np.uint64(20)) & np.uint64(table_size - 1)


def count_texts(lang: str, texts: list[bytes], tables: list[np.ndarray], step: int, cycle: int,
                ) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(words, starting steps, phrases, counts, hashes) of the phrases that are counted in this step.

    Length 0 is all words together. ``tables`` holds the slots of words, pairs and so on.
    """
    book: dict[bytes, int] = defaultdict(itertools.count().__next__)
    book[b"\n"]  # a separator is 0
    flat = b"\n".join(texts).lower().translate(_BLANKS).replace(b"\n", b" \n ")
    ids = np.fromiter((book[w] for w in flat.split(b" ") if w), np.int64)
    words = list(book)
    if len(words) == 1:
        return
    names = pa.array(words, pa.binary())
    hashes = _word_hashes(lang, words)
    if step < cycle:
        counts = np.bincount(ids, minlength=len(words))[1:]
        yield 0, np.zeros(1, np.int32), pa.array([""]), counts.sum(keepdims=True), np.zeros(1, np.uint64)
        yield 1, np.zeros(len(counts), np.int32), names[1:].cast(pa.string()), counts, hashes[1:]
    own, within, phrase = hashes[ids], ids > 0, ids
    level = tables[0][_slots(own, len(tables[0]))]
    for n in range(2, len(tables) + 2):
        if len(ids) < n:
            return
        start = np.maximum(level[:-1], level[1:]).astype(np.int32) + 1
        within = within[:-1] & (ids[n - 1:] > 0)
        last = ids[n - 1:]
        counted = np.flatnonzero(within & (start <= step) & (step < start + cycle))
        following = _joined(own[:-1], hashes[last])
        if len(counted):
            _, first, counts = np.unique(phrase[:-1][counted] * len(words) + last[counted],
                                         return_index=True, return_counts=True)
            at = counted[first]
            parts = [names.take(pa.array(ids[at + k])) for k in range(n)]
            spelt = pa.compute.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
            yield n, start[at], spelt.cast(pa.string()), counts, following[at]
        if n <= len(tables):
            own = following
            level = tables[n - 1][_slots(own, len(tables[n - 1]))]
            phrase = phrase[:-1] * len(words) + last
            if len(words) ** (n + 1) >= 1 << 63:  # the words no longer fit side by side
                _, phrase = np.unique(phrase, return_inverse=True)


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _scan(shard: DataFrame, tables: list[np.ndarray], step: int, cycle: int, buckets: int) -> DataFrame:
    """Counts of one shard by ``bucket`` of the phrase, packed: a blob for each bucket that a task's texts meet."""
    shared = shard.sparkSession.sparkContext.broadcast(tables)

    def counted(by_lang: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        parts, own = [], []
        for lang, texts in by_lang.items():
            for n, start, phrase, f, hashes in count_texts(lang, texts, shared.value, step, cycle):
                size = len(f)
                parts.append(pa.table([
                    pa.array([lang] * size, pa.string()), pa.array(np.full(size, n, np.int32)), pa.array(start.astype(np.int32)),
                    phrase, pa.array(f.astype(np.int64))], schema=_ARROW))
                own.append((hashes % np.uint64(buckets)).astype(np.int64))
        if not parts:
            return
        bucket = np.concatenate(own)
        rank = np.argsort(bucket, kind="stable")
        bucket = bucket[rank]
        rows = pa.concat_tables(parts).combine_chunks().take(pa.array(rank))
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts[:-1]].astype(np.int32)),
             pa.array([_blob(rows.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["bucket", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[lang].append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield from counted(held)
                    held.clear()
                    size = 0
        yield from counted(held)

    return shard.select("lang", "text").mapInArrow(scan, "bucket int, counts binary")


def _summed(packed: DataFrame, step: int, cycle: int, threshold: int) -> DataFrame:
    """The counts of all blobs of a bucket together.

    Rows: what has had its cycle and is frequent (``whole``), and what is frequent but
    still open. One row for each bucket has in ``counts`` all that is still open.
    """

    def sum_up(found: pa.Table) -> pa.Table:
        tables = [_table(b) for b in found.column("counts").to_pylist()]
        summed = pa.concat_tables(tables).group_by(["lang", "n", "start", "phrase"]).aggregate([("f", "sum")])
        summed = summed.select(["lang", "n", "start", "phrase", "f_sum"]).rename_columns(_ARROW.names)
        whole = pa.compute.less_equal(pa.compute.add(summed["start"], cycle - 1), step)
        often = pa.compute.or_(pa.compute.greater_equal(summed["f"], threshold), pa.compute.equal(summed["n"], 0))
        rows, ended = summed.filter(often), whole.filter(often)
        left = summed.filter(pa.compute.invert(whole))
        blobs = [None] * rows.num_rows
        if left.num_rows:
            rows = pa.concat_tables([rows, pa.table([[None]] * 5, schema=_ARROW)])
            ended = pa.chunked_array([*ended.chunks, pa.array([False])])
            blobs.append(_blob(left.cast(_ARROW)))
        key = pa.array([found.column("bucket")[0].as_py()] * rows.num_rows, pa.int32())
        return pa.table([*rows.columns, ended, key, pa.array(blobs, pa.binary())], names=[*_ARROW.names, "whole", "bucket", "counts"])

    return packed.groupBy("bucket").applyInArrow(sum_up, f"{_COUNTS}, whole boolean, bucket int, counts binary")


def _taken(reached: DataFrame, n: int, table_size: int) -> np.ndarray:
    """Slots of the phrases, brought here as bitmaps: ``table_size`` / 8 bytes at most."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelt = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            found = np.zeros(len(spelt), np.uint64)
            by_lang: dict[str, list[int]] = defaultdict(list)
            for row, lang in enumerate(batch.column(0).to_pylist()):
                by_lang[lang].append(row)
            for lang, rows in by_lang.items():
                own = _word_hashes(lang, [spelt[r][0] for r in rows])
                for k in range(1, n):
                    own = _joined(own, _word_hashes(lang, [spelt[r][k] for r in rows]))
                found[rows] = own
            yield pa.RecordBatch.from_arrays([pa.array(_slots(found, table_size).astype(np.int64) + 1)], names=["slot"])

    maps = reached.select("lang", "phrase").mapInArrow(slots, "slot long").groupBy(
        F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    taken = np.zeros(table_size, bool)
    for bucket, bits in maps.toLocalIterator():
        own = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        room = taken[(bucket - 1) * len(own):bucket * len(own)]
        room |= own[:len(room)]
    return taken


def _written(rows: DataFrame, path: str, schema: str, *by: str) -> DataFrame:
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def phrase_counts(docs: DataFrame, threshold: int = 10, longest: int = 3, cycle: int = 3, lang_col: str = "lang",
                  text_col: str = "text") -> DataFrame:
    """``lang``, ``n``, ``phrase`` and ``f``, the exact count, of what occurs ``threshold`` times in its language.

    A-Z are lower-cased; texts are cut at punctuation and U+000A to U+000D into pieces,
    and these at spaces and tabs into words. ``n`` is the number of words, 1 to
    ``longest``; the row of length 0 of a language has the number of its words. A null
    text counts as empty, a null language as ``und``; repeated rows count each time, an
    empty table has no rows. Only the two columns are read.
    """
    spark = docs.sparkSession
    home = scratch_path(spark, "phrases")
    dealt = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
                        F.pmod(F.monotonically_increasing_id(), F.lit(cycle)).cast("int").alias("shard"))
    shards = _written(dealt, f"{home}/shards", "lang string, text binary, shard int", "shard")
    size = shards.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_parts(spark), size // BUCKET_BYTES)
    tables = [np.full(1 << 10, _NEVER, np.uint8) for _ in range(longest - 1)]
    changed = [-1] * len(tables)
    open_counts: DataFrame | None = None
    schema = _COUNTS + ", bucket int, counts binary, whole boolean"
    step = 0
    while step < cycle or step <= max(changed, default=-1) + cycle:
        packed = _scan(shards.where(F.col("shard") == step % cycle), tables, step, cycle, buckets)
        packed = packed if open_counts is None else packed.unionByName(open_counts)
        counts = _written(_summed(packed, step, cycle, threshold), f"{home}/counts/step={step}", schema, "whole")
        often = counts.where((F.col("f") >= threshold) & F.col("n").between(1, longest - 1))
        reached = {r["n"]: r["size"] for r in often.groupBy("n").agg(F.count(F.lit(1)).alias("size")).collect()}  # a row for each length
        for n, size in reached.items():
            table = tables[n - 1]
            if changed[n - 1] < 0:
                table = tables[n - 1] = np.full(min(MAX_SLOTS, 1 << (SLOTS_EACH * size).bit_length()), _NEVER, np.uint8)
            new = _taken(often.where(F.col("n") == n), n, len(table)) & (table == _NEVER)
            if new.any():
                table[new] = step
                changed[n - 1] = step
        if step:
            drop_scratch(spark, f"{home}/counts/step={step - 1}/whole=false")
        open_counts = counts.where(F.col("counts").isNotNull()).select("bucket", "counts")
        step += 1
    drop_scratch(spark, f"{home}/shards")
    found = spark.read.schema(schema + ", step int").parquet(f"{home}/counts")
    return found.where("whole").select("lang", "n", "phrase", "f")


def _cut_score() -> Column:
    """floor(1000000 * a * a / (l * r)) in whole decimals; exact while a is under 10^16."""
    return F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(18,0)) * cast(a as decimal(18,0)) "
                  "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))").cast("long")


def collocations(counts: DataFrame, covered: int = 50, best: int = 2000) -> DataFrame:
    """The first ``best`` phrases of every language, by the lowest score of their cuts.

    ``counts`` are those of ``phrase_counts``. A phrase is dropped if a longer one that
    holds its words in a row has at least ``covered`` percent of its count. Order: score,
    then count, both falling, then the phrase by its bytes. Returns ``lang``, ``rank``
    (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the language), ``score``.
    """
    totals = counts.where("n = 0").select("lang", F.col("f").alias("total"))
    phrases = counts.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.size("w")
    longer = phrases.where(size > 2).select(
        "lang", F.col("a").alias("over"),
        F.explode(F.expr("array_distinct(flatten(transform(sequence(2, size(w) - 1), "
                         "n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')))))")).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = phrases.join(most, ["lang", "phrase"], "left").where(
        100 * F.coalesce("over", F.lit(0)) < covered * F.col("a"))
    cuts = left.select("lang", "phrase", "a", F.explode(F.expr(
        "transform(sequence(1, size(w) - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS front, "
        "array_join(slice(w, k + 1, size(w)), ' ') AS back))")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    fronts = counts.where("n >= 1").select("lang", F.col("phrase").alias("front"), F.col("f").alias("l"))
    backs = counts.where("n >= 1").select("lang", F.col("phrase").alias("back"), F.col("f").alias("r"))
    scored = cuts.join(fronts, ["lang", "front"]).join(backs, ["lang", "back"]).withColumn("score", _cut_score())
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("low"))
    order = (F.desc("low.score"), F.desc("low.a"), "phrase")
    # the best of each part of a language first, so that few rows of it meet
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    near = lowest.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "low.a", "low.l", "low.r",
        F.col("total").alias("n"), "low.score")
