"""Near-duplicates by SimHash: a binary trie of fingerprints joined with itself.

The join walks pairs of trie nodes of the same depth, adds up the bits in which their
prefixes differ and drops a pair whose sum is over the budget. To deal the work out,
each fingerprint enters one trie per block of bits: two fingerprints that differ in
at most ``budget`` bits are equal in one of ``budget + 1`` blocks, so the trie of that
block, which spells it first, has them under one node. A pair that was equal in an
earlier block is dropped there, hence every pair is met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import hot_keys
from backtrail.session import cut_lineage

BITS = 64
#: Node pairs that are walked at once; more wait their turn.
_WAVE = 1 << 18


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of ``words`` words.

    A-Z are lower-cased, words stand between space and U+0009 to U+000D, a shorter
    text is one shingle, one without words has fingerprint 0. A bit is set if it is
    set in over half the XXH64 (with ``seed``) of the shingles. Shingles that come
    again count again.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    starts, at = [], 0
    for word in found:
        starts.append(at)
        at += len(word) + 1
    shingles = (line[a:b - 1] for a, b in zip(starts, [*starts[words:], at]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in shingles], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):
        block = hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """Of every row ``id``, ``text_hash`` and ``fp`` (a signed long)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "text_hash", "fp"])

    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                         F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(mark, f"id {id_type}, text_hash long, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``budget + 1`` blocks that cover all bits."""
    edges = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class _Forest:
    """Which values of one trie are connected so far; the root of a component is its lowest place."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.fresh = False

    def flatten(self) -> np.ndarray:
        while self.fresh:
            lifted = self.up[self.up]
            self.fresh = not np.array_equal(lifted, self.up)
            self.up = lifted
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.flatten()
            a, b = up[a], up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
                self.fresh = True


def trie_links(values: np.ndarray, runs: list[tuple[int, int, bool]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected by steps of at most ``budget`` bits.

    ``values`` are different uint64. ``runs`` lists (lowest bit, width, must differ)
    from the root down; pairs agree on the first run, and a pair that agrees on a
    later run which must differ is dropped. A node is a range of the sorted values.
    Node pairs go down bit by bit, depth first in waves of bounded size; two single
    values are compared at once. A pair of nodes within one component adds nothing and
    is dropped. Returns each value that is not the root of its component, and the root.
    """
    n = len(values)
    key = np.zeros(n, dtype=np.uint64)
    for low, width, _ in runs:
        key = (key << np.uint64(width)) | ((values >> np.uint64(low)) & np.uint64((1 << width) - 1))
    rank = np.argsort(key, kind="stable")
    key = key[rank]
    bits = sum(width for _, width, _ in runs)
    must, at = {}, 0  # depth at which a run that must differ ends -> mask of its bits in the key
    for k, (_, width, differ) in enumerate(runs):
        at += width
        if differ and k:
            must[at] = np.uint64(((1 << width) - 1) << (bits - at))
    forest = _Forest(n)
    one = np.uint64(1)
    depth = runs[0][1]
    top = key >> np.uint64(bits - depth)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if n else np.array([], dtype=np.int64)
    stops = np.r_[starts[1:], n] if n else starts
    many = stops - starts > 1
    waves = [(depth, *(x[many] for x in (starts, stops, starts, stops)), np.zeros(many.sum(), dtype=np.int64))]
    while waves:
        depth, a0, a1, b0, b1, err = waves.pop()
        if len(a0) > 4096:
            up = forest.flatten()
            piece = np.r_[0, np.cumsum(up[1:] != up[:-1])]
            inside = (up[a0] == up[b0]) & (piece[a0] == piece[a1 - 1]) & (piece[b0] == piece[b1 - 1])
            a0, a1, b0, b1, err = (x[~inside] for x in (a0, a1, b0, b1, err))
        if len(a0) > _WAVE:
            half = len(a0) // 2
            waves.append((depth, *(x[half:] for x in (a0, a1, b0, b1, err))))
            waves.append((depth, *(x[:half] for x in (a0, a1, b0, b1, err))))
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            a, b = a0[single], b0[single]
            differ = key[a] ^ key[b]
            near = np.bitwise_count(differ) <= budget
            for mask in must.values():
                near &= (differ & mask) != 0
            forest.link(a[near], b[near])
            a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        bit = np.uint64(bits - 1 - depth)
        split_a = np.searchsorted(key, ((key[a0] >> bit) | one) << bit)
        split_b = np.searchsorted(key, ((key[b0] >> bit) | one) << bit)
        split_a, split_b = np.clip(split_a, a0, a1), np.clip(split_b, b0, b1)
        twin = a0 == b0
        parts = []
        for x0, x1, y0, y1, cost, wanted in (
                (a0, split_a, b0, split_b, 0, True), (split_a, a1, split_b, b1, 0, True),
                (a0, split_a, split_b, b1, 1, True), (split_a, a1, b0, split_b, 1, ~twin)):
            keep = wanted & (x1 > x0) & (y1 > y0) & (err + cost <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            if depth + 1 in must:
                keep &= ((key[np.minimum(x0, n - 1)] ^ key[np.minimum(y0, n - 1)]) & must[depth + 1]) != 0
            if keep.any():
                parts.append((x0[keep], x1[keep], y0[keep], y1[keep], err[keep] + cost))
        if parts:
            waves.append((depth + 1, *(np.concatenate(c) for c in zip(*parts))))
    up = forest.flatten()
    joined = np.flatnonzero(up != np.arange(n))
    own = values[rank]
    return own[joined], own[up[joined]]


def _runs(trie: int, budget: int) -> list[tuple[int, int, bool]]:
    """The own block first, then the earlier ones, which must differ, then the later ones."""
    cut = blocks(budget)
    return [(*cut[trie], False), *((*b, True) for b in cut[:trie]), *((*b, False) for b in cut[trie + 1:])]


def links(values: DataFrame, budget: int = 3, chunk: int = 1 << 20) -> DataFrame:
    """Links (``a``, ``b``) that connect the different longs ``fp`` at most ``budget`` bits apart.

    Each value goes to ``budget + 1`` tries, dealt by its bits in the block of the trie.
    A task walks the sub-tries that it got, about ``chunk`` values at a time.
    """
    cut = blocks(budget)
    tries = F.explode(F.array(*[
        F.struct(F.lit(k).alias("trie"),
                 F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).alias("block"))
        for k, (low, width) in enumerate(cut)])).alias("t")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def joined(trie: np.ndarray, _: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in np.unique(trie).tolist():
                a, b = trie_links(fp[trie == k].view(np.uint64), _runs(k, budget), budget)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            size += batch.num_rows
            if size > chunk:  # all but the last sub-trie, of which more may come
                whole = [np.concatenate(c) for c in zip(*held)]
                last = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])
                yield from joined(*(c[~last] for c in whole))
                held, size = [tuple(c[last] for c in whole)], 0
        if held:
            yield from joined(*(np.concatenate(c) for c in zip(*held)))

    dealt = values.select("fp").distinct().select("fp", tries).select("t.trie", "t.block", "fp")
    return dealt.repartition("trie", "block").sortWithinPartitions("trie", "block").mapInArrow(walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the lowest node that can be reached) for every node of the links a-b.

    Each round every node takes the lowest root that it and its neighbours have, and
    then the root of that root; what is left of a path is about halved. Rounds are
    written to the shared checkpoint folder, so that a lost executor costs one.
    """
    apart = edges.where("a <> b")
    both = cut_lineage(apart.select("a", "b").union(apart.select("b", "a")).distinct())
    roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        heard = both.join(roots, both["b"] == roots["node"]).select(both["a"].alias("node"), "root", F.lit(None).alias("own"))
        told = roots.select("node", "root", F.col("root").alias("own")).unionByName(heard)
        lowest = told.groupBy("node").agg(F.min("root").alias("next"), F.min("own").alias("root"))
        above = roots.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        found = F.least("next", "beyond")
        step = cut_lineage(lowest.join(above, "next").select("node", found.alias("root"), (F.col("root") != found).alias("moved")))
        roots = step.select("node", "root")
        if step.where("moved").isEmpty():
            return roots


def near_duplicates(docs: DataFrame, budget: int = 3, words: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Fingerprint and class of every document.

    Documents link if their fingerprints differ in at most ``budget`` bits. A null text
    counts as empty: fingerprint 0, linked like any other. Returns one row per row of
    ``docs``: the id, ``text_hash``, ``fp``, ``component_id`` (the lowest id that can be
    reached; a null id only where there is no other) and ``stays``, true for the first
    of the component by id and then text hash, and for rows that repeat it.

    Equal fingerprints are one node from the start, so a large group of copies costs
    one row; when the classes are joined back, such groups go apart from the rest.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, words))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    lowest = cut_lineage(marked.groupBy("fp").agg(F.min(first).alias("low")))
    found = components(links(lowest, budget)).withColumnRenamed("node", "fp")
    named = cut_lineage(lowest.join(found, "fp", "left"))
    linked, alone = named.where("root IS NOT NULL"), named.where("root IS NULL")
    of_root = linked.groupBy("root").agg(F.min("low").alias("first"))
    classes = linked.join(of_root, "root").select("fp", "first").unionByName(
        alone.select("fp", F.col("low").alias("first")))
    hot = [k for (k,) in hot_keys(marked, ["fp"])]  # fewer than 500
    of_hot = F.broadcast(classes.where(F.col("fp").isin(hot)))
    told = marked.where(F.col("fp").isin(hot)).join(of_hot, "fp").unionByName(
        marked.where(~F.col("fp").isin(hot)).join(classes, "fp"))
    return told.select(
        F.col("id").alias(id_col), "text_hash", "fp", F.col("first.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"))


def keep_first(docs: DataFrame, budget: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns they came with: one row of each component."""
    found = near_duplicates(docs.select(id_col, text_col), budget, words, id_col, text_col)
    stay = found.where("stays").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own = docs.withColumn("__text_hash", F.xxhash64(F.col(text_col)))
    left = own.join(stay, own[id_col].eqNullSafe(stay["__id"]) & (own["__text_hash"] == stay["__hash"]), "left_semi")
    return left.dropDuplicates([id_col, "__text_hash"]).select(*docs.columns)
