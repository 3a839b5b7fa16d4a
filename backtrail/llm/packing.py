"""Token sequences of a fixed length, packed by best-two-fit."""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.bpe import MEMO_ENTRIES, words
from backtrail.session import scratch_path

#: Pieces that are packed together. More pieces make more groups, each about this large.
GROUP_PIECES = 16_384
#: Sequences with less of their room filled are packed anew with those of the other groups.
FILLED = 0.995


class WordIds:
    """Ids of texts, looked up word by word; the library encodes each new word once per worker.

    Fits vocabularies whose tokens never reach across white space.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        special = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = special[0] if special else ("", -1)

    def encode(self, fresh: list[str]) -> None:
        """Encode words in one call, a special token between them; words that hold one go alone."""
        plain = [w for w in fresh if self.mark not in w] if self.mark else []
        if plain:
            ids = np.array(self.library.encode(self.mark.join(plain), add_special_tokens=False).ids, "<u4")
            raw = ids.tobytes()
            ends = [*(np.flatnonzero(ids == self.mark_id) * 4).tolist(), len(raw)]
            at = 0
            for word, end in zip(plain, ends, strict=True):
                self.known[word] = raw[at:end]
                at = end + 4
        for word in fresh:
            if not self.mark or self.mark in word:
                ids = self.library.encode(word, add_special_tokens=False).ids
                self.known[word] = np.array(ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids.

        When the memo is full, the words before it are dropped but for those that come again.
        """
        found = words(text or "")
        parts = list(map(self.known.get, found))
        if None in parts:
            if len(self.known) >= MEMO_ENTRIES:
                self.before, self.known = self.known, {}
            fresh = []
            for word in dict.fromkeys(w for w, part in zip(found, parts) if part is None):
                part = self.before.get(word)
                if part is None:
                    fresh.append(word)
                else:
                    self.known[word] = part
            if fresh:
                self.encode(fresh)
            known = self.known
            parts = [known[w] if part is None else part for w, part in zip(found, parts)]
        return b"".join(parts)


@functools.lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The ids of every document with ``end_id`` behind, cut only where longer than ``capacity``.

    One row per piece: the id column, ``piece`` (from 0), ``start`` (ids before it in
    its document), ``length``, ``ids_crc32`` (of the little-endian 32-bit ids) and,
    if wanted, ``ids``. A null text counts as empty: its only piece is ``end_id``.
    Only the id and the text are read; repeated rows each give their pieces.
    """
    end = end_id.to_bytes(4, "little")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = "id {}, piece int, start long, length long, ids_crc32 long{}".format(
        id_type, ", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                raw = own.ids(text) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    row.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(pa.Array.from_buffers(pa.int32(), len(part) // 4, [None, pa.py_buffer(part)]).to_pylist())
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


class _Shelf:
    """Unpacked items by length."""

    def __init__(self, lengths: list[int]) -> None:
        self.items: dict[int, list[int]] = {}
        for i in reversed(range(len(lengths))):
            self.items.setdefault(lengths[i], []).append(i)
        self.sizes = sorted(self.items)

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            del self.items[size]
            del self.sizes[bisect_left(self.sizes, size)]
        return item

    def put(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            self.sizes.insert(bisect_left(self.sizes, size), size)
        self.items[size].append(item)

    def largest(self, room: int) -> int | None:
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None

    def tightest_two(self, room: int, above: int) -> tuple[int, int] | None:
        """The two sizes with the largest sum up to ``room``, if it is over ``above``."""
        sizes, best, found = self.sizes, above, None
        low, high = 0, bisect_left(sizes, room) - 1
        while low <= high:
            total = sizes[low] + sizes[high]
            if total > room:
                high -= 1
                continue
            if low == high and len(self.items[sizes[low]]) < 2:
                break
            if total > best:
                best, found = total, (sizes[low], sizes[high])
                if best == room:
                    break
            low += 1
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: fill greedily, then trade the smallest item for two that fit tighter.

    A bin takes the largest item that fits until none does. While room is left and two
    unpacked items fill the room of its smallest item and the gap better than that item,
    they take its place and it waits again. Every trade makes the gap smaller.
    """
    shelf, bins = _Shelf(lengths), []
    while shelf.sizes:
        own: list[tuple[int, int]] = []
        room = capacity
        while (size := shelf.largest(room)) is not None:
            own.append((size, shelf.take(size)))
            room -= size
        if not own:
            raise ValueError("an item is longer than a sequence")
        while room and (two := shelf.tightest_two(room + min(own)[0], min(own)[0])):
            size, item = min(own)
            own.remove((size, item))
            shelf.put(size, item)
            room += size
            for size in two:
                own.append((size, shelf.take(size)))
                room -= size
        bins.append([item for _, item in own])
    return bins


def _packed(parts: DataFrame, groups: int, capacity: int, stage: int) -> DataFrame:
    """Best-two-fit within groups dealt by hash; adds ``sequence_id``, ``offset`` and ``room``."""
    names = [f.name for f in parts.schema.fields]

    def pack(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        table = table.drop_columns(["__group"]).sort_by(
            [("length", "descending"), *((n, "ascending") for n in names if n in ("__id", "piece", "ids_crc32"))])
        lengths = table.column("length").to_pylist()
        order, sequence, offset, room = [], [], [], []
        for number, items in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for item in items:
                order.append(item)
                sequence.append((group * 2 + stage) << 32 | number)
                offset.append(at)
                at += lengths[item]
            room += [capacity - at] * len(items)
        placed = table.take(pa.array(order, pa.int64()))
        for name, values in (("sequence_id", sequence), ("offset", offset), ("room", room)):
            placed = placed.append_column(name, pa.array(values, pa.int64()))
        return placed

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(pack, f"{schema}, sequence_id long, offset long, room long")


def pack(parts: DataFrame, rows: int, capacity: int = 4096, id_col: str = "doc_id",
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Put every piece into a sequence of at most ``capacity`` ids.

    ``parts`` is what ``pieces`` gives, ``rows`` about how many documents it has (it
    only sets the number of groups). Pieces are dealt by hash into groups of about
    ``group_pieces``, each packed by best-two-fit. The sequences that stay under
    ``FILLED`` of their room, a few per group, are opened and packed once more
    across groups. Adds ``sequence_id`` (unique, else without meaning) and ``offset``.
    """
    spark = parts.sparkSession
    path = scratch_path(spark, "packed")
    first = _packed(parts.withColumnRenamed(id_col, "__id"), -(-max(rows, 1) // group_pieces), capacity, 0)
    first.write.parquet(path)
    placed = spark.read.parquet(path)
    loose = F.col("room") > capacity * (1 - FILLED)
    left = placed.where(loose).drop("sequence_id", "offset", "room")
    again = _packed(left, -(-max(left.count(), 1) // group_pieces), capacity, 1)
    return placed.where(~loose).unionByName(again).drop("room").withColumnRenamed("__id", id_col)
