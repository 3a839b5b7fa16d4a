"""Repeated byte strings across documents, by prefix-free parsing.

A rolling hash over a few bytes is taken at every place of a text. The least one within
the reach of a string is its trigger, and the strings that have one trigger after the
other form a phrase: texts fall into equal phrases wherever equal strings stand, each
string lies in one phrase, and phrases overlap by a string less one byte. The parse of a
document is the row of its phrases, the dictionary holds each different phrase once with
the first document that has it.

Strings can only be equal if their triggers are, and with them the bytes before or the
bytes behind, as far as half of what a string has beside its trigger. A phrase that an
earlier document has needs no look at its bytes: all its strings are repeated. Of the
dictionary's phrases that share a trigger and one of its sides with a different phrase the
suffixes are sorted to the length of a string; equal neighbours in that order are equal
strings, the least document among them is the first to have it. Together this is the order
of all suffixes of the corpus to that length, in parts by trigger and side, and text that
repeats costs as much as its hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.llm.common import key_filter, shuffle_parts, slot_bits
from backtrail.session import scratch_path

#: Bytes under the rolling hash.
GRAM = 16
#: Bytes whose phrases a task holds at once, and bytes that it parses together; a longer text is parsed in parts.
BLOCK, PART = 1 << 20, 1 << 18
#: Phrases, and bytes of phrases to be sorted, that a task gathers before it deals them out: a row holds what goes to one bucket.
GATHERED, SENT = 1 << 18, 1 << 22
#: Phrases whose triggers are compared together, and bytes whose suffixes are sorted together, on average.
PHRASES, SORTED = 1 << 19, 1 << 20
#: A trigger with more different phrases has them cut anew by longer grams, of a string less ``NEAR`` bytes; the
#: parts are compared wherever theirs are sorted.
HOT, NEAR = 20_000, 10
#: Phrases to be sorted that the tasks are told by a map of at most 32 MB; more are joined to their texts.
TOLD = 1 << 23
#: Order of a document without an id: after all others, and none before another.
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 24) - 1)
_REPEATED, _SORT, _SORT_PARTS = 0, 1, 2
_FOUND = "order long, text_hash long, at long, strings int, kind int, route long"
_SPAN = "order long, text_hash long, at long, strings int"


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        found.append(np.cumprod(row))
    return found[0], found[1]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The running sum whose differences hash a stretch of bytes, and what takes its place out of them."""
    power, inverse = _powers(1 << max(19, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return sums, inverse


def _mixed(found: np.ndarray) -> np.ndarray:
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(32)
    return found


def rolled(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` bytes in a row: differences of one running sum."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums, inverse = _sums(data)
    return _mixed((sums[width:] - sums[:-width]) * inverse[:len(data) - width + 1])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[:len(keys) - (width - done)], keys[width - done:]) if width > done else keys


def _parsed(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """As ``parse``, and hashes of 16 bits of the two sides of the trigger, 0 for a side by which no string of the phrase is told.

    A string that has ``half`` bytes or more before its trigger is told by the trigger with
    ``half`` bytes before it, another one by the trigger with ``half`` bytes behind it.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    sums, inverse = _sums(data)
    grams = _mixed((sums[gram:] - sums[:-gram]) * inverse[:len(data) - gram + 1])
    keys = grams & ~_LOW
    keys |= np.arange(len(grams), dtype=np.uint64)
    chosen = _least(keys, length - gram + 1) & _LOW
    # a phrase begins where the trigger changes, and with each text; strings that reach into the next text are none
    first = np.union1d(np.flatnonzero(chosen[1:] != chosen[:-1]) + 1, begin)
    owner = np.searchsorted(begin, first, "right") - 1
    end = begin[owner] + sizes[owner] - length + 1
    inside = first < end
    stop = np.minimum(np.r_[first[1:], len(data)], end)[inside]
    first, owner = first[inside], owner[inside]
    at = chosen[first].astype(np.int64)
    half = (length - gram) // 2
    most, least = at - first, at - stop + 1  # bytes before the trigger in the first string and in the last

    def side(told: np.ndarray, begin: np.ndarray) -> np.ndarray:
        begin, out = begin[told], np.zeros(len(told), np.uint16)
        wide = _mixed((sums[begin + gram + half] - sums[begin]) * inverse[begin])
        out[told] = (wide >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        return out

    # the least of many hashes is small: mixed again, so that its first bits deal out evenly
    trigger = (grams[at] ^ (grams[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return owner, first - begin[owner], stop - first, trigger, side(most >= half, at - half), side(least < half, at)


def parse(texts: list[bytes], length: int, gram: int | None = None) -> tuple[np.ndarray, ...]:
    """Phrases of texts of at least ``length`` bytes: text, place of the first string, strings, hash of the trigger.

    A phrase spans the bytes of its strings; the next one begins with the next string. A
    trigger has ``gram`` bytes, ``GRAM`` if not told.
    """
    return _parsed(texts, length, gram or GRAM)[:4]


def _blocks(texts: pa.Array, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, places and parts of texts, about ``BLOCK`` bytes at a time. Each string lies in one part."""
    rows, at, parts, size = [], [], [], 0
    for row, value in enumerate(texts):  # one text at a time leaves the batch
        text = value.as_py()
        for place in range(0, len(text) - length + 1, PART):
            rows.append(row)
            at.append(place)
            parts.append(text[place:place + PART + length - 1])
            size += len(parts[-1])
            if size >= BLOCK:
                yield rows, at, parts
                rows, at, parts, size = [], [], [], 0
    if parts:
        yield rows, at, parts


def _packed(columns: Sequence[np.ndarray], extra: bytes = b"") -> bytes:
    """Whole numbers as planes of their bytes, compressed; zero planes cost next to nothing."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes) + extra, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, size: int, layout: Sequence[tuple[int, str]]) -> tuple[list[np.ndarray], bytes]:
    """The columns (count, type) and what follows them."""
    data = pa.decompress(raw, size, codec="zstd", asbytes=True)
    out, at = [], 0
    for count, kind in layout:
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(data, np.uint8, count * width, at).reshape(width, count)
        out.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += count * width
    return out, data[at:]


def _in_blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes], tuple]]:
    """Of each block its documents (once), and of its phrases document, place in it, and the parse."""
    for rows, at, parts in _blocks(batch.column(2), length):
        own, doc_of = np.unique(rows, return_inverse=True)
        found, begin, size = [], 0, 0
        for k, part in enumerate(parts):  # a few parts at a time, so that the arrays stay small
            size += len(part)
            if size >= PART or k + 1 == len(parts):
                owner, *rest = _parsed(parts[begin:k + 1], length, GRAM)
                found.append((owner + begin, *rest))
                begin, size = k + 1, 0
        owner, place, *rest = (np.concatenate(c) for c in zip(*found))
        yield batch.select([0, 1]).take(pa.array(own)), doc_of[owner], np.array(at)[owner] + place, parts, (owner, place, *rest)


def _together(held: list[tuple]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Documents of several blocks, the document of each entry among them, and the entries' other columns."""
    sizes = [len(docs) for docs, *_ in held]
    names = [np.concatenate([docs.column(k).to_numpy(zero_copy_only=False) for docs, *_ in held]).astype("<i8") for k in (0, 1)]
    doc = np.concatenate([own + a for (_, own, *_), a in zip(held, np.cumsum(sizes) - sizes)])
    return names, doc, [np.concatenate(c) for c in zip(*(rest for _, _, *rest in held))]


def _rows(names: list[np.ndarray], doc: np.ndarray, bucket: np.ndarray, entries: Callable[[slice, np.ndarray], tuple[list[np.ndarray], bytes]],
          rank: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: the entries that ``rank`` puts there, and of the documents those that have one."""
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        r = rank[a:b]
        used, mine = np.unique(doc[r], return_inverse=True)
        columns, extra = entries(slice(a, b), r)
        columns = [mine.astype("<u4"), *columns, *(c[used] for c in names)]
        rows.append((int(bucket[a]), sum(c.nbytes for c in columns) + len(extra), b - a, len(used), _packed(columns, extra)))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)],
                                      names=["bucket", "size", "entries", "docs", "data"])


def _phrases(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """The parse by trigger: rows of ``bucket``, ``size``, ``entries``, ``docs`` and packed columns."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    gathered = GATHERED

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        names, doc, (at, strings, trigger, hashes, before, behind) = _together(held)
        rank = np.argsort(trigger, kind="stable")
        mark = ((trigger[rank] << (np.uint64(64) - shift)) >> np.uint64(32)).astype("<u4")

        def entries(own: slice, r: np.ndarray) -> tuple[list[np.ndarray], bytes]:
            return [np.diff(mark[own], prepend=np.uint32(0)), hashes[r], at[r].astype("<u8"), strings[r].astype("<u2"), before[r], behind[r]], b""

        return _rows(names, doc, (trigger[rank] >> shift).astype(np.int64), entries, rank)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for docs, doc, at, parts, (owner, place, strings, trigger, before, behind) in _in_blocks(batch, length):
                hashes = np.fromiter((digest(parts[o][p:p + n + length - 1]) for o, p, n in zip(owner.tolist(), place.tolist(), strings.tolist())),
                                     np.uint64, len(owner))
                held.append((docs, doc, at, strings, trigger, hashes, before, behind))
                count += len(owner)
                if count >= gathered:
                    yield dealt(held)
                    held, count = [], 0
        if held:
            yield dealt(held)

    return docs.mapInArrow(found, "bucket int, size long, entries int, docs int, data binary")


def _elsewhere(mark: np.ndarray, side: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which phrases share a trigger and this side of it with a phrase of another order."""
    key = mark.astype(np.uint64) << np.uint64(16) | side
    rank = np.argsort(key, kind="stable")
    new = np.r_[True, key[rank][1:] != key[rank][:-1]]
    starts, of = np.flatnonzero(new), np.cumsum(new) - 1
    found = np.empty(len(key), bool)
    found[rank] = (np.maximum.reduceat(order[rank], starts) > np.minimum.reduceat(order[rank], starts))[of]
    return found & (side > 0)


def _classified(table: pa.Table, hot: int) -> pa.Table:
    """Of the phrases of one bucket those that are repeated, and those whose suffixes are to be sorted."""
    parts = []
    bucket = table.column("bucket")[0].as_py()
    for size, n, d, raw in zip(*(table.column(c).to_pylist() for c in ("size", "entries", "docs", "data"))):
        (doc, mark, digest, at, strings, before, behind, order, text_hash), _ = _unpacked(
            raw, size, [(n, "<u4"), (n, "<u4"), (n, "<u8"), (n, "<u8"), (n, "<u2"), (n, "<u2"), (n, "<u2"), (d, "<i8"), (d, "<i8")])
        parts.append((np.cumsum(mark, dtype=np.uint32), digest, order[doc], text_hash[doc], at.astype(np.int64), strings, before, behind))
    mark, *columns = (np.concatenate(c) for c in zip(*parts))
    del parts
    rank = np.argsort(mark, kind="stable")
    same = mark[rank][1:] == mark[rank][:-1]
    rank = rank[np.r_[False, same] | np.r_[same, False]]  # a trigger that comes once is of no interest
    mark, (digest, order, text_hash, at, strings, before, behind) = mark[rank], (c[rank] for c in columns)
    del columns
    rank = np.lexsort((order, digest, mark))
    mark, digest, order, text_hash, at, strings, before, behind = (c[rank] for c in (mark, digest, order, text_hash, at, strings, before, behind))
    kind = np.zeros(len(mark), np.int64)
    if len(mark):
        new_class = np.r_[True, (mark[1:] != mark[:-1]) | (digest[1:] != digest[:-1])]
        kind = np.where(order > order[np.flatnonzero(new_class)][np.cumsum(new_class) - 1], _REPEATED, -1)
        first = np.flatnonzero(kind < 0)  # of its class; an equal string of another class is in one of these too
        first = first[_elsewhere(mark[first], before[first], order[first]) | _elsewhere(mark[first], behind[first], order[first])]
        _, of, count = np.unique(mark[first], return_inverse=True, return_counts=True)
        kind[first] = np.where((count > hot)[of], _SORT_PARTS, _SORT)
    told = np.flatnonzero(kind >= 0)
    told = told[np.lexsort((at[told], text_hash[told], order[told]))]
    return pa.table({
        "order": order[told], "text_hash": text_hash[told], "at": at[told], "strings": strings[told].astype(np.int32),
        "kind": kind[told].astype(np.int32), "route": (np.int64(bucket) << 32) | mark[told].astype(np.int64)})


def _place_key(order: np.ndarray, text_hash: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of a place in a document."""
    found = np.zeros(len(order), np.uint64)
    for part in (order, text_hash, at):
        found = (found ^ part.astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(32)
    return found


def _told_places(wanted: DataFrame, count: int) -> np.ndarray:
    """Map of the places, 16 bits for each."""
    size = 1 << (16 * count + (1 << 15)).bit_length()

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _place_key(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array((key & np.uint64(size - 1)).astype(np.int64))], names=["slot"])

    return slot_bits(wanted.select("order", "text_hash", "at").mapInArrow(slots, "slot long"), size)


def _cut_anew(pieces: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The parse of pieces by longer grams, about ``PART`` bytes at a time; pieces are numbered through."""
    ends = np.cumsum([len(p) for p in pieces])
    cuts = [0, *(np.flatnonzero(np.diff(ends // PART)) + 1).tolist(), len(pieces)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        owner, *rest = parse(pieces[a:b], length, max(GRAM, length - NEAR))
        yield owner + a, *rest


Cut = tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]


def _sent(cuts: Callable[[pa.RecordBatch], Iterator[Cut]], length: int, buckets: int) -> Callable:
    """Pieces of documents to the buckets where their suffixes are sorted, packed by some ``SENT`` bytes."""
    most = SENT

    def dealt(held: list[tuple], pieces: list[bytes]) -> pa.RecordBatch:
        names, doc, (at, route, hot) = _together(held)
        if hot.any():  # in parts, each by the hash of its own trigger
            alone, keep = np.flatnonzero(hot), np.flatnonzero(~hot)
            found = zip(*_cut_anew([pieces[k] for k in alone.tolist()], length))
            owner, place, strings, trigger = (np.concatenate(c) for c in found)
            of = alone[owner]
            doc, at = np.r_[doc[keep], doc[of]], np.r_[at[keep], at[of] + place]
            route = np.r_[route[keep], (trigger >> np.uint64(1)).astype(np.int64)]
            pieces = [pieces[k] for k in keep.tolist()] + [
                pieces[k][p:p + n + length - 1] for k, p, n in zip(of.tolist(), place.tolist(), strings.tolist())]
        bucket = (route.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets
        rank = np.argsort(bucket, kind="stable")

        def entries(_: slice, r: np.ndarray) -> tuple[list[np.ndarray], bytes]:
            own = [pieces[k] for k in r.tolist()]
            return [at[r].astype("<u8"), np.array([len(x) for x in own], "<u4")], b"".join(own)

        return _rows(names, doc, bucket[rank], entries, rank)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered, size = [], [], 0
        for batch in batches:
            for docs, doc, at, pieces, route, hot in cuts(batch):
                held.append((docs, doc, at, route, hot))
                gathered += pieces
                size += sum(map(len, pieces)) + 16 * len(docs)
                if size >= most:
                    yield dealt(held, gathered)
                    held, gathered, size = [], [], 0
        if held:
            yield dealt(held, gathered)

    return send


def suffix_array(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``at``, sorted to ``length`` bytes (8 at least), and which of them differ from the one before.

    Eight bytes are compared at a time, as whole numbers; the last eight may overlap those before.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)) if len(data) > 7 else np.zeros(0, ">u8")
    order, new = np.arange(len(at)), np.zeros(len(at), bool)
    new[:1] = True
    for k in [*range(0, length - 7, 8), length - 8]:
        group = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))  # the only suffix of its group has its place
        own = order[tied]
        value = words[at[own] + k].astype(np.uint64)
        rank = np.lexsort((value, group[tied])) if k else np.argsort(value, kind="stable")
        order[tied] = own[rank]
        value, of = value[rank], group[tied]
        new[tied[1:]] |= (value[1:] != value[:-1]) & (of[1:] == of[:-1])
    return order, new


def earlier(pieces: list[bytes], order: np.ndarray, length: int) -> np.ndarray:
    """Rows of (piece, from, to): runs of places whose string a piece of a lower order holds too."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    strings = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), strings)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    suffixes, new = suffix_array(data, (np.cumsum(sizes) - sizes)[owner] + place, length)
    starts = np.flatnonzero(new)
    own = order[owner[suffixes]]
    hit = np.empty(len(owner), bool)
    hit[suffixes] = np.minimum.reduceat(own, starts)[np.cumsum(new) - 1] < own
    new_piece = np.r_[True, owner[1:] != owner[:-1]]
    begins = np.flatnonzero(hit & (new_piece | ~np.r_[False, hit[:-1]]))
    stops = np.flatnonzero(hit & np.r_[new_piece[1:] | ~hit[1:], True])
    return np.stack([owner[begins], place[begins], place[stops] + 1], axis=1)


def _sorted(length: int) -> Callable[[pa.Table], pa.Table]:
    """Repeated strings among the pieces of a bucket, about ``SORTED`` bytes on average."""

    def sort(table: pa.Table) -> pa.Table:
        parts, pieces = [], []
        for size, n, d, raw in zip(*(table.column(c).to_pylist() for c in ("size", "entries", "docs", "data"))):
            (doc, at, sizes, order, text_hash), text = _unpacked(raw, size, [(n, "<u4"), (n, "<u8"), (n, "<u4"), (d, "<i8"), (d, "<i8")])
            ends = np.cumsum(sizes, dtype=np.int64)
            pieces += [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            parts.append((order[doc], text_hash[doc], at.astype(np.int64)))
        order, text_hash, at = (np.concatenate(c) for c in zip(*parts))
        piece, begin, stop = earlier(pieces, order, length).T
        return pa.table({"order": order[piece], "text_hash": text_hash[piece], "at": at[piece] + begin,
                         "strings": (stop - begin).astype(np.int32)})

    return sort


def _sorted_spans(docs: DataFrame, wanted: DataFrame, length: int, buckets: int) -> DataFrame:
    """Repeated strings of the phrases whose suffixes are to be sorted.

    The tasks that parse the documents are told the places by a map; if there are more
    than ``TOLD``, the places are joined to their documents instead.
    """
    sizes = wanted.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("strings") + (length - 1)).alias("bytes")).collect()  # two rows at most
    count = sum(r["n"] for r in sizes)
    total = sum(r["bytes"] * (1 if r["kind"] == _SORT else 4) for r in sizes)
    parts = max(shuffle_parts(docs.sparkSession), total // SORTED)
    if count <= TOLD:
        # the map also lets some places pass that nobody asked for: what is done with them is up to their trigger.
        # Of triggers in parts there is one for each ``HOT`` phrases at most
        hot = wanted.where(F.col("kind") == _SORT_PARTS).select("route").distinct().toArrow().column(0).to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast((_told_places(wanted, count), np.sort(hot)))
        shift = np.uint64(32 - (buckets.bit_length() - 1))

        def marked(batch: pa.RecordBatch) -> Iterator[Cut]:
            bits, hot = shared.value
            for own, doc, at, texts, (owner, place, strings, trigger, *_) in _in_blocks(batch, length):
                order, text_hash = (c.to_numpy(zero_copy_only=False)[doc] for c in own.columns)
                slot = _place_key(order, text_hash, at) & np.uint64(len(bits) * 8 - 1)
                rows = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                pieces = [texts[o][p:p + n + length - 1] for o, p, n in zip(owner[rows].tolist(), place[rows].tolist(), strings[rows].tolist())]
                route = (trigger[rows] >> shift).astype(np.int64)
                yield own, doc[rows], at[rows], pieces, route, np.isin(route, hot)

        cut = docs.mapInArrow(_sent(marked, length, parts), "bucket int, size long, entries int, docs int, data binary")
    else:
        listed = wanted.groupBy("order", "text_hash").agg(F.collect_list(F.struct("at", "strings", "route", "kind")).alias("wanted"))
        beside = docs.dropDuplicates(["order", "text_hash"]).join(listed, ["order", "text_hash"]).select("order", "text_hash", "text", "wanted")

        def listed_cuts(batch: pa.RecordBatch) -> Iterator[Cut]:
            lists = batch.column(3)
            to, flat = lists.offsets.to_numpy(), lists.flatten()
            to = to - to[0]
            at, strings, route, kind = (flat.field(name).to_numpy() for name in ("at", "strings", "route", "kind"))
            owner = np.repeat(np.arange(len(to) - 1), np.diff(to))
            stops = at + strings + (length - 1)
            pieces, first, size = [], 0, 0
            for row, value in enumerate(batch.column(2)):  # one text at a time leaves the batch
                text = value.as_py()
                pieces += [text[a:b] for a, b in zip(at[to[row]:to[row + 1]].tolist(), stops[to[row]:to[row + 1]].tolist())]
                size += len(text)
                if size >= BLOCK or row + 2 == len(to):
                    own = slice(to[first], to[row + 1])
                    yield (batch.select([0, 1]).slice(first, row + 1 - first), owner[own] - first, at[own], pieces, route[own],
                           kind[own] == _SORT_PARTS)
                    pieces, first, size = [], row + 1, 0

        cut = beside.mapInArrow(_sent(listed_cuts, length, parts), "bucket int, size long, entries int, docs int, data binary")
    return cut.groupBy("bucket").applyInArrow(_sorted(length), _SPAN)


def _merged(marked: DataFrame, length: int) -> DataFrame:
    """The runs of bytes that the places cover, in order and apart, instead of the places."""

    def merge(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lists:
            to, flat = column.offsets.to_numpy(), column.flatten()
            to = to - to[0]
            begin = flat.field("at").to_numpy()
            stop = begin + flat.field("strings").to_numpy() + (length - 1)
            owner = np.repeat(np.arange(len(to) - 1), np.diff(to))
            rank = np.lexsort((begin, owner))
            begin, stop, owner = begin[rank], stop[rank], owner[rank]
            reach = np.maximum.accumulate(owner * (1 << 40) + stop)  # starts anew with each document
            new = np.flatnonzero(np.r_[True, owner[1:] * (1 << 40) + begin[1:] > reach[:-1]])
            last = np.r_[new[1:], len(begin)] - 1
            ends = reach[last] - owner[new] * (1 << 40)
            count = np.searchsorted(owner[new], np.arange(len(to))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(count), pa.StructArray.from_arrays(
                [pa.array(begin[new]), pa.array(ends)], names=["from", "to"]))

    runs = F.arrow_udf(merge, "array<struct<from:long,to:long>>")
    return marked.withColumn("removed", runs("places")).drop("places")


def _shuffled_files_go(spark: SparkSession) -> None:
    """What finished jobs have shuffled is removed now, not when the driver happens to collect its garbage."""
    for _ in range(2):  # the first only finds what held them
        spark.sparkContext._jvm.System.gc()


def repeated_runs(docs: DataFrame, length: int = 50) -> DataFrame:
    """``order``, ``text_hash`` and ``removed`` of the documents that hold strings of earlier ones.

    ``docs`` has ``order`` (long), ``text_hash`` and ``text`` (binary). ``removed`` lists the
    maximal runs of bytes ``from`` to ``to`` covered by a string of ``length`` bytes
    that also starts in a document of a lower order, in order.
    """
    spark = docs.sparkSession
    stage = scratch_path(spark, "phrases")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(2, shuffle_parts(spark), 2 * size // ((length - GRAM + 2) * PHRASES))
    buckets = 1 << (least - 1).bit_length()
    hot = HOT

    def classify(bucket: pa.Table) -> pa.Table:
        return _classified(bucket, hot)

    found = _phrases(docs, length, buckets).groupBy("bucket").applyInArrow(classify, _FOUND)
    found.write.option("compression", "zstd").parquet(stage)
    _shuffled_files_go(spark)
    known = spark.read.schema(_FOUND).parquet(stage)
    spans = known.where(F.col("kind") == _REPEATED).select("order", "text_hash", "at", "strings")
    spans = spans.unionByName(_sorted_spans(docs, known.where(F.col("kind") != _REPEATED), length, buckets))
    marked = spans.groupBy("order", "text_hash").agg(F.collect_list(F.struct("at", "strings")).alias("places"))
    return _merged(marked, length)


def _told_apart(own: DataFrame) -> Column:
    """What tells a text from others of the same ``order``: its hash, 0 where the order does by itself."""
    spark = own.sparkSession
    text_hash = F.xxhash64("text")
    stage = scratch_path(spark, "orders")
    sides = own.groupBy("order").agg(F.min(text_hash).alias("least"), F.max(text_hash).alias("most"))
    sides.where("least < most").select("order").write.parquet(stage)
    several = spark.read.schema("order long").parquet(stage)
    none = F.col("order").bitwiseAND(F.lit(0).cast("long"))  # no constant: that would drop out of some of the keys, and texts be exchanged twice
    return none if several.isEmpty() else F.when(key_filter(several)(F.col("order")), text_hash).otherwise(none)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes that earlier documents hold.

    A byte goes if it is covered by a string of ``length`` bytes (over ``GRAM``) that also
    starts in a document with a smaller id; strings are judged on the texts as they came.
    Ids are whole numbers; a document without one counts as later than all that have one.
    Rows with one id take nothing from each other. A null text counts as empty. Returns
    one row per row of ``docs``, only the two columns of which are read: the id,
    ``n_bytes``, ``removed`` (runs ``from``, ``to``, in order) and ``kept`` (the bytes left).
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("order"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    own = own.withColumn("text_hash", _told_apart(own))
    stage = scratch_path(spark, "removed")
    repeated_runs(own.select("order", "text_hash", "text"), length).write.parquet(stage)
    _shuffled_files_go(spark)
    runs = spark.read.schema("order long, text_hash long, removed array<struct<from:long,to:long>>").parquet(stage)
    key = F.xxhash64("order", "text_hash")
    maybe = key_filter(runs.select(key.alias("key")))
    none = F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)")
    told = own.withColumn("__maybe", maybe(key))
    clean = told.where("not __maybe").select("id", "text", none.alias("removed"))
    rest = told.where("__maybe").join(runs, ["order", "text_hash"], "left").select(
        "id", "text", F.coalesce("removed", none).alias("removed"))

    @F.arrow_udf("binary")
    def left(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), removed.to_pylist()):
            stops = [0, *(x["to"] for x in gone)]
            out.append(b"".join(text[a:b] for a, b in zip(stops, [*(x["from"] for x in gone), len(text)])))
        return pa.array(out, pa.binary())

    return clean.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "removed", F.col("text").alias("kept")).unionByName(
        rest.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "removed", left("text", "removed").alias("kept"))
    ).withColumnRenamed("id", id_col)
