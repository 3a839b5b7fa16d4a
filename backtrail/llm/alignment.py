"""Alignment of two tokenizers over the same bytes, by lockstep merging.

The tokens of a batch of documents lie behind each other as ends of byte ranges, once
for each tokenizer. A state vector holds a pointer into either list for every lane; all
lanes advance together, one link a step: the token that ends first moves on, both move
where both end, which is a cut. Lanes that are through leave the vector. A document has
a lane for every ``LANE`` tokens of A, so that a very long one does not walk alone.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.bpe import _byte_letters
from backtrail.session import scratch_path

#: Tokens of A in a lane.
LANE = 512
#: Bytes of text that are aligned together; a longer document goes alone.
BATCH_BYTES = 2 << 20
#: Units of text whose ids a worker keeps, and those of the time before.
MEMO_UNITS = 150_000
#: A pair that holds over 1/HOT of all pairs of documents is looked up on the spot: fewer than HOT by arithmetic.
HOT = 100_000

#: A single space; neither vocabulary has a token that reaches over one.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: A space beside other white space.
_CROWDED = re.compile(r" \s|\s ")


class TokenPair:
    """Ids of texts in both vocabularies, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(byte_of.get, token)) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        #: Ids of units in A (None where the bytes differ) and in B, and those of the time before.
        self.known: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})
        self.before: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})
        self.digits, self.width = _digit_table(max(len(self.bytes_a), len(self.bytes_b)))

    def encode(self, texts: Sequence[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids (32 bits each) of a space and the text in A, and of the text, before which B puts a space.

        Both are empty where the text is, or where the bytes of the tokens are not those
        of the text. The libraries encode each unit once; when the memo is full, the units
        before it are dropped but for those that come again.
        """
        units = [_units(t) if t else [] for t in texts]
        if len(self.known[0]) >= MEMO_UNITS:
            self.before, self.known = self.known, ({}, {})
        (of_a, of_b), fresh = self.known, []
        for unit in dict.fromkeys(u for own in units for u in own if u not in of_a):
            if unit in self.before[0]:
                of_a[unit], of_b[unit] = self.before[0][unit], self.before[1][unit]
            else:
                fresh.append(unit)
        plain = [u for u in fresh if u and not u[0].isspace() and not u[-1].isspace()]
        for at in range(0, len(plain), 2000):
            part = plain[at:at + 2000]
            found = self._together(part)
            if found:
                of_a.update(zip(part, found[0]))
                of_b.update(zip(part, found[1]))
        for unit in fresh:
            if unit not in of_a:
                found = self._together([unit])
                of_a[unit], of_b[unit] = (found[0][0], found[1][0]) if found else (None, None)
        out = []
        for own in units:
            a = list(map(of_a.__getitem__, own))
            out.append((b"", b"") if None in a else (b"".join(a), b"".join(map(of_b.__getitem__, own))))
        return out

    def _together(self, units: list[str]) -> list[list[bytes]]:
        """Ids of units in A and in B, encoded as one text and cut where the units end; nothing if the bytes differ."""
        text = " ".join(units)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in units])
        out = []
        for ids, sizes, spelt in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.size_a, self.bytes_a),
                                  (self.b.encode(text), self.size_b, self.bytes_b)):
            if b"".join(map(spelt.__getitem__, ids)) != raw:
                return []
            own = np.array(ids, "<u4")
            upto = np.cumsum(sizes[own])
            at = np.searchsorted(upto, ends)
            if not np.array_equal(upto[at], ends):
                return []
            stops, flat = ((at + 1) * 4).tolist(), own.tobytes()
            out.append([flat[a:b] for a, b in zip([0, *stops], stops)])
        return out


@functools.lru_cache(maxsize=2)
def token_pair(path_a: str, path_b: str) -> TokenPair:
    """One per pair of files and worker."""
    return TokenPair(path_a, path_b)


def _units(text: str) -> list[str]:
    """The text cut at its single spaces; each unit gets one in front again.

    Before such a space either library begins a new token, whatever follows.
    """
    if text[0] == " " or text[-1] == " " or _CROWDED.search(text):
        return _GAP.split(text)
    return text.split(" ")


def _digit_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each number, with room for one more letter, and how many there are."""
    spelt = np.arange(size).astype("S")
    digits = np.zeros((size, spelt.itemsize + 1), np.uint8)
    digits[:, :-1] = spelt.view(np.uint8).reshape(size, -1)
    return digits, np.char.str_len(spelt)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, stop_a: np.ndarray,
             first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in A and B) in the order they are met, and cuts (the tokens that end there).

    ``ends_*`` are the ends of all tokens in bytes. Each lane begins at ``first_a`` and
    ``first_b`` and ends when its pointer into A reaches ``stop_a``.
    """
    a, b, stop = first_a.copy(), first_b.copy(), stop_a
    links, cuts = [], []
    while len(a):
        links.append((a, b))
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        if both.any():
            cuts.append((a[both], b[both]))
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        walking = a < stop
        if not walking.all():
            a, b, stop = a[walking], b[walking], stop[walking]
    none = np.zeros(0, np.int64)
    return (*(np.concatenate(x) for x in zip(*links)), *(np.concatenate(x) for x in zip(*cuts))) if links else (none,) * 4


class Aligned:
    """The alignment of a batch: tokens, links, cuts and pairs of all its documents behind each other."""

    def __init__(self, own: TokenPair, found: list[tuple[bytes, bytes]]) -> None:
        count_a = np.array([len(a) // 4 for a, _ in found], np.int64)
        count_b = np.array([len(b) // 4 for _, b in found], np.int64)
        self.a = np.frombuffer(b"".join([a for a, _ in found]), "<u4").astype(np.int64)
        self.b = np.frombuffer(b"".join([b for _, b in found]), "<u4").astype(np.int64)
        ends_a, ends_b = np.cumsum(own.size_a[self.a]), np.cumsum(own.size_b[self.b])
        self.after_a, self.after_b = np.r_[0, np.cumsum(count_a)], np.r_[0, np.cumsum(count_b)]
        lanes = -(-count_a // LANE)
        within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = np.repeat(self.after_a[:-1], lanes) + within * LANE
        stop = np.minimum(first + LANE, np.repeat(self.after_a[1:], lanes))
        begin = np.r_[0, ends_a][first]
        link_a, link_b, cut_a, cut_b = lockstep(ends_a, ends_b, first, stop, np.searchsorted(ends_b, begin, "right"))
        order = np.argsort(link_a * (len(self.b) + 1) + link_b, kind="stable")
        self.link_a, self.link_b = link_a[order], link_b[order]
        self.cut_a, self.cut_b = np.sort(cut_a), np.sort(cut_b)
        self.links_to = np.searchsorted(self.link_a, self.after_a)
        self.cuts_to = np.searchsorted(self.cut_a, self.after_a)
        self.own = own

    def groups(self) -> pa.Array:
        """Of each document the ids between its cuts, as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = len(self.a), len(self.b)
        group_a, group_b = np.zeros(n_a + 1, np.int64), np.zeros(n_b + 1, np.int64)
        group_a[self.cut_a + 1], group_b[self.cut_b + 1] = 1, 1
        group_a, group_b = np.cumsum(group_a[:-1]), np.cumsum(group_b[:-1])
        place_a = np.arange(n_a) + np.r_[0, self.cut_b + 1][group_a]
        place_b = np.arange(n_b) + (self.cut_a + 1)[group_b]
        ids, ends = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        ends[place_a[self.cut_a]], ends[place_b[self.cut_b]] = ord("|"), ord(";")
        width = self.own.width[ids]
        spelt = self.own.digits[ids]
        spelt[np.arange(len(ids)), width] = ends
        shown = np.arange(spelt.shape[1]) <= width[:, None]
        tokens_to = self.after_a + self.after_b
        last = tokens_to[1:][np.diff(tokens_to) > 0] - 1
        shown[last, width[last]] = False
        width = width + 1
        width[last] -= 1
        letters = np.r_[0, np.cumsum(width)][tokens_to].astype(np.int32)
        return pa.StringArray.from_buffers(len(letters) - 1, pa.py_buffer(letters), pa.py_buffer(spelt[shown]))

    def pairs(self) -> tuple[pa.Array, pa.Array]:
        """Of each document its different pairs of linked ids (``a << 32 | b``) and how many links each has."""
        doc = np.repeat(np.arange(len(self.links_to) - 1), np.diff(self.links_to))
        size = len(self.own.bytes_a) * len(self.own.bytes_b)
        a, b = self.a[self.link_a], self.b[self.link_b]
        key, times = np.unique(doc * size + a * len(self.own.bytes_b) + b, return_counts=True)
        to = pa.array(np.searchsorted(key, np.arange(len(self.links_to)) * size).astype(np.int32))
        a, b = np.divmod(key % size, len(self.own.bytes_b))
        return (pa.ListArray.from_arrays(to, pa.array(a << 32 | b)),
                pa.ListArray.from_arrays(to, pa.array(times.astype(np.int32))))

    def lists(self, places: np.ndarray, to: np.ndarray, after: np.ndarray) -> pa.Array:
        """Places of tokens, counted from 0 in each document."""
        own = places - np.repeat(after[:-1], np.diff(to))
        return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(own.astype(np.int32)))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          with_links: bool = False) -> DataFrame:
    """Both tokenizations of every text, linked where their byte ranges overlap.

    ``path_a`` is a byte-level tokenizers file, ``path_b`` a sentencepiece model that puts
    a space in front; both lie where every executor can read them. A is given a space and
    the text. Special strings inside texts are plain text. A text that is null or empty,
    or that the bytes of its tokens do not spell, has no tokens. Returns a row per row of
    ``docs``, only the id and the text of which are read: ``row`` (a number of its own),
    the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (ids between cuts, as
    ``a1,a2|b1;a3|b2,b3``), ``pairs`` (different linked ids, ``a << 32 | b``, rising) and
    ``times`` (links of each); if wanted, ``link_a`` and ``link_b``, the places of linked tokens.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", *["link_a", "link_b"] * with_links]
    schema = (f"row long, id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string, "
              "pairs array<long>, times array<int>" + ", link_a array<int>, link_b array<int>" * with_links)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_pair(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES)))
                part = batch.slice(at, stop - at)
                done = Aligned(own, own.encode(part.column(1).to_pylist()))
                columns = [pa.array(np.arange(row, row + part.num_rows)), part.column(0),
                           *(pa.array(np.diff(to)) for to in (done.after_a, done.after_b, done.cuts_to, done.links_to)),
                           done.groups(), *done.pairs()]
                if with_links:
                    columns += [done.lists(done.link_a, done.links_to, done.after_a),
                                done.lists(done.link_b, done.links_to, done.after_b)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row += part.num_rows
                at = stop

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(linked, schema).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked), ``top`` (no other pair of its A id is in more)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def link_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Of every ``row`` that has links ``n_best`` (links whose pair is ``top``) and ``count_sum`` (``n`` over its links).

    Pairs in very many documents are looked up where the documents lie; there are fewer
    than ``HOT`` of them. Only the others are sent to their counts.
    """
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = F.col("n") * HOT > F.lit(total)
    hot = F.broadcast(counts.where(often))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = (F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    near = links.join(hot, "pair").groupBy("row").agg(*sums)
    rest = links.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~often), "pair").groupBy("row").agg(*sums)
    return near.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes of the alignment, how usual its links are, SHA-256 of its groups.

    Returns the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``
    and ``groups_sha256`` (empty without tokens). Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    found = align(docs, path_a, path_b, id_col, text_col).withColumn(
        "groups_sha256", F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise("")).drop("groups")
    stage, counted = scratch_path(spark, "aligned"), scratch_path(spark, "pair-counts")
    found.write.option("compression", "zstd").parquet(stage)
    found = spark.read.parquet(stage)
    pair_counts(found).write.parquet(counted)
    scores = link_scores(found, spark.read.parquet(counted))
    none = F.lit(0).cast("long")
    return found.join(scores, "row", "left").select(
        id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
