"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary file is read, never trained. Texts are cut where its pre-tokenizer
cuts; the pieces repeat so often that each is merged once per worker.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept per worker; a full memo is emptied, which costs time and changes nothing.
MEMO_ENTRIES = 500_000

_WHITE = regex.compile(r"\p{White_Space}+")
_NOT_WHITE = "\x1c\x1d\x1e\x1f"  # str.split() takes these for white space, Unicode does not


def words(text: str) -> list[str]:
    """Pieces between Unicode white space; no token of the vocabulary reaches across it."""
    if any(c in text for c in _NOT_WHITE):
        return [w for w in _WHITE.split(text) if w]
    return text.split()


def lowered(text: str) -> str:
    """Lower case letter by letter, without the special rule for a sigma at the end of a word."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def merge_count(symbols: list[int], ranks: dict[int, int], unions: list[int]) -> int:
    """How many merges happen to symbols in a row; the list is used up.

    ``ranks`` holds the rank of a pair under ``left << 32 | right``, ``unions`` the
    symbol that each rank makes. The heap holds ``rank << 32 | place of the left
    symbol``; an entry whose pair is no longer there is passed over.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = []
    for i in range(n - 1):
        rank = rank_of(symbols[i] << 32 | symbols[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    heapq.heapify(heap)
    merges = 0
    while heap:
        entry = pop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
            continue
        merges += 1
        union = symbols[i] = unions[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(union << 32 | symbols[k])
            if rank is not None:
                push(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] << 32 | union)
            if rank is not None:
                push(heap, rank << 32 | h)
    return merges


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class PieceCounter:
    """Counts the tokens of texts as the library counts them for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.unions = [vocab[a + b] for a, b in pairs]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.markers = tuple(special)
        letters = _byte_letters()
        self.inside = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.by_word: dict[str, int] = {}
        self.by_piece: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Tokens of one piece: its symbols minus the merges."""
        found = self.by_piece.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            symbols = [self.inside[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            found = len(raw) - merge_count(symbols, self.ranks, self.unions)
            if len(piece) < 64:
                if len(self.by_piece) >= MEMO_ENTRIES:
                    self.by_piece.clear()
                self.by_piece[piece] = found
        return found

    def plain(self, word: str) -> int:
        text = lowered(unicodedata.normalize("NFC", word))
        return sum(map(self.piece, self.pieces.findall(text)))

    def word(self, word: str) -> int:
        if any(m in word for m in self.markers):
            found = sum(1 for _ in self.special.finditer(word)) + sum(
                self.plain(part) for part in self.special.split(word) if part)
        else:
            found = self.plain(word)
        if len(word) < 64:
            if len(self.by_word) >= MEMO_ENTRIES:
                self.by_word.clear()
            self.by_word[word] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        found = words(text)
        counts = list(map(self.by_word.get, found))
        if None in counts:
            counts = [self.word(w) if n is None else n for w, n in zip(found, counts)]
        return sum(counts)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    """One per vocabulary file and worker."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a tokenizers file that every executor can read: a
    byte-level model with a splitting pattern. A null text counts as empty, an empty
    one has no tokens. Special strings inside a text are one token each. Columns of
    ``docs`` with the three names are replaced; no row is dropped or moved.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"),
        "n_tokens": counted(F.col(text_col)),
    }).withColumn("over_limit", F.col("n_tokens") > limit)
