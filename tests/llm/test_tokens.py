"""Token counts and packing against the library."""

import os
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from backtrail.llm import bpe, packing
from helpers import DOCS, ODD, odd_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = ["a", "B", "'s", "'", " ", "\n", "\x1c", "é", "é", "Σ", "İ", "ß", "１", "漢", "🙂", "<|endoftext|>", "<|",
           "$$$", "\x85", "\u00a0", "ﬁ", "\u0000", "'LL", "Å", "x" * 70]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strange(n):
    r = random.Random(3)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_counts_equal_the_library(library):
    own = bpe.PieceCounter(PATH)
    for text in [*strange(3000), *(prose(k) for k in range(50)), *(t for t in ODD if t)]:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_a_full_memo_changes_nothing(monkeypatch):
    texts = [prose(k) for k in range(30)]
    wanted = list(map(bpe.PieceCounter(PATH).count, texts))
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 20)
    assert list(map(bpe.PieceCounter(PATH).count, texts)) == wanted
    ids = packing.WordIds(PATH)
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 20)
    few = packing.WordIds(PATH)
    assert [few.ids(t) for t in texts] == [ids.ids(t) for t in texts]


def test_word_ids_equal_the_library(library):
    own = packing.WordIds(PATH)
    for text in [*strange(2000), *(t for t in ODD if t)]:
        wanted = b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
        assert own.ids(text) == wanted


def test_token_count_columns(frame, library):
    docs = frame([*odd_rows(), (1, "one two", None, None, 7), (1, "one two", None, None, 7)], DOCS).withColumnRenamed("source", "n_tokens")
    rows = bpe.token_counts(docs, PATH, limit=1000).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = r["text"] or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["over_limit"] == (r["n_tokens"] > 1000)
    assert bpe.token_counts(docs.limit(0), PATH).collect() == []


def test_best_two_fit_trades_the_smallest():
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    sizes = sorted(sorted([6, 3, 2, 2][i] for i in b) for b in bins)
    assert sizes == [[2, 2, 6], [3]]  # greedy would fill 6 + 3
    assert packing.best_two_fit([], 10) == []
    with pytest.raises(ValueError):
        packing.best_two_fit([11], 10)


def test_best_two_fit_packs_all_and_near_the_bound():
    r = random.Random(5)
    lengths = sorted((min(4096, int(r.lognormvariate(6, 1)) + 1) for _ in range(3000)), reverse=True)
    bins = packing.best_two_fit(lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) <= sum(lengths) / 4096 * 1.01 + 1


def test_packing_round_trip(spark, frame, library):
    rows = [(k, prose(k, 20 + 37 * k % 700), None, None, None) for k in range(60)]
    docs = frame([*rows, rows[0], (None, "no id", None, None, None), *odd_rows()], DOCS)
    parts = packing.pieces(docs, PATH, capacity=256, with_ids=True)
    got = packing.pack(parts, docs.count(), capacity=256, group_pieces=40).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) and r["start"] == 256 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
    for doc, found in by_doc.items():
        wanted = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        copies = 2 if doc == 0 else 1
        assert [i for r in sorted(found, key=lambda r: r["piece"])[::copies] for i in r["ids"]] == wanted
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    empty = packing.pack(packing.pieces(docs.limit(0), PATH), 0)
    assert empty.collect() == [] and "sequence_id" in empty.columns
