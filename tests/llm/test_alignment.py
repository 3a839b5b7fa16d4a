"""Alignments against plain overlaps of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from backtrail.llm import alignment
from helpers import DOCS, odd_rows, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁ a", "x\ty\n\nz  q", "<s> and <|endoftext|> stay", " lead and trail ", "tail​\U0001f600 é", "a" * 3000, "  ", "<0x41> b"]


@pytest.fixture(scope="module")
def plain():
    own = alignment.TokenPair(A, B)
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def one(text):
        """Ids of both, links as places, cuts as bytes: by comparing all byte ranges."""
        if not text:
            return [], [], [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spans = []
        for of, sizes in zip(ids, (own.bytes_a, own.bytes_b)):
            ends = [0]
            for i in of:
                ends.append(ends[-1] + len(sizes[i]))
            spans.append(list(zip(ends, ends[1:])))
            if b"".join(sizes[i] for i in of) != (" " + text).encode():
                return [], [], [], []
        links, low = [], 0
        for i, (x, y) in enumerate(spans[0]):
            while spans[1][low][1] <= x:
                low += 1
            j = low
            while j < len(spans[1]) and spans[1][j][0] < y:
                links.append((i, j))
                j += 1
        cuts = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            p, q = [], []
            while i < len(spans[0]) and spans[0][i][1] <= cut:
                p.append(str(ids[0][i]))
                i += 1
            while j < len(spans[1]) and spans[1][j][1] <= cut:
                q.append(str(ids[1][j]))
                j += 1
            groups.append(",".join(p) + "|" + ",".join(q))
        return *ids, links, groups
    return one


def table_of(frame):
    rows = [(k, prose(k % 17, 30 + 9 * k, ("en", "de", "fr")[k % 3]), None, None, None) for k in range(40)]
    rows += [(100 + k, t, None, None, None) for k, t in enumerate(ODD)]
    return frame([*rows, rows[3], (None, rows[4][1], None, None, None), *odd_rows()], DOCS)


def test_links_and_groups_equal_plain_overlaps(frame, plain, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", 7)
    monkeypatch.setattr(alignment, "MEMO_UNITS", 30)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 5000)
    docs = table_of(frame).repartition(3)
    got = Counter()
    for r in alignment.align(docs, A, B, with_links=True).collect():
        got[(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["groups"], tuple(zip(r["link_a"], r["link_b"])))] += 1
        assert r["n_links"] == len(r["link_a"]) == sum(r["times"])
    wanted = Counter()
    for r in docs.collect():
        a, b, links, groups = plain(r["text"])
        wanted[(r["doc_id"], len(a), len(b), len(groups), ";".join(groups), tuple(links))] += 1
    assert got == wanted
    empty = {k[0] for k in wanted if not k[1]}
    assert 100 in empty and 101 not in empty and len(wanted) > 40


@pytest.mark.parametrize("hot", [100_000, 3])
def test_report_equals_plain_counts(frame, plain, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = table_of(frame).withColumnRenamed("source", "row")
    rows = [(r["doc_id"], *plain(r["text"])) for r in docs.collect()]
    counts = Counter()
    for _, a, b, links, _ in rows:
        counts.update({(a[i], b[j]) for i, j in links})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    wanted = Counter()
    for doc, a, b, links, groups in rows:
        ns = [(counts[(a[i], b[j])], best[a[i]]) for i, j in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        wanted[(doc, len(a), len(b), len(groups), len(links), sum(n == m for n, m in ns), sum(n for n, _ in ns), sha)] += 1
    assert Counter(map(tuple, alignment.alignment_report(docs, A, B).collect())) == wanted
    assert alignment.alignment_report(docs.limit(0), A, B).collect() == []


def test_units_give_the_tokens_of_the_whole_text(plain):
    own = alignment.TokenPair(A, B)
    for raw in own.bytes_a + own.bytes_b:  # no token reaches over a single space
        assert not alignment._GAP.search(raw.decode("utf-8", "replace"))
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    r = random.Random(2)
    marks = [" ", " ", "  ", "\n", " \n", "\t ", "\u00a0", " \u3000", "\x1c ", "'s ", ". ", "12", "-", "é", "漢", "\U0001f600", "a", "The", "don't"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for text, (x, y) in zip(texts, own.encode(texts)):
        assert x == b"" or np.frombuffer(x, "<u4").tolist() == a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert y == b"" or np.frombuffer(y, "<u4").tolist() == b.encode(text), repr(text)
        assert (x == b"") == (plain(text)[0] == [])
