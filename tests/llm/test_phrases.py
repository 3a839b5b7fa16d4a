"""Phrase counts and collocations against plain counting."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from backtrail.llm import phrases, queries
from helpers import DOCS, SF_DIR, odd_rows, prose

SPLIT = re.compile("[.,;:!?\n-\r]")


def plain_counts(rows):
    found = defaultdict(Counter)
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        for piece in SPLIT.split(low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in (1, 2, 3):
                found[r["lang"] or "und"].update(" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    return found


def plain_collocations(rows, threshold=10, covered=50, best=2000):
    out = []
    for lang, f in plain_counts(rows).items():
        total = sum(n for p, n in f.items() if " " not in p)
        often = {p: a for p, a in f.items() if a >= threshold and " " in p}
        scored = []
        for p, a in often.items():
            if any(100 * b >= covered * a and len(q) > len(p) and f" {p} " in f" {q} " for q, b in often.items()):
                continue
            w = p.split(" ")
            cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((10**6 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            scored.append((-score, -a, p.encode(), p, left, right))
        for rank, (score, a, _, p, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, p, -a, left, right, total, -score))
    return sorted(out)


def table_of(frame):
    rows = [(k, prose(k % 23, 60 + k % 5, ("en", "de", "fr")[k % 3]).upper() if k % 7 else "The Cat, the cat; the\tcat  sat",
             ("en", "de", "fr", None)[k % 4], None, None) for k in range(160)]
    rows += [(200 + k, f"rare pair{k} comes. new york city! new york city, new york", "en", None, None) for k in range(12)]
    return frame([*rows, *rows[:9], *odd_rows(), (None, "x y z " * 40, "und", None, None)], DOCS)


@pytest.mark.parametrize("cycle,slots", [(3, None), (1, None), (2, 4)])
def test_collocations_equal_plain_counting(frame, monkeypatch, cycle, slots):
    monkeypatch.setattr(phrases, "BATCH_BYTES", 3000)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 5000)
    if slots:  # so few that phrases share them
        monkeypatch.setattr(phrases, "MAX_SLOTS", slots)
    docs = table_of(frame).repartition(5)
    counts = phrases.phrase_counts(docs.withColumnRenamed("source", "n"), cycle=cycle)
    got = sorted(tuple(r) for r in phrases.collocations(counts, best=40).collect())
    wanted = plain_collocations(docs.collect(), best=40)
    assert got == wanted and len({r[0] for r in got}) == 4


def test_counts_are_whole_and_only_of_what_is_frequent(frame):
    docs = table_of(frame).repartition(4)
    plain = plain_counts(docs.collect())
    got = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(docs).where("n > 0").collect()}
    assert got == {(lang, p): n for lang, f in plain.items() for p, n in f.items() if n >= 10}


def test_a_longer_phrase_waits_for_both_its_parts():
    tables = [np.full(1 << 10, 255, np.uint8) for _ in range(2)]
    texts = [b"a b c. a b c"]
    assert [n for n, *_ in phrases.count_texts("en", texts, tables, 0, 2)] == [0, 1]
    ids = phrases._word_hashes("en", [b"a", b"b"])
    tables[0][phrases._slots(ids, 1 << 10)] = 0
    found = {n: (p.to_pylist(), f.tolist()) for n, _, p, f, _ in phrases.count_texts("en", texts, tables, 1, 2)}
    assert found[2] == (["a b"], [2]) and 3 not in found
    assert [n for n, *_ in phrases.count_texts("en", texts, tables, 3, 2)] == []  # it had its cycle


def test_no_rows_and_scores_beyond_64_bits(frame):
    assert phrases.collocations(phrases.phrase_counts(frame([], DOCS))).collect() == []
    big = 4 * 10**15
    counts = frame([("en", 0, "", 9 * 10**15), ("en", 1, "x", big + 7), ("en", 1, "y", big + 1), ("en", 2, "x y", big - 1)],
                   "lang string, n int, phrase string, f long")
    row = phrases.collocations(counts).collect()[0]
    assert row["score"] == 10**6 * (big - 1) ** 2 // ((big + 7) * (big + 1))


def test_query_equals_its_sql(spark):
    got = queries.op13_phrase_collocation(spark, SF_DIR)
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    wanted = duckdb.sql(queries.ORACLE_SQL["op13_phrase_collocation"])
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())
