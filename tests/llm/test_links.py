"""Near-duplicates, benchmark items in documents, and shards."""

import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from backtrail.llm import contamination, shards, simhash
from backtrail.llm.common import with_place
from backtrail.session import cut_lineage
from pyspark.sql import functions as F
from helpers import DOCS, ODD, groups_of, odd_rows, plain_fingerprint, prose


def test_fingerprints_equal_a_plain_count():
    for text in [None, "", "A", "a B", "a b c", "x y z x y z x", "É é\x0bÀ b", *(prose(k, 30) for k in range(20))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_finds_every_link(budget):
    r = np.random.default_rng(budget)
    values = []
    for base in r.integers(0, 2**63, 120, dtype=np.uint64):
        for _ in range(8):
            x = int(base)
            for bit in r.choice(64, r.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            values.append(x)
    values = np.unique(np.array(values, dtype=np.uint64))
    near = [(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1:] if int(a ^ b).bit_count() <= budget]
    wanted = groups_of(near)
    got = groups_of((int(a), int(b)) for k in range(budget + 1) for a, b in zip(*simhash.trie_links(values, simhash._runs(k, budget), budget)))
    assert [wanted(int(v)) for v in values] == [got(int(v)) for v in values]


def test_a_dense_group_and_small_waves(monkeypatch):
    monkeypatch.setattr(simhash, "_WAVE", 50)
    values = np.array([x for x in range(2048)], dtype=np.uint64)
    a, b = simhash.trie_links(values, simhash._runs(1, 3), 3)  # the values differ in the first block only
    find = groups_of((int(x), int(y)) for x, y in zip(a, b))
    assert {find(int(v)) for v in values} == {0} and len(a) == 2047


def near_table(frame):
    base = [prose(k, 200) for k in range(6)]
    rows = [(10 * k + j, t, None, None, None) for k, t in enumerate(base) for j in range(4)]
    rows += [(100 + k, t + " tail", None, None, None) for k, t in enumerate(base)]
    rows += [(200 + k, prose(50 + k, 60 + k), None, None, None) for k in range(20)]
    return frame([*rows, rows[0], (None, base[0], None, None, None), (None, "alone here", None, None, None), *odd_rows()], DOCS)


def test_components_equal_brute_force(frame):
    docs = near_table(frame)
    rows = docs.select("doc_id", "text").collect()
    marks = [plain_fingerprint(r["text"]) for r in rows]
    find = groups_of((a, b) for i, a in enumerate(marks) for b in marks[:i] if (a ^ b).bit_count() <= 3)
    lowest = {}
    for r, m in zip(rows, marks):
        if r["doc_id"] is not None:
            lowest[find(m)] = min(lowest.get(find(m), r["doc_id"]), r["doc_id"])
    wanted = Counter((r["doc_id"], m, lowest.get(find(m))) for r, m in zip(rows, marks))
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == wanted


@pytest.mark.parametrize("options", [{}, {"words": 1}])
def test_one_of_each_group_stays(frame, options):
    docs = near_table(frame).withColumnRenamed("source", "node")
    kept = simhash.keep_first(docs, **options)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs, **options)
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    first = {(r["component_id"], r["fp"] if r["component_id"] is None else 0) for r in found.collect()}
    assert ids == sorted(-1 if c is None else c for c, _ in first)
    assert simhash.keep_first(docs.limit(0), **options).collect() == []


def test_components_of_a_long_path(spark, frame):
    edges = frame([(k, k + 1) for k in range(60)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert simhash.components(edges.limit(0)).collect() == []


def shingles(text, size):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


@pytest.mark.parametrize("keys", [500_000, 0])
def test_items_in_documents_equal_brute_force(spark, frame, monkeypatch, keys):
    monkeypatch.setattr(contamination, "BROADCAST_KEYS", keys)
    items = [(k, prose(700 + k, 8 + 5 * k)) for k in range(12)] + [(50, "Two words"), (51, None), (52, "!!"), (53, "one two three four"),
             (None, prose(800, 30))]
    rows = []
    for k in range(40):
        text = prose(k, 100).split()
        item = (items[k % 12][1]).split()
        if k % 4 == 1:
            item = item[: max(1, len(item) - k % 7)]
        if k % 4 == 2:
            item[len(item) // 2] = "changed"
        at = 30 + k
        rows.append((k, " ".join(text[:at] + item + text[at:]).upper() if k % 3 else " ".join(text[:at] + item), None, None, None))
    rows += [(60, "has TWO, words in it", None, None, None), (60, "another text", None, None, None), (None, prose(800, 30) + " x", None, None, None), rows[4]]
    docs = frame(rows + odd_rows(), DOCS)
    wanted = set()
    for doc, text in ((r[0], r[1]) for r in rows + odd_rows()):
        for item, passage in items:
            n = len([w for w in regex.split(r"[^\p{L}\p{N}]+", (passage or "").lower()) if w])
            own = shingles(passage, min(n, 5)) if n else set()
            found = len(own & shingles(text, min(n, 5))) if own else 0
            if own and found / len(own) >= 0.8:
                wanted.add((doc, item, len(own), found))
    got = contamination.contained(docs, frame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got) == Counter(wanted)
    assert len(wanted) > 15
    clean = contamination.keep_clean(docs.withColumnRenamed("source", "h"), frame(items, "item_id long, text string"))
    left = Counter(r["doc_id"] for r in clean.collect())
    hit = {d for d, *_ in wanted}
    assert left == Counter(r[0] for r in rows + odd_rows() if r[0] not in hit or r[:2] == (60, "another text"))


def test_items_that_share_an_id_stay_apart(frame):
    items = [(1, prose(700, 30)), (1, prose(701, 60)), (None, prose(702, 30)), (None, prose(703, 60)), (1, prose(700, 30))]
    docs = frame([(k, prose(k, 50) + " " + items[k][1], None, None, None) for k in range(4)], DOCS)
    got = contamination.contained(docs, frame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_found"]) for r in got) == Counter([(0, 1, 26), (1, 1, 56), (2, None, 26), (3, None, 56)])
    assert contamination.keep_clean(docs, frame(items, "item_id long, text string")).count() == 0


def test_the_sketch_alone_misses_nothing(frame):
    items = frame([(k, prose(900 + k, n)) for k, n in enumerate((5, 6, 9, 10, 14, 20, 35, 36, 67, 130))], "item_id long, text string")
    rows = contamination.item_shingles(items).collect()
    for item in {r["item"] for r in rows}:
        own = [r for r in rows if r["item"] == item]
        may_miss = max(m for m in range(len(own) + 1) if (len(own) - m) / len(own) >= 0.8)
        assert sum(r["sketched"] for r in own) > may_miss


def test_no_items_or_no_documents(frame):
    docs, items = frame(odd_rows(), DOCS), frame([(1, "a b c d e f")], "item_id long, text string")
    assert contamination.contained(docs, items.limit(0)).collect() == []
    assert contamination.contained(docs.limit(0), items).collect() == []
    assert contamination.keep_clean(docs, items.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("n", [5, 24, 500])
def test_shards_are_even_and_keep_groups(frame, n):
    rows = [(k, "copy" if k % 3 == 0 else f"pair {k // 4}" if k % 3 == 1 else f"own {k}", None, None, None) for k in range(n)]
    rows += [(None, None, None, None, None), (None, "", None, None, None), rows[0]]
    got = shards.assign(frame(rows, DOCS).withColumnRenamed("source", "shard"), 8).collect()
    texts = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    if n == 500:  # only the group that is larger than a shard is spread
        where = {}
        for r in got:
            where.setdefault(r["text_crc32"], set()).add(r["shard"])
        split = [c for c, found in where.items() if len(found) > 1 and c != zlib.crc32(b"copy")]
        assert len(split) <= 3 and len(where[zlib.crc32(b"copy")]) <= 6
    assert shards.assign(frame([], DOCS)).collect() == []


def test_places_have_no_gaps(spark):
    rows = cut_lineage(spark.range(3000).select((F.col("id") % 3).alias("g"), "id"))
    got = with_place(rows, ["g"], [F.col("id")], F.shiftrightunsigned(F.xxhash64("id"), 1), 17).collect()
    for g in range(3):
        assert sorted(r["place"] for r in got if r["g"] == g) == list(range(1000))
