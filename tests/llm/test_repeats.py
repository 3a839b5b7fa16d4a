"""Removed bytes against a plain search for strings of earlier documents."""

import random
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from backtrail.llm import queries, repeats
from helpers import DOCS, odd_rows, prose


def plain(rows, length):
    """Runs of every row: by a table of all strings and the least id that has each."""
    order = [(1, 0) if r["doc_id"] is None else (0, r["doc_id"]) for r in rows]
    texts = [(r["text"] or "").encode() for r in rows]
    least = {}
    for o, t in zip(order, texts):
        for i in range(len(t) - length + 1):
            least[t[i:i + length]] = min(o, least.get(t[i:i + length], o))
    out = Counter()
    for r, o, t in zip(rows, order, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i:i + length]] < o:
                gone[i:i + length] = b"\x01" * length
        runs, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(t) if at < 0 else at
            runs.append((a, at))
        out[(r["doc_id"], len(t), tuple(runs), bytes(c for c, g in zip(t, gone) if not g))] += 1
    return out


def table_of(frame):
    r = random.Random(3)
    base = [prose(k, 40 + 20 * k, ("en", "de", "fr")[k % 3]) for k in range(12)]
    rows = list(enumerate(base))
    rows += [(20 + k, t) for k, t in enumerate(base[:4])]  # exact copies
    for k in range(12):  # near copies, passages in other texts, in either order of ids
        w = base[k].split()
        w[len(w) // 2] = "changed"
        at = r.randrange(len(base[k]) // 2)
        rows += [(30 + k, " ".join(w)), (-5 - k, prose(500 + k, 30) + base[k][at:at + 45 + k] + prose(600 + k, 30))]
    rows += [(60, "ab" * 200), (61, "x" + "ab" * 100), (62, "é" * 300), (63, "a" * 49), (64, "a" * 50), (65, "a" * 51)]
    rows += [(None, base[1]), (None, prose(900, 50)), (None, prose(900, 50)), rows[3], (3, base[4] + " other text of one id")]
    rows += [(i, t) for i, t, *_ in odd_rows() if not t or len(t) < 10_000]
    return frame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.mark.parametrize("length,options", [
    (50, {}), (50, {"BLOCK": 3000, "PART": 900, "PHRASES": 200, "SORTED": 2000}), (50, {"HOT": 3, "BLOCK": 700, "PART": 700}),
    (50, {"TOLD": 0}), (30, {"TOLD": 0, "HOT": 2, "GRAM": 20})])
def test_removed_bytes_equal_a_plain_search(frame, monkeypatch, length, options):
    for name, value in options.items():
        monkeypatch.setattr(repeats, name, value)
    docs = table_of(frame).withColumnRenamed("source", "order").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], tuple((x["from"], x["to"]) for x in r["removed"]), bytes(r["kept"]))
                  for r in repeats.remove_repeats(docs, length).collect())
    wanted = plain(docs.collect(), length)
    assert got == wanted
    assert sum(1 for k in wanted if k[2] and k[3]) > 15


def test_no_rows(frame):
    assert repeats.remove_repeats(frame([], DOCS)).collect() == []


def test_a_very_long_text_and_its_copy(frame):
    text = "word " * 40_000 + prose(1, 30_000)
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(frame([(1, text), (2, text + "!"), (3, prose(2, 300))], "doc_id int, text string")).collect()}
    assert rows[1]["removed"] == [] and rows[3]["removed"] == []
    assert [tuple(x) for x in rows[2]["removed"]] == [(0, len(text))] and bytes(rows[2]["kept"]) == b"!"


def test_phrases_cover_all_strings_and_follow_the_text():
    text = prose(4, 3000).encode()
    doc, at, strings, trigger = repeats.parse([text, b"lead " + text, b"x" * 50], 50)
    for k, own in enumerate((text, b"lead " + text, b"x" * 50)):
        mine = doc == k
        assert at[mine].tolist() == (np.cumsum(strings[mine]) - strings[mine]).tolist() and strings[mine].sum() == len(own) - 49
    bytes_of = [{(text if k == 0 else b"lead " + text)[a:a + n + 49] for d, a, n in zip(doc, at, strings) if d == k} for k in (0, 1)]
    assert len(bytes_of[0] & bytes_of[1]) > len(bytes_of[0]) - 4  # an insertion changes the phrases near it only


def test_equal_strings_have_equal_triggers():
    r = random.Random(8)
    text = prose(5, 400).encode()
    places = [r.randrange(len(text) - 50) for _ in range(50)]
    texts = [text, *(prose(900 + k, 5).encode() + text[p:p + 50] + b"#" * (k % 9) for k, p in enumerate(places))]
    doc, at, strings, trigger = repeats.parse(texts, 50)
    of_place = {(d, a + i): t for d, a, n, t in zip(doc.tolist(), at.tolist(), strings.tolist(), trigger.tolist()) for i in range(n)}
    for k, p in enumerate(places):
        assert of_place[(0, p)] == of_place[(k + 1, texts[k + 1].index(text[p:p + 50]))]


def test_a_phrase_of_a_frequent_trigger_is_sent_in_a_few_parts():
    """Not string by string: equal strings of two phrases lie in parts of the same bucket."""
    names = pa.record_batch({"order": pa.array([1, 2]), "text_hash": pa.array([3, 4])})
    pieces = [prose(1, 40).encode()[20:104], prose(1, 40).encode()[30:114]]
    cut = names, np.arange(2), np.array([20, 30]), pieces, np.array([7, 7]), np.array([True, True])
    sent = pa.Table.from_batches(repeats._sent(lambda batch: [cut], 50, 1 << 20)([names]))
    assert 4 <= sum(sent.column("entries").to_pylist()) <= 24  # of 70 strings
    found = pa.concat_tables(repeats._sorted(50)(sent.filter(pc.equal(sent.column("bucket"), b))) for b in pc.unique(sent.column("bucket")))
    again = {(o, a + k) for o, a, n in zip(*(found.column(c).to_pylist() for c in ("order", "at", "strings"))) for k in range(n)}
    assert again == {(2, k) for k in range(30, 55)}


def test_places_that_nobody_asked_for_go_by_their_trigger(spark, monkeypatch):
    """A map that lets all places pass sends each phrase once, not its strings, where one trigger is frequent."""
    rows = [(k, k, (prose(k, 20) + " the passage that stands in all of them, word for word as it is " + prose(k + 500, 20)).encode())
            for k in range(60)]
    docs = spark.createDataFrame(rows, "order long, text_hash long, text binary").coalesce(1)

    def counted(*args, real=repeats._sent):
        def send(batches):
            for batch in real(*args)(batches):
                with open(path, "a") as out:
                    out.write(f"{sum(batch.column('entries').to_pylist())}\n")
                yield batch
        return send

    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/sent"
        monkeypatch.setattr(repeats, "HOT", 20)
        monkeypatch.setattr(repeats, "_sent", counted)
        monkeypatch.setattr(repeats, "slot_bits", lambda slots, size: np.full(size // 8, 255, np.uint8))
        repeats.repeated_runs(docs, 50).collect()
        sent = sum(int(line) for line in open(path))
    phrases = len(repeats.parse([t for _, _, t in rows], 50)[0])
    assert phrases <= sent <= 2.5 * phrases


class Direct:
    """Takes what a frame would run on its batches."""

    def mapInArrow(self, found, schema):
        return found


def dealt_phrases(texts, buckets):
    batch = pa.record_batch({"order": pa.array(range(len(texts)), pa.int64()), "text_hash": pa.array([0] * len(texts), pa.int64()), "text": texts})
    return pa.Table.from_batches(repeats._phrases(Direct(), 50, buckets)(iter([batch])))


def test_triggers_fill_their_buckets_evenly():
    """A trigger is the least of many hashes; by its first bits as they are most phrases would meet in one bucket."""
    trigger = repeats.parse([prose(k, 3000).encode() for k in range(6)], 50)[3]
    counts = np.bincount((trigger >> np.uint64(60)).astype(int), minlength=16)
    assert len(trigger) > 5000 and counts.max() < 1.5 * counts.mean()


def test_rows_of_phrases_grow_with_the_phrases_not_with_blocks_and_buckets(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 2000)
    texts = [prose(k, 60).encode() for k in range(200)]
    rows = dealt_phrases(texts, 64)
    entries, docs = (sum(rows.column(c).to_pylist()) for c in ("entries", "docs"))
    assert len(rows) <= 64 and entries == len(repeats.parse(texts, 50)[0])
    assert docs <= entries  # only documents that have a phrase in the row
    monkeypatch.setattr(repeats, "GATHERED", entries // 4)
    assert 64 < len(dealt_phrases(texts, 64)) <= 4 * 64


def test_phrases_that_share_a_trigger_but_neither_side_are_not_sorted():
    r = random.Random(4)

    def letters(n):
        return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    def kinds(size):
        """Forty passages of this size, each in two texts that have nothing else in common: shared triggers, phrases by kind."""
        texts = [(letters(150) + "#" + middle + "#" + letters(150)).encode() for middle in (letters(size) for _ in range(40)) for _ in range(2)]
        rows = dealt_phrases(texts, 2)
        found = pa.concat_tables(repeats._classified(rows.filter(pc.equal(rows.column("bucket"), b)), 1000) for b in pc.unique(rows.column("bucket")))
        first, second = (repeats.parse(texts[k::2], 50)[3] for k in range(2))
        return len(np.intersect1d(first, second)), Counter(found.column("kind").to_pylist())

    shared, told = kinds(28)
    assert shared > 10 and not told
    shared, told = kinds(60)
    assert shared >= 40 and told[repeats._SORT] >= 80


def test_documents_that_places_are_joined_to_are_sent_together(spark, monkeypatch):
    rows = [(k, k, (prose(k, 20) + " the passage that stands in all of them, word for word as it is " + prose(k + 500, 20)).encode())
            for k in range(60)]
    docs = spark.createDataFrame(rows, "order long, text_hash long, text binary").coalesce(1)

    def counted(*args, real=repeats._sent):
        def send(batches):
            for batch in real(*args)(batches):
                with open(path, "a") as out:
                    out.write(f"{len(batch)}\n")
                yield batch
        return send

    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/sent"
        monkeypatch.setattr(repeats, "TOLD", 0)
        monkeypatch.setattr(repeats, "_sent", counted)
        assert repeats.repeated_runs(docs, 50).count() == 59
        assert len(open(path).readlines()) <= 20  # one for each task, not for each document


def test_a_hash_of_the_text_goes_along_only_where_ids_do_not_tell_it(spark):
    def told(rows):
        own = spark.createDataFrame(rows, "order long, text binary")
        return {(r["order"], r["text"]): r["h"] for r in own.withColumn("h", repeats._told_apart(own)).collect()}

    once = [(k, prose(k, 10).encode()) for k in range(20)]
    assert set(told([*once, once[3]]).values()) == {0}  # a row that comes twice is one text
    found = told([*once, (3, b"another"), (3, b"a third"), (repeats.LAST, b"x"), (repeats.LAST, b"y")])
    assert len({h for (o, _), h in found.items() if o == 3}) == 3 and len({h for (o, _), h in found.items() if o == repeats.LAST}) == 2
    assert sum(h == 0 for h in found.values()) >= 15


def test_suffixes_sort_as_bytes_do():
    data = np.frombuffer((b"abracadabra" * 9 + bytes(range(1, 60))) * 2 + b"\xff" * 60, np.uint8)
    raw = bytes(data)
    for length in (8, 30, 50):
        at = np.arange(0, len(raw) - length + 1)
        order, new = repeats.suffix_array(data, at, length)
        keys = [raw[i:i + length] for i in order]
        assert keys == sorted(keys) and new.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]


def test_query_equals_its_sql(spark, frame, tmp_path):
    table_of(frame).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = duckdb.sql(queries.ORACLE_SQL["op12_repeat_removal"])
    got = queries.op12_repeat_removal(spark, str(tmp_path))
    assert got.columns == wanted.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted.fetchall()))
