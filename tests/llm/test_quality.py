"""Quality rules and the nearest-neighbour classifier."""

import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from backtrail.llm import quality_neighbours, quality_rules
from helpers import DOCS, WORD, odd_rows, prose


def junk(k):
    r = random.Random(k)
    words = prose(k).split()
    return [" ".join(w + r.choice(["###", "$$$", "&&&"]) for w in words), " ".join([words[0]] * 90),
            " ".join(w.upper() + "!!" for w in words), "\n".join([prose(k, 12)] * 9)][k % 4]


def table(frame, good=60, bad=16):
    rows = [(k, prose(k, 60 + k), "en", "s", 1) for k in range(good)]
    return frame(rows + [(good + k, junk(k), "en", "s", 1) for k in range(bad)] + odd_rows(), DOCS)


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for k, window in enumerate(zip(words, words[1:], words[2:])):
        if seen[window] > 1:
            again |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    kinds = [unicodedata.category(c) for c in text]
    more = (len(lines), kinds.count("Lu"), sum(k[0] in "LM" for k in kinds),
            sum(len(set(words[i:i + quality_rules.STRETCH])) for i in range(0, len(words), quality_rules.STRETCH)),
            sum(a == b for a, b in zip(words, words[1:])), text.count("!"), len(re.findall(r"[#*$%&|<>]+", text)))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), *more)


def test_features_equal_a_plain_count(frame):
    rows = [(k, t, None, None, None) for k, t in enumerate([
        "a b c a b c a", "a a a a a", "x y z\nx y z\n\n \nx y z", "a\x0bb\x0cc\x1cd e", "# $$ <b> |", "a b c d b c d e f b c", "one two", "STOP!! NOW now now ### <<x>> É ñ हिन्दी 12", "w " * 700 + "v"])]
    docs = frame(rows + odd_rows(), DOCS)
    for r in quality_rules.judge(docs).collect():
        text = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"]
        got = tuple(r[n] for n in quality_rules.FEATURES)
        assert got == counted(text), text
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def plain_fit(votes, rounds=50, tolerance=1e-4):
    """The estimation written out over all rows."""
    k = len(votes[0])
    bad = [min(0.95, 0.01 + 0.5 * sum(v == -1 for v in row)) for row in votes]
    old = None
    rate = quality_rules._rate
    for _ in range(rounds):
        b, g = sum(bad), len(votes) - sum(bad)
        prior = min(max(b / len(votes), 1e-3), 0.9)
        table = [[rate(sum(p if of else 1 - p for p, row in zip(bad, votes) if row[j] == sign), b if of else g, bounds) for j in range(k)]
                 for sign, of, bounds in ((-1, 1, quality_rules._BAD_ON_BAD), (-1, 0, quality_rules._BAD_ON_GOOD),
                                          (1, 1, quality_rules._GOOD_ON_BAD), (1, 0, quality_rules._GOOD_ON_GOOD))]
        bad = []
        for row in votes:
            odds = prior / (1 - prior)
            for j, v in enumerate(row):
                odds *= table[0][j] / table[1][j] if v == -1 else table[2][j] / table[3][j] if v == 1 else 1
            bad.append(odds / (1 + odds))
        new = [prior, *(x for t in table for x in t)]
        if old and max(abs(x - y) for x, y in zip(new, old)) < tolerance:
            break
        old = new
    return prior, bad


def test_estimation_equals_a_plain_one(frame):
    measured = quality_rules.with_features(table(frame), "text").drop("text")
    rows = measured.select("doc_id", F.array(*quality_rules.votes()).alias("v")).collect()
    prior, bad = plain_fit([r["v"] for r in rows])
    model = quality_rules.fit(measured)
    got = {r["doc_id"]: r["p_good"] for r in quality_rules.verdicts(measured, model).collect()}
    assert abs(model.prior_bad - prior) < 1e-3
    assert all(abs(got[r["doc_id"]] - (1 - p)) < 1e-3 for r, p in zip(rows, bad))
    texts = {r["doc_id"]: counted(r["text"]) for r in table(frame).collect()}
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(table(frame)).collect()}
    for r, p in zip(rows, bad):  # the posterior decides, and the base
        n, again = texts[r["doc_id"]][0], texts[r["doc_id"]][4]
        assert kept[r["doc_id"]] == (n >= 50 and 100 * again <= 50 * n and p <= 0.5), r["doc_id"]


def test_junk_goes_and_prose_stays(frame):
    docs = table(frame).withColumnRenamed("source", "n_words")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(60)) <= ids and not ids & set(range(60, 76))
    assert ids == {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}


def test_one_bad_vote_does_not_decide(frame):
    r = random.Random(4)
    numbers = " ".join(w if k % 4 else f"{w} {r.randint(10**6, 10**7)}" for k, w in enumerate(prose(900, 150).split()))
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 7))) for _ in range(9000)]
    long = " ".join(words[int(9000 * r.random() ** 2)] for _ in range(100_000))
    hindi = [a + b for a in ("कि", "में", "है", "यह", "नहीं", "और") for b in ("ता", "ने", "की", "ों", "से", "कर", "पु", "दे", "वि", "ली")]
    hindi = " ".join(r.choice(hindi) for _ in range(200))
    docs = table(frame).union(frame([(k, t, "x", "s", 1) for k, t in ((700, numbers), (701, long), (702, hindi))], DOCS))
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).where("doc_id BETWEEN 700 AND 702").collect()}
    assert got[700]["n_letters"] < 0.85 * got[700]["word_chars"]
    assert got[701]["n_words"] == 100_000 and got[701]["n_distinct"] > 0.4 * got[701]["n_words"]
    assert got[702]["n_letters"] == got[702]["word_chars"]
    assert all(not r["base_failed"] and r["kept"] for r in got.values())
    assert {700, 701, 702} <= {r["doc_id"] for r in quality_rules.keep_good(docs).collect()}


def test_the_filter_is_not_moved_below_the_features(frame):
    model = quality_rules.keep_good(table(frame))
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4


def test_empty_and_repeated(frame):
    assert quality_rules.judge(frame([], DOCS)).collect() == []
    assert quality_rules.keep_good(frame([], DOCS)).collect() == []
    twice = frame([(1, prose(1), None, None, None)] * 2, DOCS)
    assert quality_rules.judge(twice).count() == 2


def test_neighbours_on_held_out_texts(frame):
    docs = table(frame, 80, 40)
    learnt = [k for k in range(120) if k // 4 % 2 == 0]  # each kind of junk on either side
    marks = [(k, int(k < 80), 0) for k in learnt] + [(None, 1, 0), (5, None, 0), (0, 1, 0)]
    model = quality_neighbours.fit(docs, frame(marks, "doc_id long, quality int, toxic int"))
    rows = {r["doc_id"]: r for r in quality_neighbours.score(docs.withColumnRenamed("source", "score_"), model).collect()}
    new = [k for k in range(120) if k not in learnt]
    assert sum(rows[k]["predicted"] == (k < 80) for k in new) >= len(new) - 3
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert abs(rows[1000]["score"] - model.prior) < 1e-9 and rows[1000]["score"] == rows[1001]["score"]


def test_neighbours_equal_a_plain_vote(frame):
    docs = table(frame, 30, 12)
    model = quality_neighbours.fit(docs, frame([(k, int(k < 30), 0) for k in range(42)], "doc_id long, quality int, toxic int"))
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    for text, got in zip(texts, model.scores(texts)):
        own = model.latent([text])[0]
        near = sorted(((float(own @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[:quality_neighbours.NEIGHBOURS]
        votes = [(max(c, 0) ** 8, y) for c, y in near]
        wanted = (sum(v * y for v, y in votes) + 1e-6 * model.prior) / (sum(v for v, _ in votes) + 1e-6)
        assert abs(got - wanted) < 1e-3


def test_neighbours_without_labels_or_texts(frame):
    docs = frame(odd_rows(), DOCS)
    none = frame([], "doc_id long, quality int, toxic int")
    model = quality_neighbours.fit(docs, none)
    assert {r["score"] for r in quality_neighbours.score(docs, model).collect()} == {0.5}
    assert quality_neighbours.score(docs.limit(0), model).collect() == []
