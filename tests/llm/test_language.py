"""Letter models against their definition, and on held-out texts."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from backtrail.llm import language
from helpers import DOCS, odd_rows, prose

KINDS = ("en", "de", "fr")


def docs(frame, per=40):
    rows = [(100 * j + k, prose(k, 15 + 3 * k, kind), kind, "s", 1) for j, kind in enumerate(KINDS) for k in range(per)]
    return frame([*rows, (7, "no label", None, "s", 1), *odd_rows()], DOCS)


def grams(text):
    """Symbols of a text as the module describes them, one gram for each."""
    symbols = [0, 0, 0]
    for c in text.lower() + " ":
        k = ord(c) if unicodedata.category(c)[0] in "LM" else 0
        if k or symbols[-1]:
            symbols.append(k)
    return [tuple(symbols[i - 3:i + 1]) for i in range(3, len(symbols))]


def plain_model(texts, size):
    """Interpolated Kneser-Ney by the textbook, with dictionaries."""
    counts = {4: Counter(g for t in texts for g in grams(t))}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    discount = {}
    for order, found in counts.items():
        one, two = (sum(v == n for v in found.values()) for n in (1, 2))
        discount[order] = one / (one + 2 * two) if one and two else 0.5
    totals = {o: Counter() for o in counts}
    kinds = {o: Counter() for o in counts}
    for order, found in counts.items():
        for g, n in found.items():
            totals[order][g[:-1]] += n
            kinds[order][g[:-1]] += 1

    def p(g):
        order = len(g)
        below = p(g[1:]) if order > 1 else 1 / size
        total = totals[order][g[:-1]]
        if not total:
            return below
        d = discount[order]
        return max(counts[order][g] - d, 0) / total + d * kinds[order][g[:-1]] / total * below

    return p


PROBE = [prose(999, 30, "de"), "zebra, quiz! 12 zzz", "漢字", prose(3, 4, "fr") + "\x00\x00 x", "हिन्दी", ""]


@pytest.mark.parametrize("entries,passes", [(6_000_000, 1), (400, 4)])
def test_entropies_follow_the_definition(frame, monkeypatch, entries, passes):
    monkeypatch.setattr(language, "ENTRIES", entries)
    model = language.train(docs(frame))
    assert model.languages == sorted(KINDS) and model.count >= passes
    found = [language.entropies(model.part(k), k, PROBE) for k in range(model.count)]
    bits, (_, symbols, lettered) = sum(f[0] for f in found), found[0]
    own_texts = {lang: [prose(n, 15 + 3 * n, lang) for n in range(40)] for lang in KINDS}
    size = len({g[3] for texts in own_texts.values() for t in texts for g in grams(t)}) + 1
    for j, lang in enumerate(model.languages):
        p = plain_model(own_texts[lang], size)
        for i, text in enumerate(PROBE):
            own = [p(g) for g in grams(text)]
            assert symbols[i] == len(own)
            assert math.isclose(bits[i, j], -sum(map(math.log2, own)), rel_tol=1e-4, abs_tol=1e-9), (lang, text)
    assert lettered.tolist() == [True] * 5 + [False]
    rows = language.predict(docs(frame), model, keep=["lang"]).where("lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= len(rows) - 2


def test_bits_of_a_text_do_not_depend_on_its_neighbours(frame):
    """A text at the limit of its class would else pass beside some texts only."""
    model = language.train(docs(frame))
    parts = model.part(0)
    texts = [prose(k, 10 + 7 * k, KINDS[k % 3]) for k in range(60)]
    together, _, _ = language.entropies(parts, 0, pa.array(texts))  # a column of Arrow as it comes
    alone = np.concatenate([language.entropies(parts, 0, [t])[0] for t in texts])
    assert (together == alone).all()


def test_a_kept_text_goes_to_the_tasks_once(frame):
    model = language.train(docs(frame))
    out = language.predict(docs(frame), model, keep=["text"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("AS __text") == 1
    sent = out._jdf.queryExecution().optimizedPlan().toString().split("AS __text")[0].rsplit(",", 1)[-1]
    assert sent.strip().startswith("null")
    told = {(r.doc_id, r.lang_pred, r.bits) for r in out.collect()}
    assert told == {(r.doc_id, r.lang_pred, r.bits) for r in language.predict(docs(frame), model).collect()}


def test_probabilities_sum_to_one(frame):
    model = language.train(docs(frame))
    part = model.part(0)[model.languages.index("de")]
    symbols = np.unique(np.concatenate([a[0] for a in model.alone.values()]))
    text, at, _ = language._symbols([prose(3, 20, "de")])
    for k in at[::17].tolist():
        full = [np.full(len(symbols) + 1, s) for s in text[k - 3:k]] + [np.r_[symbols, np.uint64(0x10FFFF)]]
        assert math.isclose(np.exp2(part.grams(full, 0)).sum(), 1, abs_tol=1e-3)


def test_letters_beyond_the_frequent_ones_tell_languages_apart(frame):
    """Two languages of disjoint letters beside a much larger one with fifty others."""
    r = random.Random(4)
    letters = {"large": [chr(0x61 + k) for k in range(26)] + [chr(0xE0 + k) for k in range(23)],
               "one": [chr(0x430 + k) for k in range(16)], "two": [chr(0x440 + k) for k in range(16)]}

    def text(lang):
        return " ".join("".join(r.choices(letters[lang], k=r.randint(2, 8))) for _ in range(30))

    rows = [(k, text(lang), lang, None, None) for lang, many in (("large", 400), ("one", 60), ("two", 60)) for k in range(many)]
    model = language.train(frame(rows, DOCS))
    new = [(k, text(lang), lang, None, None) for lang in ("one", "two") for k in range(100)]
    got = language.predict(frame(new, DOCS), model, keep=["lang"]).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) == 200 and min(x["score"] for x in got) > 0.99


def test_repeated_rows_ties_and_clashing_names(frame):
    rows = [(1, "same text here", lang, None, None) for lang in ("a", "b")] * 3
    model = language.train(frame(rows, DOCS))
    got = language.predict(frame(rows, DOCS), model, keep=["lang"]).collect()
    assert len(got) == 6 and {x["lang_pred"] for x in got} == {"a"} and {round(x["score"], 9) for x in got} == {0.5}
    with pytest.raises(ValueError):
        language.predict(frame(rows, DOCS).withColumnRenamed("source", "bits"), model, keep=["bits"])


def test_held_out_texts_are_told(frame):
    model = language.train(docs(frame))
    new = frame([(j * 50 + k, prose(500 + k, 12, kind), kind, None, None) for j, kind in enumerate(KINDS) for k in range(50)], DOCS)
    rows = language.predict(new, model, keep=["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 147
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts_have_a_defined_answer(frame):
    model = language.train(docs(frame))
    got = {r["doc_id"]: r for r in language.predict(frame(odd_rows(), DOCS), model).collect()}
    assert [got[1000 + k]["lang_pred"] for k in range(4)] == ["und"] * 4 and got[1000]["score"] == 0
    assert got[1004]["lang_pred"] in KINDS  # letters of another script are letters
    assert language.predict(docs(frame).limit(0), model).collect() == []


def test_keeping_the_known(frame):
    table = docs(frame).withColumnRenamed("source", "bits")
    kept = language.keep_known(table, F.col("doc_id") % 3 != 0)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(300))) >= 118 and not ids & {1000, 1001, 1002, 1003}
    none = language.keep_known(table, F.lit(False))
    assert {r["doc_id"] for r in none.collect()} >= set(range(40))
    assert language.keep_known(table.limit(0), F.lit(True)).collect() == []
