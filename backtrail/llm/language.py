"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model of four symbols in a row: the lower-cased letters and marks of
its texts, whatever script they are of, and one boundary for all that stands between.
Counts cover every training text and are a Spark table; nothing of them is cut off. The
probabilities of the grams that were seen, and the weights with which contexts back off
to fewer symbols, lie in one array per language, sorted by a 64-bit hash.

All that a gram needs is under its third symbol, so a model falls into slices by that
symbol. Texts are scored against as many slices at a time as ``ENTRIES`` allows; if the
models are larger, in several passes that add up their parts.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.llm.common import shuffle_parts
from backtrail.session import cut_lineage

ORDER = 4
#: The label of texts without a letter.
NONE = "und"
#: Characters that are coded at once; a longer text is coded alone.
_AT_ONCE = 1 << 18
#: Entries of 12 bytes that the tasks are sent for one pass (a slice with more is a pass of its own).
ENTRIES = 6_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POINT = (1 << 21) - 1


@functools.lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point whether it is a letter or mark, and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.array([k in "LM" for k in kinds]), np.array([k == "L" for k in kinds])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _portions(texts: Sequence[str | None] | pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts, lower-cased, in portions of about ``_AT_ONCE`` characters, with the place of the first.

    A text leaves a column of Arrow when its portion is made.
    """
    start, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(((text.as_py() if isinstance(text, pa.Scalar) else text) or "").lower())
        size += len(held[-1])
        if size >= _AT_ONCE:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def _symbols(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts, the places at which a gram ends, and where each text's grams begin among these.

    A run of other characters is one boundary (0). Before a text stand three boundaries,
    behind it one; each symbol after the first three ends one gram.
    """
    pad = ORDER - 1
    points = _points("".join(" " * pad + t + " " for t in texts))
    symbols = np.where(_kinds()[0][points], points, 0)
    sizes = np.array([len(t) + pad + 1 for t in texts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    for k in range(pad):
        keep[starts + k] = True
    begin = (np.cumsum(keep) - 1)[starts]
    kept = symbols[keep].astype(np.uint64)
    own = np.ones(len(kept), dtype=bool)
    for k in range(pad):
        own[begin + k] = False
    return kept, np.flatnonzero(own), np.r_[0, np.cumsum(own)][begin]


def _key(*symbols: np.ndarray) -> np.ndarray:
    """A hash of symbols in a row."""
    found = np.full(len(symbols[0]), len(symbols), np.uint64)
    for s in symbols:
        found = (found ^ (found >> np.uint64(31))) * _MIX + s.astype(np.uint64) + np.uint64(1)
    found = (found ^ (found >> np.uint64(29))) * _MIX
    return found ^ (found >> np.uint64(32))


_CONTEXT = np.uint64(0xA5A5A5A5A5A5A5A5)  # sets the weight of a context apart from the probability of a gram


def _gram_counts(texts: DataFrame) -> DataFrame:
    """How often each language has each gram, over all texts: ``lang``, ``front`` and ``back`` (two symbols each), ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                for _, portion in _portions(batch.column(0).filter(pc.equal(langs.indices, code))):
                    s, at, _ = _symbols(portion)
                    if not len(at):
                        continue
                    _, first, n = np.unique(_key(s[at - 3], s[at - 2], s[at - 1], s[at]), return_index=True, return_counts=True)
                    at = at[first]
                    pair = [(s[at - k] << np.uint64(21) | s[at - k + 1]).astype(np.int64) for k in (3, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), pa.array(pair[0]), pa.array(pair[1]), pa.array(n.astype(np.int64))],
                        names=["lang", "front", "back", "n"])

    return texts.mapInArrow(count, "lang string, front long, back long, n long").groupBy("lang", "front", "back").agg(
        F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[dict[str, list[float]], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Of each language the discounts of 1 to 4 symbols, and how many symbols go before each symbol.

    What comes to the driver is a row for each language and symbol.
    """
    point = F.lit(_POINT)
    three = counts.groupBy("lang", F.col("front").bitwiseAND(point).alias("b"), "back").agg(F.count(F.lit(1)).alias("n"))
    two = three.groupBy("lang", "back").agg(F.count(F.lit(1)).alias("n"))
    one = two.groupBy("lang", F.col("back").bitwiseAND(point).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    few = None
    for order, table in ((4, counts), (3, three), (2, two)):
        part = table.groupBy("lang").agg(F.lit(order).alias("order"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        few = part if few is None else few.unionByName(part)
    ways: dict[str, list[tuple[int, int]]] = {}
    for lang, d, n in one.orderBy("lang", "d").collect():
        ways.setdefault(lang, []).append((d, n))
    last = {lang: (np.array([d for d, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)) for lang, rows in ways.items()}
    found = {lang: [_discount(int((n == 1).sum()), int((n == 2).sum())), 0.0, 0.0, 0.0] for lang, (_, n) in last.items()}
    for lang, order, n1, n2 in few.collect():
        found[lang][order - 1] = _discount(n1, n2)
    return found, last


def _discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one and two else 0.5


def _above(n: np.ndarray, context: np.ndarray, d: float, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of grams that are sorted by context, and the weight of the lower order after each."""
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    group = np.cumsum(np.r_[True, context[1:] != context[:-1]]) - 1
    total = np.add.reduceat(n, starts)
    rest = d * np.diff(np.r_[starts, len(n)]) / total
    return np.maximum(n - d, 0) / total[group] + rest[group] * below, rest


def _slice(front: np.ndarray, back: np.ndarray, n: np.ndarray, discounts: Sequence[float], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and logs of one third symbol: grams of 4, 3 and 2 symbols, weights of their contexts.

    ``alone`` has the probabilities of the last symbols.
    """
    rank = np.lexsort((back, front))
    front, back, n = front[rank], back[rank], n[rank]
    u = np.uint64
    a, b = (front >> 21).astype(u), (front & _POINT).astype(u)
    c, d = (back >> 21).astype(u), (back & _POINT).astype(u)
    three, of3, ways3 = np.unique(np.stack([b, d]), axis=1, return_inverse=True, return_counts=True)
    two, of2, ways2 = np.unique(three[1], return_inverse=True, return_counts=True)
    third = c[:1]

    def wide(x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(third, len(x))

    p2, w2 = _above(ways2, np.zeros(len(two)), discounts[1], alone[np.unique(d, return_index=True)[1]])
    p3, w3 = _above(ways3, three[0], discounts[2], p2[of2.ravel()])
    p4, w4 = _above(n, front, discounts[3], p3[of3.ravel()])
    new3 = np.flatnonzero(np.r_[True, three[0][1:] != three[0][:-1]])
    new4 = np.flatnonzero(np.r_[True, front[1:] != front[:-1]])
    keys = [_key(a, b, c, d), _key(three[0], wide(three[0]), three[1]), _key(wide(two), two),
            _key(a[new4], b[new4], c[new4]) ^ _CONTEXT, _key(three[0][new3], wide(new3)) ^ _CONTEXT, _key(third) ^ _CONTEXT]
    return np.concatenate(keys), np.log2(np.concatenate([p4, p3, p2, w4, w3, w2])).astype(np.float32)


@dataclass(frozen=True)
class Part:
    """What one pass knows of a language: sorted keys and logs, and the third symbols whose grams it answers for."""

    keys: np.ndarray
    logs: np.ndarray
    passes: tuple[np.ndarray, np.ndarray]  # third symbols, sorted, and the pass of each; others belong to pass 0
    alone: tuple[np.ndarray, np.ndarray, float]  # last symbols, their logs, the log of one that was never seen

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is there, and its log (0 if not)."""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return hit, np.where(hit, self.logs[at], 0.0)

    def grams(self, s: Sequence[np.ndarray], number: int) -> np.ndarray:
        """Logs of grams (four arrays of symbols) of this pass, 0 for those of others."""
        a, b, c, d = s
        symbols, of = self.passes
        at = np.minimum(np.searchsorted(symbols, c), max(len(symbols) - 1, 0))
        mine = np.where(symbols[at] == c, of[at], 0) == number if len(symbols) else np.full(len(c), number == 0)
        out = np.zeros(len(c))
        left = np.flatnonzero(mine)
        for order in (4, 3, 2):
            own = [x[left] for x in (a, b, c, d)[4 - order:]]
            hit, log = self.get(_key(*own))
            out[left[hit]] += log[hit]
            left = left[~hit]
            out[left] += self.get(_key(*[x[~hit] for x in own[:-1]]) ^ _CONTEXT)[1]
        last, logs, floor = self.alone
        at = np.minimum(np.searchsorted(last, d[left]), len(last) - 1)
        out[left] += np.where(last[at] == d[left], logs[at], floor)
        return out


@dataclass(frozen=True)
class Model:
    """Models of all languages: the slices as a table, and which pass has which."""

    languages: list[str]
    table: DataFrame  # lang, third, key, log
    passes: dict[str, tuple[np.ndarray, np.ndarray]]
    alone: dict[str, tuple[np.ndarray, np.ndarray, float]]
    count: int

    def part(self, number: int) -> list[Part]:
        """The arrays of one pass: at most ``ENTRIES`` entries, or one slice."""
        own: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        rows = self.table.where(F.col("pass") == number).select("lang", "key", "log").toArrow()
        for lang in self.languages:
            mine = rows.filter(pc.equal(rows.column("lang"), lang))
            keys, logs = mine.column("key").to_numpy().view(np.uint64), mine.column("log").to_numpy()
            rank = np.argsort(keys)
            own[lang] = keys[rank], logs[rank]
        return [Part(*own[lang], self.passes[lang], self.alone[lang]) for lang in self.languages]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Models of all languages in ``docs``; rows without a text or a language teach nothing.

    Counts cover every row and every symbol. None if there is nothing to learn from.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = cut_lineage(_gram_counts(texts.where("text IS NOT NULL AND lang IS NOT NULL")))
    discounts, last = _discounts(counts)
    if not last:
        return None
    symbols = len(np.unique(np.concatenate([d for d, _ in last.values()]))) + 1
    alone = {}
    for lang, (d, n) in last.items():
        rest = discounts[lang][0] * len(n) / n.sum()
        alone[lang] = d, np.log2(np.maximum(n - discounts[lang][0], 0) / n.sum() + rest / symbols), float(np.log2(rest / symbols))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        lang, third = key[0].as_py(), key[1].as_py()
        front, back, n = (table.column(c).to_numpy() for c in ("front", "back", "n"))
        seen, logs, _ = alone[lang]
        place = np.lexsort((back, front))
        d = (back[place] & _POINT).astype(np.uint64)
        keys, values = _slice(front, back, n, discounts[lang], np.exp2(logs[np.searchsorted(seen, d)]))
        return pa.table({"lang": [lang] * len(keys), "third": np.full(len(keys), third), "key": keys.view(np.int64), "log": values})

    sliced = counts.withColumn("third", F.shiftright("back", 21))
    table = cut_lineage(sliced.groupBy("lang", "third").applyInArrow(fit, "lang string, third long, key long, log float"))
    sizes = table.groupBy("lang", "third").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "third").collect()  # a row for each symbol
    number, room, dealt = 0, ENTRIES, []
    for lang, third, n in sizes:
        if n > room and room < ENTRIES:
            number, room = number + 1, ENTRIES
        room -= n
        dealt.append((lang, third, number))
    passes = {}
    for lang in last:
        own = [(t, p) for name, t, p in dealt if name == lang]
        passes[lang] = np.array([t for t, _ in own], np.uint64), np.array([p for _, p in own], np.int64)
    if number:
        spark = docs.sparkSession
        of = spark.createDataFrame(dealt, "lang string, third long, pass int")
        table = table.join(F.broadcast(of), ["lang", "third"]).repartition(shuffle_parts(spark))
    else:
        table = table.withColumn("pass", F.lit(0))
    return Model(sorted(last), table, passes, alone, number + 1)


def entropies(parts: Sequence[Part], number: int, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each text in each language as far as one pass has them, its symbols, and whether it has a letter.

    Each text is added up by itself, so that its bits are the same beside whatever others.
    """
    bits, symbols = np.zeros((len(texts), len(parts))), np.zeros(len(texts), dtype=np.int64)
    lettered = np.zeros(len(texts), dtype=bool)
    for start, portion in _portions(texts):
        s, at, begin = _symbols(portion)
        ends = np.r_[begin[1:], len(at)]
        rows = slice(start, start + len(portion))
        symbols[rows] = ends - begin
        if not len(at):
            continue
        grams = [s[at - k] for k in (3, 2, 1, 0)]
        _, first, of = np.unique(_key(*grams), return_index=True, return_inverse=True)
        kinds = [x[first] for x in grams]
        for k, part in enumerate(parts):
            some = np.flatnonzero(ends > begin)
            bits[start + some, k] = -np.add.reduceat(part.grams(kinds, number)[of], begin[some])
        letter = np.r_[0, np.cumsum(_kinds()[1][grams[3].astype(np.int64)])]
        lettered[rows] = letter[ends] > letter[begin]
    return bits, symbols, lettered


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            keep: Sequence[str] = ()) -> DataFrame:
    """``lang_pred``, ``score``, ``bits`` and ``symbols`` of every text, with the id and the columns ``keep``.

    The language with the fewest bits per symbol is predicted, the first by name of
    equals; ``bits`` is its cross-entropy. ``score`` is its share if two to the minus
    total bits (of at most 20 symbols, so that it stays informative) are shared out. A
    null text, or one without a letter, is ``und`` with score 0. Repeated rows are told
    each; a kept column may not have one of the four names.
    """
    clash = {"lang_pred", "score", "bits", "symbols"} & {id_col, *keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would come twice")
    # a text that is kept as it is goes to the tasks once
    beside = text_col in (id_col, *keep) and docs.schema[text_col].dataType == T.StringType()
    told = docs.select(*dict.fromkeys([id_col, *keep]), (F.lit(None) if beside else F.col(text_col)).cast("string").alias("__text"),
                       F.array_repeat(F.lit(0.0), len(model.languages)).alias("__bits"),
                       F.lit(0).cast("long").alias("symbols"), F.lit(False).alias("__lettered"))
    fields = [f for f in told.schema.fields if f.name not in ("__text", "__bits", "symbols", "__lettered")]
    source = [f.name for f in fields].index(text_col) if beside else len(fields)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields)
    for number in range(model.count):  # one, unless the models are very large
        spread = told.sparkSession.sparkContext.broadcast(model.part(number))

        def add(batches: Iterator[pa.RecordBatch], spread=spread, number=number, last=number + 1 == model.count) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                k = len(fields)
                bits, symbols, lettered = entropies(spread.value, number, batch.column(source))
                before = batch.column(k + 1).flatten().to_numpy().reshape(bits.shape)
                flat = pa.array((before + bits).ravel())
                to = pa.array(np.arange(0, len(flat) + 1, bits.shape[1], dtype=np.int32))
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(k)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j) for j in range(k)), text, pa.ListArray.from_arrays(to, flat), pa.array(symbols), pa.array(lettered)],
                    names=batch.schema.names)

        told = told.mapInArrow(add, schema)
    names = F.array(*[F.lit(x) for x in model.languages])
    per = F.transform("__bits", lambda x: x / F.greatest(F.col("symbols"), F.lit(1)))
    out = told.withColumn("__per", per).withColumn("__low", F.array_min("__per"))
    shares = F.aggregate("__per", F.lit(0.0), lambda total, x: total + F.pow(
        F.lit(2.0), -(x - F.col("__low")) * F.least(F.col("symbols"), F.lit(20))))
    best = F.element_at(names, F.array_position("__per", F.col("__low")).cast("int"))
    lettered = F.col("__lettered")
    return out.select(
        *[F.col(f"`{f.name}`") for f in fields],
        F.when(lettered, best).otherwise(NONE).alias("lang_pred"), F.when(lettered, 1 / shares).otherwise(0.0).alias("score"),
        F.when(lettered, F.col("__low")).otherwise(0.0).alias("bits"),
        F.when(lettered, F.col("symbols")).otherwise(F.lit(0).cast("long")).alias("symbols"))


def _length_class(symbols: Column) -> Column:
    return F.floor(F.log2(F.greatest(symbols, F.lit(1)))).cast("int")


def calibrate(told: DataFrame, lang_col: str = "lang") -> dict[tuple[str, int], float]:
    """Most bits per symbol that pass, by language and length class (powers of two).

    From texts whose prediction is their label: the median plus four times the way to the
    99.9th percentile. A row for each language and class comes to the driver.
    """
    own = told.where(F.col("lang_pred") == F.col(lang_col)).withColumn("size", _length_class(F.col("symbols")))
    found = own.groupBy("lang_pred", "size").agg(
        F.percentile_approx("bits", 0.5, 10_000).alias("mid"), F.percentile_approx("bits", 0.999, 10_000).alias("high"))
    return {(r["lang_pred"], r["size"]): r["mid"] + 4 * (r["high"] - r["mid"]) for r in found.collect()}


def accepted(limits: dict[tuple[str, int], float]) -> Column:
    """Whether a prediction passes: a letter, and bits within the limit of its class.

    A length class of which nothing was learnt rejects nothing.
    """
    size = F.concat_ws(":", "lang_pred", _length_class(F.col("symbols")).cast("string"))
    limit = F.lit(float("inf"))
    if limits:
        pairs = [x for (lang, k), v in sorted(limits.items()) for x in (F.lit(f"{lang}:{k}"), F.lit(float(v)))]
        limit = F.coalesce(F.try_element_at(F.create_map(*pairs), size), limit)
    return (F.col("lang_pred") != NONE) & (F.col("bits") <= limit)


def keep_known(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """Documents whose language is accepted, with the columns they came with.

    Models and limits are learnt from the rows where ``learn`` holds. Without any such
    row nothing can be told and all texts with a letter stay.
    """
    model = train(docs.where(learn), text_col, lang_col)
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    limits = calibrate(predict(docs.where(learn), model, id_col, text_col, [lang_col]), lang_col)
    marked = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns})
    kept = predict(marked, model, f"__own_{id_col}", f"__own_{text_col}", marked.columns).where(accepted(limits))
    return kept.select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])
