"""Test items that stand inside documents, found by MinHash containment search.

An item counts as contained in a document that has ``threshold`` or more of its
different shingles. Items are put into classes by size; each class has one sketch
size, just large enough that a document may miss the allowed share of an item's
shingles and must still have one of the sketch: the k shingles with the least hashes
(bottom-k MinHash), k = largest allowed number of missing ones in the class + 1. So the
sketch finds every contained item, however long the document, and documents need no
sketch of their own, in which a short passage would drown. What is found is verified
by counting the item's shingles in the document, all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtrail.session import cut_lineage

WORDS, THRESHOLD = 5, 0.8
#: Item shingles up to this number are sent to every executor (16 bytes each), beyond it joined by shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Documents with a hit that are sent to all texts (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(lowered, r"[^\p{L}\p{N}]+"), "")


def _hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; none if there are fewer."""
    n = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(n < size, F.array().cast("array<bigint>")).otherwise(runs)


def _item(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = WORDS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``item``, ``size`` (words of a shingle), ``h``, ``n`` (different shingles of the item), ``sketched``.

    An item of fewer than ``words`` words is one shingle of all its words; one without
    a word has none and is never found. ``item`` is the id and the hash of the text, so
    that items which share an id, or have none, stay apart.
    """
    own = cut_lineage(items.select(_item(id_col, text_col).alias("item"), words_of(F.col(text_col)).alias("w")))
    rows = None
    for size in range(1, words + 1):  # the last size takes all longer items
        fits = F.size("w") == size if size < words else F.size("w") >= size
        runs = own.where(fits).select("item", F.lit(size).alias("size"), F.explode_outer(_hashes(F.col("w"), size)).alias("h"))
        rows = runs if rows is None else rows.unionByName(runs)
    rows = rows.distinct()
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item")))
    # classes of doubling size; the largest size of a class decides how many may be missing
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    sketch = F.floor(largest - F.ceil(largest * threshold - 1e-9)) + 1
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.xxhash64("h"), "h"))
    return counted.select("item", "size", "h", "n", (place <= sketch).alias("sketched"))


def _doc_shingles(docs: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``id``, ``text_hash``, ``h``: the different shingles of every document, of each size that items have."""
    w = docs.select("id", "text_hash", words_of(F.col("text")).alias("w"))
    hashes = F.concat(*[_hashes(F.col("w"), k) for k in sizes])
    # a plain explode would have the optimizer test the hashes for emptiness below the split of the
    # words, which it would then do once per word
    return w.select("id", "text_hash", F.array_distinct(hashes).alias("hs")).select(
        "id", "text_hash", F.explode_outer("hs").alias("h"))


def _sent(keys: DataFrame) -> DataFrame:
    """Written keys of documents, sent to the texts if they are few; else the join moves the texts."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def contained(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id",
              text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Every document and item of which the document has ``threshold`` or more of the shingles.

    Words are lower-cased runs of letters and digits. Returns ``doc_id``, ``text_hash``
    (of the document, so that rows with one id and different texts stay apart),
    ``item_id``, ``n_shingles``, ``n_found``, ``containment``, once for repeated rows and for
    each different text of an ``item_id``. Null and
    empty texts contain nothing. The search reads the documents once, against the
    sketches; only those with a hit are read again to be verified.
    """
    listed = cut_lineage(item_shingles(items, item_col, text_col, words, threshold))
    total = listed.count()
    sizes = [r[0] for r in listed.select("size").distinct().orderBy("size").collect()] or [words]  # at most `words`
    send = F.broadcast if total <= BROADCAST_SHINGLES else (lambda df: df)
    own = docs.select(F.col(doc_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                      F.col(text_col).alias("text"))
    sketches = listed.where("sketched").select("h").distinct()
    hits = _doc_shingles(own, sizes).join(send(sketches), "h", "left_semi").select("id", "text_hash").distinct()
    hits = cut_lineage(hits.select(F.col("id").alias("hit"), F.col("text_hash").alias("hit_hash")))
    again = own.join(_sent(hits), own["id"].eqNullSafe(hits["hit"]) & (own["text_hash"] == hits["hit_hash"]), "left_semi")
    found = _doc_shingles(again.dropDuplicates(["id", "text_hash"]), sizes).join(
        send(listed.select("h", "item", "n")), "h").groupBy("id", "text_hash", "item").agg(
        F.first("n").alias("n_shingles"), F.count(F.lit(1)).alias("n_found"))
    share = F.col("n_found") / F.col("n_shingles")
    return found.withColumn("containment", share).where(F.col("containment") >= threshold).select(
        F.col("id").alias(doc_col), "text_hash", F.col("item.id").alias(item_col), "n_shingles", "n_found", "containment")


def keep_clean(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
               words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with the columns they came with; repeated rows all stay or go."""
    found = contained(docs.select(doc_col, text_col), items.select("item_id", F.col("text").alias(text_col)),
                      doc_col, "item_id", text_col, words, threshold)
    gone = _sent(cut_lineage(found.select(F.col(doc_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()))
    own = docs.withColumn("__text_hash", F.xxhash64(F.col(text_col)))
    left = own.join(gone, own[doc_col].eqNullSafe(gone["__id"]) & (own["__text_hash"] == gone["__hash"]), "left_anti")
    return left.select(*docs.columns)
