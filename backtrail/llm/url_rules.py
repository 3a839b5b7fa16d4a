"""Allow and block rules for addresses, found by a sort-merge range join.

The labels of a host are reversed (``www.example.org`` becomes ``org.example.www.``),
so that a host and all its subdomains are one interval of the sorted keys and the
intervals of two rules are nested or apart. A sorted sweep keeps the rules whose
interval is open on a stack; among those the path decides.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import shuffle_parts

_HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST_PATH, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HOST_PATH, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reversed order, each followed by a dot; empty for an empty host."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(key)


def _end(key: str) -> str | None:
    """The first string behind all that begin with ``key``: ``/`` follows ``.``."""
    return key[:-1] + "/" if key else None


def _cuts(places: DataFrame, parts: int, sample: int) -> list[str]:
    """Places that cut the sorted rows into about equal parts.

    About ``sample`` rows are looked at, chosen by their hash. Cuts only balance the
    work: the result is the same for any of them.
    """
    every = max(1, places.count() // sample)
    seen = sorted(r[0] for r in places.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).collect())
    return sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []


class _Sweep:
    """Rules whose interval holds the current key, outermost first."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, dict[str, str], list[int]]] = []

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, host, {}, []))
        _, _, paths, lengths = self.open[-1]
        if paths.get(path) != "block":  # the same rule twice: block wins
            paths[path] = verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        best = (-1, -1, None, None)
        for _, host, paths, lengths in self.open:
            for n in lengths:
                if n <= len(path) and path[:n] in paths:
                    best = max(best, (len(host) + n, len(host), host + path[:n], paths[path[:n]]),
                               key=lambda b: b[:2])
                    break
        return best[2], best[3]


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow", parts: int | None = None, sample: int = 20_000) -> DataFrame:
    """Judge every address by the longest rule that fits.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). A rule
    fits its host and all subdomains if the path begins with the rule's; an empty host
    fits everywhere. The longest host plus path wins, of equally long ones the longer
    host, of the same rule twice ``block``. Without a rule the verdict is ``default``
    and ``rule`` is null. A null address, or one without ``://``, has an empty host and
    path. Rules with a null field are ignored. Every row of ``urls`` is answered,
    repeated ones each time; only ``id_col`` and ``url_col`` are read.

    Returns the id, ``host``, ``path``, ``rule``, ``verdict``.
    """
    spark = urls.sparkSession
    parts = parts or 4 * shuffle_parts(spark)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).select(
        "id", "host", "path", host_key(F.col("host")).alias("key"))
    # rows of one host are told apart by path and hash, so that a hot host is cut as well
    place = F.concat_ws("\x00", "key", "path", F.hex(F.xxhash64("id", F.monotonically_increasing_id())))
    cuts = _cuts(rows.select(place.alias("place")), parts, sample)

    @F.pandas_udf("int")
    def part_of(places: pd.Series) -> pd.Series:
        return places.map(lambda p: bisect_right(cuts, p)).astype("int32")

    @F.pandas_udf("array<int>")
    def parts_of(keys: pd.Series) -> pd.Series:
        def span(key: str) -> list[int]:
            end = _end(key)
            return list(range(bisect_right(cuts, key), (len(cuts) if end is None else bisect_left(cuts, end)) + 1))
        return keys.map(span)

    listed = rules.select("host", "path", "verdict").dropna().select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    listed = listed.select("host", "path", "verdict", host_key(F.col("host")).alias("key"))
    id_type = rows.schema["id"].dataType
    rule_rows = listed.select(
        F.explode(parts_of("key")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"),
        "host", "path", "verdict")
    url_rows = rows.select(
        part_of(place).alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path",
        F.lit(None).cast("string").alias("verdict"))
    columns = ["part", "key", "kind", "id", "host", "path", "verdict"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = _Sweep(), None
        for batch in batches:
            found_rules, verdicts = [], []
            wanted = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "verdict"))
            for part, key, kind, host, path, verdict in zip(*wanted):
                if part != current:
                    state, current = _Sweep(), part
                if kind == 0:
                    state.add(key, host, path, verdict)
                else:
                    rule, said = state.find(key, path)
                    found_rules.append(rule)
                    verdicts.append(said or default)
            asked = batch.filter(pc.equal(batch.column("kind"), 1))
            yield pa.RecordBatch.from_arrays(
                [asked.column("id"), asked.column("host"), asked.column("path"),
                 pa.array(found_rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"])

    dealt = rule_rows.unionByName(url_rows).repartition("part").sortWithinPartitions("part", "key", "kind")
    schema = f"id {id_type.simpleString()}, host string, path string, rule string, verdict string"
    return dealt.mapInArrow(sweep, schema).withColumnRenamed("id", id_col)


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
