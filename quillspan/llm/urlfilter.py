"""URL filters by a Bloom filter cascade.

The key universe is every key that a url of the corpus could be looked up by: a host suffix at a label bound, a slash-led
path prefix of a length that some rule has. Level 0 is a Bloom filter of the listed keys; level 1 holds level 0's false
positives over the complete universe, level 2 the listed keys that level 1 takes in by mistake, and so on until nothing
is taken in by mistake. The first level without a key tells whether it is listed: exact for every key of the universe,
with no join against the list. The longest listed key of a url decides.

Levels are built by aggregates: keys become bit positions, bit_or folds them into 64-bit words, and only the words of a
filter (BITS_PER_KEY bits for each key it holds) come to the driver. Filters are sent to executors in shards of at most
MAX_BYTES; a larger list is split by key hash into several cascades that are applied one after the other.

Each list (block keys, allow keys, hosts to block when no rule fits) has a cascade of its own, so what a cascade answers is
the verdict; the lists are DataFrames and stay distributed.

Defined cases: a null url or one without `://` has an empty host and path and no rule; urls that no rule fits get the
verdict of the host list; equally long rules: the longer host wins; a key listed for both verdicts blocks; null keys and
other verdicts are ignored; repeated urls and rules change nothing; extra columns are ignored; an empty list gives no rule
anywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import discard, stored

# The rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Hosts blocked with their subdomains when no rule fits.
HOSTS = ["cheap-pills.example.com", "spam-farm.example.org"]

BITS_PER_KEY = 12
HASHES = 6
MAX_BYTES = 32 << 20


def parts(pages: DataFrame, keep: list[str], url: str = "url") -> DataFrame:
    """The columns of keep, host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce({url}, ''), instr(coalesce({url}, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select(*keep, host.alias("host"), path.alias("path"))


def candidates(labels: int, lengths: list[int]) -> Column:
    """Keys a url could be listed by, longest first; labels: the most labels of a listed host, lengths: of listed paths."""
    hosts = f"transform(filter(sequence(1, {max(labels, 1)}), i -> i <= size(split(host, '[.]', -1))), i -> array_join(slice(split(host, '[.]', -1), -i, i), '.'))"
    heads = f"transform(filter(array({', '.join(f'{n}' for n in lengths) or '-1'}), n -> n >= 0 and length(path) >= n), n -> substring(path, 1, n))"
    keys = f"flatten(transform({hosts}, h -> transform({heads}, p -> named_struct('key', concat(h, p), 'n', length(h)))))"
    longest = "array_sort({}, (a, b) -> case when length(a.key) <> length(b.key) then length(b.key) - length(a.key) else b.n - a.n end)"
    return F.expr(f"case when host = '' then array() else transform({longest.format(keys)}, x -> x.key) end").cast("array<string>")


def _hashes(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1] | np.uint64(1)


def positions(keys: pd.Series, level: int, bits: int) -> np.ndarray:
    """[keys, HASHES] bit positions; every level hashes anew."""
    a, b = _hashes(keys + f"\x00{level}") if len(keys) else (np.empty(0, np.uint64),) * 2
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """Levels of (words, bits); the answer for a key is the parity of the first level that doesn't hold it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, int]] = []

    def holds(self, keys: pd.Series, level: int) -> np.ndarray:
        words, bits = self.levels[level]
        p = positions(keys, level, bits)
        return ((words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(1)

    def __contains__(self, key: str) -> bool:
        return bool(self.member(pd.Series([key]))[0])

    def member(self, keys: pd.Series) -> np.ndarray:
        out, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for level in range(len(self.levels)):
            held = self.holds(keys.iloc[left], level)
            out[left[~held]] = level % 2 == 1
            left = left[held]
        out[left] = len(self.levels) % 2 == 1
        return out

    def add(self, keys: DataFrame, n: int) -> None:
        """Adds the level that holds the keys of a frame of n rows."""
        bits, level = max(64, n * BITS_PER_KEY), len(self.levels)

        @F.pandas_udf("array<long>")
        def places(key: pd.Series) -> pd.Series:
            return pd.Series(list(positions(key, level, bits)))

        spots = keys.select(F.explode(places("key")).alias("p"))
        rows = spots.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        words = np.zeros(math.ceil(bits / 64), np.uint64)
        for r in rows.toLocalIterator():  # the filter itself, of a size that n bounds
            words[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
        self.levels.append((words, bits))


def _holding(cascade: Cascade, level: int):
    @F.pandas_udf("boolean")
    def taken(key: pd.Series) -> pd.Series:
        return pd.Series(cascade.holds(key, level))

    return taken


def _listed(cascade: Cascade):
    @F.pandas_udf("array<string>")
    def listed(keys: pd.Series) -> pd.Series:
        size = keys.map(len).to_numpy()
        flat = pd.Series([k for ks in keys for k in ks], dtype=object)
        yes = cascade.member(flat) if len(flat) and cascade.levels else np.zeros(len(flat), bool)
        ends = np.cumsum(size)
        return pd.Series([[k for k, y in zip(flat[e - n : e], yes[e - n : e], strict=True) if y] for e, n in zip(ends, size, strict=True)])

    return listed


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact on the universe; listed and universe: column key, distinct, listed within the universe."""
    cascade = Cascade()
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    n = inside.count()
    held: list[DataFrame] = []
    while n:
        cascade.add(inside, n)
        level = len(cascade.levels) - 1
        wrong = stored(outside.where(_holding(cascade, level)("key")), "cascade")
        held.append(wrong)
        inside, outside, n = wrong, inside, wrong.count()
    discard(listed.sparkSession, *held)
    return cascade


def default_lists(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The rules of the contract (key, verdict) and the hosts blocked when none fits (key)."""
    return spark.createDataFrame(sorted(RULES.items()), "key string, verdict string"), spark.createDataFrame([(h,) for h in HOSTS], "key string")


def cascades(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> list[Cascade]:
    """A cascade for each shard of the listed keys (by key hash), each of at most about max_bytes at its first level."""
    n = listed.count()
    shards = max(1, math.ceil(n * BITS_PER_KEY / 8 / max_bytes))
    mine = lambda df, s: df.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == s) if shards > 1 else df
    return [build(mine(listed, s), mine(universe, s)) if n else Cascade() for s in range(shards)]


def members(found: list[Cascade]) -> Column:
    """Those of the column keys that the cascades hold."""
    own = lambda s: F.expr(f"filter(keys, k -> pmod(xxhash64(k), {len(found)}) = {s})") if len(found) > 1 else F.col("keys")
    return F.concat(*(_listed(c)(own(s)) for s, c in enumerate(found)))


def judge(pages: DataFrame, keep: list[str], rules: DataFrame | None = None, hosts: DataFrame | None = None, max_bytes: int = MAX_BYTES, make=cascades) -> DataFrame:
    """The columns of keep with host, path, rule and verdict.

    rules: key (host and path) and verdict, block or allow; hosts: key, blocked with its subdomains when no rule fits. There
    is a cascade for the block keys, one for the allow keys and one for the hosts, and their answers alone give rule and
    verdict: no list reaches an executor.
    """
    spark = pages.sparkSession
    rules = default_lists(spark)[0] if rules is None else rules
    hosts = default_lists(spark)[1] if hosts is None else hosts
    every = rules.select("key").unionByName(hosts.select("key")).where("key is not null")
    host_part = F.substring_index("key", "/", 1)
    # a rule's host ends at its first slash; a blocked host has an empty path
    shape = every.agg(F.max(F.size(F.split(host_part, "[.]", -1))), F.collect_set(F.length("key") - F.length(host_part))).first()
    split = parts(pages, keep).withColumn("keys", candidates(shape[0] or 1, sorted(shape[1])))
    universe = stored(split.select(F.explode("keys").alias("key")).distinct(), "universe")
    out = split
    for name, listed in (("blocked", rules.where("verdict = 'block'")), ("allowed", rules.where("verdict = 'allow'")), ("hosted", hosts)):
        inside = listed.select("key").distinct().join(universe, "key", "left_semi")
        out = out.withColumn(f"__{name}", members(make(inside, universe, max_bytes)))
    # keys stand longest first; a key listed for both verdicts blocks
    out = out.withColumn("rule", F.expr("try_element_at(filter(keys, k -> array_contains(__blocked, k) or array_contains(__allowed, k)), 1)"))
    verdict = "case when rule is not null then if(array_contains(__blocked, rule), 'block', 'allow') when size(__hosted) > 0 then 'block' else 'allow' end"
    return out.select(*keep, "host", "path", "rule", F.expr(verdict).alias("verdict"))
