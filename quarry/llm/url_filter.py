"""URL allow and block rules by a cascade of Bloom filters, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Filter bits that go into one plan at most (8 MiB): longer lists take more passes.
MAX_BITS = 1 << 26
#: Share of other keys that the first level of a cascade lets through.
FIRST_RATE = 1 / 1024


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Level:
    bits: bytes
    m: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        def bit(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
            return byte.bitwiseAND(F.element_at(F.lit([1, 2, 4, 8, 16, 32, 64, 128]), (F.pmod(at, F.lit(8)) + 1).cast("int"))) > 0

        return F.forall(positions(key, self.m, self.hashes, self.seed), bit)


def positions(key: Column, m: int, hashes: int, seed: int) -> Column:
    """The bits of a key, an array: two hashes, and steps of the second from the first."""
    pair = F.struct(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(m)).alias("from"), F.pmod(F.xxhash64(key, F.lit(seed), F.lit(1)), F.lit(m)).alias("step"))
    return let(pair, lambda p: F.transform(F.lit(list(range(hashes))), lambda j: F.pmod(p["from"] + p["step"] * j, F.lit(m))))


def shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a filter for n keys."""
    m = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    return m, max(1, round(m / max(n, 1) * math.log(2)))


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The filter of a one-column frame of n keys. Its bytes come from the cluster in
    groups of 64; their number is that of the plan's bound (see passes_for)."""
    m, hashes = shape(n, rate)
    at = keys.select(F.explode(positions(F.col("key"), m, hashes, seed)).alias("at"))
    bytes_ = at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), F.pmod("at", F.lit(8))).cast("int")).alias("value"))
    groups = bytes_.groupBy(F.floor(F.col("byte") / 64).alias("group")).agg(F.collect_list(F.pmod("byte", F.lit(64)) * 256 + F.col("value")).alias("held"))
    bits = bytearray(m // 8 + 65)
    for row in groups.toLocalIterator():
        for x in row["held"]:
            bits[row["group"] * 64 + (x >> 8)] = x & 255
    return Level(bytes(bits), m, hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = FIRST_RATE) -> list[Level]:
    """Levels that together tell exactly which keys of universe are listed.

    listed, universe: frames with one column, key. Level 0 holds the listed keys, level
    1 the keys of the universe that level 0 takes wrongly for listed, level 2 the listed
    keys that level 1 takes wrongly for those, and so on until nobody is mistaken. One
    pass over the universe finds the keys that level 0 lets through; all later levels
    work on those, which are few.
    """
    yes = staged(listed.where(F.col("key").isNotNull()).distinct(), "cascade")
    n = yes.count()
    if not n:
        return []
    levels = [build_level(yes, n, first_rate, 0)]
    through = universe.where(levels[0].has(F.col("key"))).distinct()
    no = staged(through.join(yes, "key", "left_anti"), "cascade")
    sides, counts = [yes, no], [n, no.count()]
    while counts[len(levels) % 2]:
        seed = len(levels)
        mine = seed % 2
        levels.append(build_level(sides[mine], counts[mine], 0.5, seed))
        sides[1 - mine] = staged(sides[1 - mine].where(levels[-1].has(F.col("key"))), "cascade")
        counts[1 - mine] = sides[1 - mine].count()
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for every key of the universe that the levels were built over."""
    verdict = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        verdict = F.when(levels[i].has(key), verdict).otherwise(F.lit(i % 2 == 1))
    return verdict


def passes_for(n: int) -> int:
    """Passes over the urls for n rules: each brings filters of MAX_BITS at most."""
    return max(1, math.ceil(n * math.log(1 / FIRST_RATE) / math.log(2) ** 2 / MAX_BITS))


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    return F.translate(F.coalesce(F.regexp_extract(after, "^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_key(host: Column, path: Column) -> Column:
    """Tells host and path apart whatever they hold."""
    return F.concat(F.length(host).cast("string"), F.lit(":"), host, path)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """What a rule that fits could be, array of struct (key, rule): each suffix of the host
    at a label, with each prefix of the path that is as long as some rule's path. Longest
    first; of equal lengths, that with the longer host first."""
    labels = F.split(host, r"\.", -1)
    hosts = let(labels, lambda of: F.transform(F.sequence(F.lit(1), F.size(of)), lambda i: F.array_join(F.slice(of, i, F.size(of)), ".")))
    paths = F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((-F.length(h) - F.length(p)).alias("a"), (-F.length(h)).alias("b"), rule_key(h, p).alias("key"), F.concat(h, p).alias("rule")))))
    return F.transform(F.array_sort(both), lambda x: F.struct(x["key"].alias("key"), x["rule"].alias("rule")))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages.

    rules: host, path, verdict ("allow" or "block"). A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest wins. A rule that
    is listed with both verdicts blocks; one without host or path fits nothing. Without a
    rule, the verdict is default. A null url and one without :// have empty host and path
    and fit no rule. Repeated rows give repeated results, an empty table none. Columns of
    pages that are called host, path, rule or verdict in any case are replaced, the others
    stay.

    Membership comes from two cascades (allow, block) over all candidate keys of all
    urls: filters that are part of the plan, so no url is joined or shuffled. Their first
    levels have MAX_BITS at most; a longer list is dealt to parts by a hash of the key, and
    each part's cascades take a pass over the urls, which keeps the best rule so far.
    """
    listed = staged(rules.select(rule_key(F.translate(F.col("host"), UPPER, LOWER), F.col("path")).alias("key"), F.length("path").alias("n"), "verdict").where("key IS NOT NULL"), "rules")
    lengths = sorted(r["n"] for r in listed.select("n").distinct().toLocalIterator())
    url = F.col(f"`{url_col}`").cast("string")
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    hosted = pages.select(*own, host_of(url).alias("host"), path_of(url).alias("path"))
    if not lengths:
        return hosted.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    name = fresh(hosted.columns, "first")
    judged = hosted.withColumn(name, F.lit(None).cast("struct<at:int,rule:string,block:boolean>"))
    passes = passes_for(listed.count())
    for part in range(passes):
        mine = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(passes)) == part  # noqa: B023, E731
        keys = candidate_keys(F.col("host"), F.col("path"), lengths)
        universe = judged.select(F.explode(keys).alias("k")).select(F.col("k.key").alias("key")).where(mine(F.col("key")) if passes > 1 else F.lit(True))
        own_rules = listed.where(mine(F.col("key"))) if passes > 1 else listed
        allow, block = (build_cascade(own_rules.where(F.col("verdict") == v).select("key"), universe) for v in ("allow", "block"))

        hit = lambda k, at: F.when(is_listed(block, k["key"]), F.struct(at.alias("at"), k["rule"].alias("rule"), F.lit(True).alias("block"))).when(is_listed(allow, k["key"]), F.struct(at.alias("at"), k["rule"].alias("rule"), F.lit(False).alias("block")))  # noqa: B023, E731
        tested = F.transform(keys, hit if passes == 1 else lambda k, at: F.when(mine(k["key"]), hit(k, at)))
        best = F.get(F.array_compact(tested), F.lit(0))
        old = F.col(name)
        judged = judged.withColumn(name, F.when(old.isNull() | (F.coalesce(best["at"] < old["at"], F.lit(False))), F.coalesce(best, old)).otherwise(old))
        if part + 1 < passes:
            judged = staged(judged, "judged")
    verdict = F.when(F.col(name).isNull(), F.lit(default)).when(F.col(f"{name}.block"), "block").otherwise("allow")
    return judged.select(*[F.col(f"`{c}`") for c in hosted.columns], F.col(f"{name}.rule").alias("rule"), verdict.alias("verdict"))


#: Fixed values of the query's contract: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def url_query(pages: DataFrame) -> DataFrame:
    values = ", ".join(str(r) for r in RULES)
    rules = pages.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rh || rp, length(rh || rp)) AS rule,
       coalesce(arg_max(v, length(rh || rp)), 'allow') AS verdict
FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id
"""
