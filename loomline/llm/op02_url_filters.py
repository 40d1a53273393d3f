"""URL rules by a sort-merge range join.

A host with its labels reversed, each followed by a separator, is a key under which all
subdomains of a host lie in one interval, right after it.  Rules and urls are sorted
together, and one sweep keeps the stack of rules whose interval is still open; they are
nested, so a rule leaves the stack for good when the keys leave its interval.  Ranges of
keys go to the tasks by bounds found beforehand, urls with one host are spread over as many
ranges as they need, and a rule goes to each range that its interval meets.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\x00"


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with its subdomains, where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return reversed_host(self.host)


RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)


def reversed_host(host: str) -> str:
    """Labels from the last to the first, each ended by a separator below all other characters."""
    host = host.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01")
    return "".join(label + END for label in reversed(host.split(".")))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for urls without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _key(host: Column) -> Column:
    safe = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.")), END), F.lit(END))


SALTS = 1_000_000_007


def _bounds(keyed: DataFrame, ranges: int, per_range: int = 40) -> list[tuple[str, int]]:
    """Keys at which ranges begin, from about ``per_range`` rows for each range, drawn from all rows alike.

    Only the balance of the tasks depends on it; no row does.
    """
    if ranges < 2:
        return []
    below = int(SALTS * min(1.0, ranges * per_range / max(1, keyed.count())))
    seen = sorted((r["key"], r["salt"]) for r in keyed.select("key", "salt").where(F.pmod(F.xxhash64("salt"), F.lit(SALTS)) < below).collect())
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []


def _bounds_up_to(bounds: list[tuple[str, int]], key: Column, salt: Column) -> Column:
    """How many bounds are (key, salt) or less, by halving; the bounds are one constant."""
    if not bounds:
        return F.lit(0)
    text = json.dumps([{"key": k, "salt": s} for k, s in bounds])
    listed, sought = F.from_json(F.lit(text), "array<struct<key:string,salt:bigint>>"), F.struct(key.alias("key"), salt.cast("long").alias("salt"))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.coalesce(F.get(listed, n + s - 1) <= sought, F.lit(False)), n + s).otherwise(n))


class Sweep:
    """The open rules above the current key; each level has the rules of one host by path."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, text: str, verdict: str) -> None:
        self._leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        # of two rules with one host and path the one that blocks holds
        if self.stack[-1][1].get(path, ("", "allow"))[1] != "block":
            self.stack[-1][1][path] = (text, verdict)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self._leave(key)
        best = None
        for _, rules in self.stack:
            for n in {len(p) for p in rules}:
                found = rules.get(path[:n]) if n <= len(path) else None
                if found and (best is None or len(found[0]) >= len(best[0])):
                    best = found
        return best


def _sweeper(schema: pa.Schema, default: str):
    def run(batches):
        sweep, at = Sweep(), None
        for batch in batches:
            cols = batch.to_pydict()
            rule, verdict = [], []
            for r, key, is_url, path, text, given in zip(cols["_range"], cols["key"], cols["is_url"], cols["path"], cols["text"], cols["given"], strict=True):
                if r != at:
                    sweep, at = Sweep(), r
                if not is_url:
                    sweep.rule(key, path, text, given)
                    rule.append(None)
                    verdict.append(None)
                    continue
                found = sweep.judge(key, path)
                rule.append(found[0] if found else None)
                verdict.append(found[1] if found else default)
            out = pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )
            yield out.filter(batch.column("is_url"))

    return run


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``rules``: UrlRules, or a DataFrame of (host, path, verdict) of any size.  Of all rules
    that fit a url the longest text wins, and of equally long ones that of the more specific
    host.  Null urls and urls without ``://`` have empty host and path, and the default
    verdict.  Null ids and repeated rows come back as they are; an empty table gives an
    empty result; other columns are not read.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col(url_col))
    # the number of the row in its partition spreads equal urls too
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("salt", salt)
    urls = urls.withColumn("key", _key(F.col("host")))
    bounds = _bounds(urls, ranges)

    # a rule goes to every range that its interval meets, from its own key to the last key below it
    met = F.sequence(_bounds_up_to(bounds, F.col("key"), F.lit(-1)), _bounds_up_to(bounds, F.concat("key", F.lit("\U0010ffff")), F.lit(0)))
    some = F.lit(None)
    left = urls.withColumn("_range", _bounds_up_to(bounds, F.col("key"), F.col("salt"))).select(
        "_range", "key", F.lit(True).alias("is_url"), "page_id", "host", "path", some.cast("string").alias("text"), some.cast("string").alias("given")
    )
    low = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    right = rules.withColumn("host", low).withColumn("key", _key(F.col("host"))).withColumn("_range", F.explode(met)).select(
        "_range", "key", F.lit(False).alias("is_url"), some.cast(pages.schema[id_col].dataType).alias("page_id"), "host", "path",
        F.concat("host", "path").alias("text"), F.col("verdict").alias("given"),
    )
    together = left.unionByName(right).repartitionById(len(bounds) + 1, F.col("_range"))
    ordered = together.sortWithinPartitions("_range", "key", "is_url")
    kind = pages.schema[id_col].dataType.simpleString()
    return ordered.mapInArrow(_sweeper(None, default), f"page_id {kind}, host string, path string, rule string, verdict string")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
