"""Operator 4: URL filters as a sort-merge range join.

Hosts are written with their labels reversed, each followed by a comma, and the path behind: `www.example.org/a` becomes
`org,example,www,/a`. The URLs that a rule's host can fit, its subdomains included, then form one interval of keys,
beginning with the reversed host. URLs and rules are cut into ranges of keys, a rule going to every range that its
interval meets; inside a range all are sorted and swept once, a stack holding the rules whose interval is open.
Intervals of hosts are nested or apart, so the stack is as deep as a host has labels with rules. Of the open rules the
longest whose path begins the URL's path decides (longest host, then longest path; of equal rules a block wins).

Range borders come from a bounded number of keys and only steer where rows are judged. One key that fills several
ranges (a hot URL) is dealt over them by row. Null URLs and those without `://` have empty host and path and meet rules
for the empty host only; such a rule fits every host, as all are its subdomains. Repeated rows and rules are judged alike; an empty table gives an empty table. Extra columns
pass through; result columns take names that clash with none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import col, fresh, register, slices, table, with_fields

#: Rules of the registered query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
DEFAULT = "allow"
#: Keys from which the borders of the ranges are taken, at most, and rows of a range, about.
BORDER_KEYS, RANGE_ROWS = 4_096, 50_000
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each followed by a comma; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",")))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, ranges: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """`df` with host, path, rule (or null) and verdict of every row; `rules` has the columns host, path and verdict."""
    spark = df.sparkSession
    names = ("host", "path", "rule", "verdict")
    result = dict(zip(names, fresh(df.columns, *names), strict=True))
    key, place, is_url = fresh([*df.columns, *result.values()], "_key", "_range", "_is_url")
    parsed = df.withColumn(result["host"], host_of(col(url))).withColumn(result["path"], path_of(col(url)))
    keyed = parsed.withColumn(key, F.concat(reversed_host(col(result["host"])), col(result["path"])))
    borders = range_borders(keyed, key, ranges)

    def rule_ranges(keys: pa.Array, uppers: pa.Array) -> list[list[int]]:
        return [list(range(bisect_left(borders, lo), bisect_right(borders, hi) + 1)) for lo, hi in zip(keys.to_pylist(), uppers.to_pylist(), strict=True)]

    # Range i holds the keys from border i - 1 to border i, both included: a key that is a border may lie in several.
    def deal_urls(batches):
        turn = 0
        for batch in batches:
            at = []
            for k in batch.column(key).to_pylist():
                lo, hi = bisect_left(borders, k), bisect_right(borders, k)
                at.append(lo + turn % (hi - lo + 1))
                turn += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, place])

    def deal_rules(batches):
        for batch in batches:
            k, h, p, v = (batch.column(c) for c in range(4))
            at = rule_ranges(k, pa.array([x + _LAST for x in k.to_pylist()], pa.string()))
            index = pa.array([i for i, xs in enumerate(at) for _ in xs], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(index) for c in (k, h, p, v)), pa.array([x for xs in at for x in xs], pa.int32())], names=["k", "rh", "rp", "rv", "at"],
            )

    urls = keyed.mapInArrow(deal_urls, with_fields(keyed, keyed.columns, **{place: "int"}))
    ruled = rules.select(
        reversed_host(F.lower("host")).alias("k"), F.lower("host").alias("rh"), col("path").alias("rp"), col("verdict").alias("rv"),
    ).dropDuplicates().mapInArrow(deal_rules, "k string, rh string, rp string, rv string, at int")
    # Rules take the URL columns' places: null where they have nothing to say.
    as_urls = ruled.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields],
        col("rh").alias(result["host"]), col("rp").alias(result["path"]), col("k").alias(key), col("at").alias(place),
        F.lit(False).alias(is_url), col("rv").alias(result["verdict"]),
    )
    both = urls.withColumns({is_url: F.lit(True), result["verdict"]: F.lit(None).cast("string")}).unionByName(as_urls)
    n = len(borders) + 1
    dealt = both.repartition(n, col(place)).sortWithinPartitions(place, key, is_url)
    kept = [*df.columns, result["host"], result["path"]]

    def sweep(batches):
        stack: list[tuple[str, str, list[tuple[int, int, str, str]]]] = []
        now = None
        for whole in batches:
            for batch in slices(whole, key):
                rows = zip(*(batch.column(c).to_pylist() for c in (place, key, is_url, result["host"], result["path"], result["verdict"])), strict=True)
                mask, found, verdicts = [], [], []
                for at, k, judged, host, path, verdict in rows:
                    if at != now:
                        now, stack = at, []
                    while stack and not k.startswith(stack[-1][0]):
                        stack.pop()
                    mask.append(judged)
                    if not judged:
                        if not stack or stack[-1][0] != k:
                            stack.append((k, host, []))
                        stack[-1][2].append((len(path), verdict == "block", path, verdict))
                        stack[-1][2].sort(reverse=True)
                        continue
                    hit = next(((h + p, v) for _, h, open_rules in reversed(stack) for _, _, p, v in open_rules if path.startswith(p)), (None, default))
                    found.append(hit[0])
                    verdicts.append(hit[1])
                own = batch.select(kept).filter(pa.array(mask, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=[*kept, result["rule"], result["verdict"]])

    schema = with_fields(dealt, kept, **{result["rule"]: "string", result["verdict"]: "string"})
    return dealt.mapInArrow(sweep, schema), result


def range_borders(keyed: DataFrame, key: str, ranges: int | None = None) -> list[str]:
    """Sorted borders that cut the keys into ranges of about RANGE_ROWS rows: quantiles of about BORDER_KEYS keys."""
    n = keyed.count()
    wanted = ranges or -(-n // RANGE_ROWS)
    if wanted < 2:
        return []
    share = BORDER_KEYS / n
    few = keyed.where(F.rand(7) < share) if share < 1 else keyed
    keys = sorted(r[0] for r in few.select(key).limit(2 * BORDER_KEYS).collect())
    return [keys[i * len(keys) // wanted] for i in range(1, min(wanted, len(keys)))]


@register("op4_url_filter", """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, first(h || p ORDER BY length(h) DESC, length(p) DESC) AS rule, first(v ORDER BY length(h) DESC, length(p) DESC) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN fits USING (page_id)""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules)[0].drop("url")
