"""URL rules by a sort-merge range join, in DataFrame operations only.

A host is keyed by its labels in reverse, each ended by a slash (no host holds
one): ``m.example.net`` becomes ``net/example/m/``.  A rule's host and all its
subdomains are then one interval of keys, and the intervals of two rules are
nested or apart.  Where an interval starts or ends, the stack of rules active
from there on is known; a sweep in key order hands each page the last stack
before it, and the page takes the longest rule of its stack whose path starts
its own.

The sweep runs in many parts: by the first two labels, and busy parts are dealt
further by a hash of the page.  Each part opens with the stack of its shorter
rules and holds a copy of its own boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table

ALLOW, BLOCK = "allow", "block"
#: parts that hold more than this share of the pages are dealt further; there
#: are at most as many such parts, which bounds the table of them
BUSY = 1024
RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]
AFTER_SLASH = "0"  # the next character: ends the interval of all keys with a prefix


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null urls and urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _part(key: Column) -> Column:
    """First two labels of a key."""
    return F.substring_index(key, "/", 2)


def _n_labels(key: Column) -> Column:
    return F.size(F.split(key, "/")) - 1


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key, stack`` for each rule host: its own rules and those of the hosts above.

    Of equal (host, path) pairs a block wins.
    """
    own = rules.where("host is not null and path is not null and verdict is not null")
    own = own.groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(host_key(F.col("host")).alias("key"), F.struct((F.length("host") + F.length("path")).alias("size"), "host", "path", "verdict").alias("rule"))
    labels = F.split(F.col("key"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "/"), F.lit("/")))
    hosts = own.select("key").distinct().select("key", F.explode(above).alias("up"))
    return hosts.join(own.withColumnRenamed("key", "up"), "up").groupBy("key").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack"))


def _boundaries(stacks: DataFrame) -> DataFrame:
    """``at, depth, stack``: from ``at`` on, that stack is active.

    At one key, ends come before starts, and of several ends the outermost last.
    """
    up = F.transform(F.col("stack"), lambda r: r["host"])
    keys = stacks.select("key", "stack", F.array_distinct(up).alias("hosts"))
    # the stack above a host: its rules without those of the host itself
    outer = F.filter("stack", lambda r: host_key(r["host"]) != F.col("key"))
    starts = keys.select("key", F.col("key").alias("at"), _n_labels(F.col("key")).alias("depth"), "stack")
    ends = keys.select("key", F.concat(F.expr("left(key, length(key) - 1)"), F.lit(AFTER_SLASH)).alias("at"), (-_n_labels(F.col("key"))).alias("depth"), outer.alias("stack"))
    return starts.unionAll(ends)


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """``pages(page_id, url, ...)`` to ``page_id, host, path, rule, verdict``.

    One row per row of ``pages``.  A rule fits its host and all subdomains where
    the path starts with its own; the longest (host and path together, then host)
    wins.  Without a rule, ``rule`` is null and ``verdict`` the default.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    base = base.withColumn("at", host_key(F.col("host"))).withColumn("part", _part(F.col("at")))

    sizes = base.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = max(1, base.count())
    spread = sizes.select("part", F.ceil(F.col("n") * BUSY / total).cast("int").alias("salts"))
    busy = F.broadcast(spread.where("salts > 1"))  # fewer than BUSY rows
    paged = base.join(busy, "part", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")

    stacks = rule_stacks(rules)
    empty = F.array().cast(stacks.schema["stack"].dataType)
    parts = spread.select("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # each part opens with what is active from rules of one label
    tops = stacks.where(_n_labels(F.col("key")) == 1).select(F.col("key").alias("top"), F.col("stack").alias("opening"))
    opened = parts.withColumn("top", F.concat(F.substring_index("part", "/", 1), F.lit("/"))).join(tops, "top", "left")
    opened = opened.select("part", "salt", F.lit("").alias("at"), F.lit(0).alias("depth"), F.coalesce("opening", empty).alias("stack"))
    inner = _boundaries(stacks.where(_n_labels(F.col("key")) > 1)).withColumn("part", _part(F.col("key")))
    inner = parts.join(inner, "part").select("part", "salt", "at", "depth", "stack")

    deep = 1 << 30  # pages come after all boundaries at their key
    events = paged.select("part", "salt", "at", F.lit(deep).alias("depth"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), F.lit(True).alias("page"), "page_id", "host", "path")
    for edge in (opened, inner):
        events = events.unionByName(edge.withColumn("page", F.lit(False)), allowMissingColumns=True)
    sweep = Window.partitionBy("part", "salt").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("page")
    hit = F.get(F.filter("active", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return swept.withColumn("hit", hit).select(
        "page_id", "host", "path", F.concat(F.col("hit.host"), F.col("hit.path")).alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``host, path, verdict`` from a stated list."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def op7_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of the whole pages table by ``RULES``.  Null urls have an empty host and
    path and no rule; repeated rows are judged alike; an empty table gives no rows."""
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, rhost, rpath, rverdict,
    row_number() OVER (PARTITION BY page_id ORDER BY (rhost IS NULL), length(rhost) + length(rpath) DESC, rhost) AS k
  FROM q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
