"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the (host suffix, path prefix) expressions that could equal a rule. The
expressions meet the rules in an equi-join on a short hash prefix; the full digests are then
compared and the longest confirmed rule decides. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ascii_lower, materialize, named

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: What no rule decides is not on the list, and stays.
DEFAULT_VERDICT = "allow"
#: Longest rule parts that are accepted; they bound the expressions of a URL.
MAX_LABELS, MAX_PATH = 127, 2048
#: Most rules, which bounds what Spark may broadcast: 40 MB of the longest rules.
MAX_RULES = 20_000


def split_url() -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the column url; both empty if it is null or has no ``://``."""
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end")
    return (
        F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def expressions(host: str, path: str, shapes: Iterable[tuple[int, int]]) -> Column:
    """The expressions of a URL for the given (labels of the host, length of the path) shapes.

    A host with too few labels or a path that is too short has no expression of that shape.
    """
    labels = F.size(F.split(F.col(host), r"\.", -1))
    able = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), F.lit(length).alias("length")) for n, length in shapes]),
        lambda shape: (labels >= shape["n"]) & (F.length(path) >= shape["length"]),
    )
    return F.transform(able, lambda shape: F.concat(F.call_function("substring_index", F.col(host), F.lit("."), -shape["n"]), F.substring(F.col(path), F.lit(1), shape["length"])))


def url_filter(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """Return page_id, host, path, rule, verdict for every row of pages.

    A rule fits its host and all its subdomains where the path starts with the rule's. The longest
    rule string wins; a block wins over an allow of the same string. rule is null and verdict is
    the default where none fits. A null URL and one without ``://`` have empty host and path. Repeated
    rows are judged each; other columns of pages are not read; an empty table gives no rows.
    Rules are a parameter of bounded number and length, so what Spark may broadcast does not grow with pages. Of
    hosts, also those of rules, A-Z count as a-z and no other letter changes.
    """
    rules = sorted({(host.translate(LOWER), path, verdict) for verdict, host, path in rules})
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    for host, path, _ in rules:
        if host.count(".") >= MAX_LABELS or len(path) > MAX_PATH:
            raise ValueError(f"rule too long: {host}{path}")
    base = pages.select(named(page_id).alias("page_id"), named(url).alias("url"))
    host, path = split_url()
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    spark = pages.sparkSession
    listed = spark.createDataFrame([(h + p, len(h + p), v) for h, p, v in rules], "rule string, rule_length int, rule_verdict string")
    listed = (
        listed.groupBy("rule", "rule_length")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule_digest", _digest(F.col("rule")))
        .withColumn("short", F.substring("rule_digest", 1, 8))
    )
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    # Every distinct URL is expanded once, however many pages share it. What is found is written, so that Spark knows its
    # size and may split the last join where many pages share a URL.
    found = (
        base.select("host", "path")
        .distinct()
        .withColumn("expression", F.explode(expressions("host", "path", shapes)))
        .withColumn("digest", _digest(F.col("expression")))
        .withColumn("short", F.substring("digest", 1, 8))
        .join(listed, "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rule_length", "rule_verdict", "rule")).alias("best"))
    )
    found = materialize(found, "found")
    return base.join(found, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )


def oracle_sql(rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT_VERDICT) -> str:
    """The same as one SQL statement over pages."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
with r(verdict, h, p) as (values {values}),
u as (
  select page_id,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
s as (
  select page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
d as (select distinct host, path from s),
m as (
  select d.host, d.path, r.h || r.p as rule, r.verdict,
         row_number() over (partition by d.host, d.path order by length(r.h || r.p) desc, r.verdict desc) as k
  from d join r on (d.host = r.h or ends_with(d.host, '.' || r.h)) and starts_with(d.path, r.p))
select s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, '{default}') as verdict
from s left join m on m.host = s.host and m.path = s.path and m.k = 1
"""
