"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is the rows it should have over the rows it has. A document's
copies are the inverse Poisson distribution of that mean at a number hashed from its id, so the
draw needs no state, is the same on every run, and no row meets another. Copies are then shuffled by
a hash. Only DataFrame functions are used.

A mean above PART is drawn in parts: a sum of Poisson numbers is one whose mean is the sum of theirs. Parts are dealt over
all partitions before they are drawn, so that no task makes all copies of a document, and the steps of a
part's distribution are few.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, unused

#: Target weights of the production mixture: the hot source is held at a tenth.
WEIGHTS = {"src0": 0.10} | {f"src{i}": 0.90 / 19 for i in range(1, 20)}
SEED = "mix-1"
#: Most sources a mixture may name: with PART it bounds the steps that are broadcast, 2 MB in all.
MAX_SOURCES = 1_000
#: Greatest mean of one draw; parts that a task draws for one row, and numbers of copies that a part has for itself.
PART, PARTS, COPIES = 64, 1_024, 1 << 20


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it no longer changes: the steps of the inverse."""
    if rate <= 0:
        return []
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        if k > rate and out and total <= out[-1]:
            return out
        out.append(total)
        k += 1


def repetition_rates(docs: DataFrame, weights: Mapping[str, float], total: int | None = None, source: str = "source") -> dict[str, float]:
    """Mean copies of a document by source: total * weight / rows of the source.

    total: rows of the mixture, by default as many as the named sources have now. Weights of sources
    without rows are left out and the others scaled up. One row a named source reaches the driver.
    """
    if len(weights) > MAX_SOURCES or any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite, not negative, and at most MAX_SOURCES")
    rows = docs.filter(named(source).isin(*weights)).groupBy(named(source).alias("s")).count().collect() if weights else []
    have = {r["s"]: r["count"] for r in rows}
    whole = sum(weights[s] for s in have)
    wanted = sum(have.values()) if total is None else total
    return {s: wanted * weights[s] / whole / n if whole else 0.0 for s, n in sorted(have.items())}


def _hashed(start: str, rest: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(start), rest)), 1, digits), 16, 10)


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    total: int | None = None,
    seed: str = SEED,
    doc_id: str = "doc_id",
    source: str = "source",
    names: tuple[str, str, str] = ("rate", "copy", "shuffle_key"),
) -> DataFrame:
    """Return docs with each row as often as its draw says, and rate, copy (from 1), shuffle_key.

    A document of a source that weights don't name, or of none, has rate 1. Repeated rows share an id
    and so a draw; a null id hashes as an empty one. Where the rate is above PART, part p (from 0) counts its copies
    from p * COPIES + 1. Other columns pass through, texts whole; columns of docs that have one of the names
    of the three new ones are replaced. Rows are dealt by shuffle_key over all partitions and
    ordered by it in each. An empty table gives no rows.
    """
    rates = repetition_rates(docs, weights, total, source)
    out_rate, out_copy, out_key = names
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    # columns of our own, under names that docs doesn't have
    own = {n: unused(docs.withColumns({m: F.lit(0) for m in names}), f"mix_{n}") for n in ("source", "rate", "parts", "steps", "group", "part", "key", "copy")}
    held = {n: F.col(c) for n, c in own.items()}
    listed = [(s, r, parts, poisson_cdf(r / parts)) for s, r in rates.items() for parts in [max(1, math.ceil(r / PART))]]
    kind = ", ".join(f"{own[n]} {t}" for n, t in (("source", "string"), ("rate", "double"), ("parts", "bigint"), ("steps", "array<double>")))
    # At most MAX_SOURCES rows, which repetition_rates checks, of some 200 steps.
    mixture = F.broadcast(docs.sparkSession.createDataFrame(listed, kind))
    one = F.array(*map(F.lit, poisson_cdf(1.0)))
    rows = docs.join(mixture, named(source).cast("string") == held["source"], "left").withColumns(
        {
            own["rate"]: F.coalesce(held["rate"], F.lit(1.0)),
            own["parts"]: F.coalesce(held["parts"], F.lit(1)),
            own["steps"]: F.coalesce(held["steps"], one),
            own["key"]: F.coalesce(named(doc_id).cast("string"), F.lit("")),
        }
    )
    if any(r > PART for r in rates.values()):
        many = rows.filter(held["parts"] > 1).withColumn(own["group"], F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((held["parts"] - 1) / PARTS))))
        many = many.repartition(F.xxhash64(own["key"], own["group"]))
        first = held["group"] * PARTS
        many = many.withColumn(own["part"], F.explode(F.sequence(first, F.least(first + PARTS, held["parts"]) - 1))).drop(own["group"])
        rows = rows.filter(held["parts"] == 1).withColumn(own["part"], F.lit(0).cast("bigint")).unionByName(many)
    else:
        rows = rows.withColumn(own["part"], F.lit(0).cast("bigint"))
    named_part = F.when(held["part"] == 0, F.lit("")).otherwise(F.concat(F.lit("part"), held["part"].cast("string"), F.lit(":")))
    draw = _hashed(f"{seed}:", F.concat(named_part, held["key"]), 13).cast("double") / F.lit(float(2**52))
    rows = rows.withColumn(own["copy"], F.size(F.filter(held["steps"], lambda step: step <= draw)))
    rows = rows.withColumn(own["copy"], F.explode(F.when(held["copy"] > 0, F.sequence(F.lit(1), held["copy"]))))
    number = held["part"] * COPIES + held["copy"]
    number = number.cast("int") if all(r <= PART for r in rates.values()) else number
    made = rows.select(*map(named, kept), held["rate"].alias(out_rate), number.alias(out_copy), held["key"].alias(own["key"]))
    made = made.withColumn(out_key, _hashed(f"{seed}:order:", F.concat(held["key"], F.lit(":"), named(out_copy).cast("string")), 15).cast("bigint"))
    return made.drop(own["key"]).repartition(named(out_key)).sortWithinPartitions(named(out_key))


def oracle_sql(weights: Mapping[str, float] = WEIGHTS, seed: str = SEED) -> str:
    """The production query as one SQL statement over documents, with the columns that it returns; for rates up to PART."""
    values = ", ".join(f"('{s}', {w!r}::double)" for s, w in weights.items())
    return f"""
with recursive w(source, weight) as (values {values}),
n as (select source, count(*) as n from documents where source in (select source from w) group by source),
r as (
  select n.source, (select sum(n) from n) * weight / (select sum(weight) from w join n using (source)) / n.n as rate
  from n join w using (source)),
steps as (
  select source, rate, 0 as k, exp(-rate) as cdf from r
  union all
  select source, rate, k + 1, cdf + exp(-rate + (k + 1) * ln(rate) - lgamma(k + 2)) from steps where k < 400 + 4 * rate),
d as (
  select *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as u
  from documents),
c as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (select count(*) from (select unnest(l.cdfs) as cdf) where cdf <= d.u) as copies
  from d join (
    select source, list(cdf) as cdfs from steps where k < rate + 40 * sqrt(rate) + 40 group by source
    ) l on l.source = d.source
  union all
  select doc_id, text, lang, source, n_chars, (u >= 0.36787944117144233)::int + (u >= 0.7357588823428847)::int
       + (u >= 0.9196986029286058)::int + (u >= 0.9810118431238462)::int + (u >= 0.9963401531726563)::int
       + (u >= 0.9994058151824183)::int + (u >= 0.999916758850712)::int + (u >= 0.9999897508033253)::int
  from d where source is null or source not in (select source from w))
select doc_id, text, lang, source, n_chars, i::int as copy,
       ('0x' || substr(md5('{seed}:order:' || coalesce(doc_id::varchar, '') || ':' || i), 1, 15))::bigint as shuffle_key
from (select *, unnest(range(1, copies + 1)) as i from c)
"""
