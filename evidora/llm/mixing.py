"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS_PER_BUCKET, copied, hash60, numbered, row_of, running_sum, source_key, table, written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The weights of sources in their order, repeating, and the most a source may be repeated.
WEIGHTS, MOST = (1, 2, 3), 3
#: The quality weight of a document without letters.
LEAST = 0.5


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to (skey, source, source_size): the total shared by weight, no source above ``most`` sizes.

    What a capped source leaves is shared among the others by weight until none is above. That has one fixed point:
    with sources in the order of cap over weight, all before some source are capped and the rest share what remains.
    One row per source is sorted in one task.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    place = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place.cast("int") + 1)
    sizes = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = F.sum("source_size").over(every).cast("double")
    sizes = sizes.withColumn("share", (total - capped) / (F.sum("weight").over(every) - weighed))
    open_ = F.col("cap") >= F.col("share") * F.col("weight")
    share = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("share").alias("share")))).over(every)
    target = F.when(open_ | share.isNull(), F.least("cap", F.coalesce(share["share"], F.lit(0.0)) * F.col("weight"))).otherwise(F.col("cap"))
    return sizes.withColumn("target", target).select("skey", "source_size", "target")


def sample_plan(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, skey, h, size, source_size, target, taken, many): documents, with the number of equal rows that take
    the same.

    A source's complete epochs are taken first: each document as often as its target holds the source. For the rest,
    documents are sorted by exponential keys -ln(u) / quality, u from a hash of id and text, quality between LEAST and
    1 from the share of letters; sizes are summed in that order and taken up to the budget, the last document in part.
    Null texts have size 0 and are never taken; sources are ordered by code point, null last; rows equal in id, text
    and source tie: they are counted before they move and some take in full, one in part, the rest nothing of the
    budget. Texts of any length are read whole; other columns are not looked at; no rows give no plan. Reruns agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h = hash60(F.col("doc_id"), F.md5(text.cast("binary")))
    letters, filled = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(F.regexp_replace(text, SPACE, ""))
    quality = LEAST + (1 - LEAST) * F.coalesce(letters / F.when(filled > 0, filled), F.lit(0.0))
    rows = docs.select("doc_id", F.col("source"), source_key(F.col("source")).alias("skey"), h.alias("h"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), quality.alias("quality"))
    rows = rows.groupBy("doc_id", "source", "skey", "h", "size", "quality").agg(F.count("*").alias("count"))
    rows = written(rows, "mixrows")
    n = rows.count()
    sizes = rows.groupBy("skey").agg(F.max("source").alias("source"), F.sum(F.col("size") * F.col("count")).alias("source_size"))
    targets = source_targets(sizes, weights, most)
    u = (F.shiftright("h", 8).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.log(u) / F.col("quality")).withColumn("group_size", F.col("size") * F.col("count"))
    # keys fall at rates from LEAST to 1, so a bucket, of equal shares at the rate LEAST, has at most 1 / LEAST times its share
    buckets = max(1, n // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-LEAST * F.col("key"))) * buckets))
    rows = running_sum(rows, ["skey"], "bucket", ["key", "h", "doc_id"], "group_size", "before")
    plan = rows.join(targets, "skey")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") - epochs * F.col("source_size")).cast("long") - F.col("before"))
    plan = plan.withColumns({"base": epochs * F.col("size"), "left": F.least("group_size", left)})
    full = F.when(F.col("size") > 0, F.expr("left div size")).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("full", full).withColumn("rest", F.col("left") - F.col("full") * F.col("size"))
    part = (F.col("rest") > 0).cast("long")
    shares = F.array(
        F.struct((F.col("base") + F.col("size")).alias("taken"), F.col("full").alias("many")), F.struct((F.col("base") + F.col("rest")).alias("taken"), part.alias("many")),
        F.struct(F.col("base").alias("taken"), (F.col("count") - F.col("full") - part).alias("many")),
    )
    plan = plan.withColumn("share", F.explode(F.filter(shares, lambda x: x["many"] > 0)))
    return plan.select("doc_id", "skey", "h", "size", "source_size", "target", "share.taken", "share.many")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents as the mix takes them: whole copies, and one cut to its first words where the budget ends.

    Columns are those of ``docs``; ``n_chars`` follows a cut text. Documents of which nothing is taken are left out,
    but those without a word stay once. Rows equal in id, text and source are numbered in spans, and as many take each
    amount as the plan says.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plan = sample_plan(docs, weights, most)
    plan = plan.groupBy("h", "skey", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "many"))).alias("shares"), F.sum("many").alias("equal"))  # three shares at most
    plan = written(plan, "shares")
    keyed = docs.select(hash60(F.col("doc_id"), F.md5(text.cast("binary"))).alias("h"), source_key(F.col("source")).alias("skey"), row_of(docs))
    every = keyed.join(plan.filter("equal = 1"), ["h", "skey"]).withColumn("taken", F.expr("shares[0].taken"))
    ties = plan.filter("equal > 1").withColumn("tie", F.concat_ws("|", F.col("h").cast("string"), "skey"))
    if ties.limit(1).count():
        tied = numbered(keyed.join(ties, ["h", "skey"]), "tie", "n").drop("tie")
        tied = tied.withColumn("taken", F.expr("aggregate(shares, struct(0L as seen, -1L as taken), (a, s) -> struct(a.seen + s.many as seen, if(a.taken < 0 and n < a.seen + s.many, s.taken, a.taken) as taken), a -> a.taken)")).drop("n")
        every = every.unionByName(tied)
    whole = F.array_repeat(F.lit(-1).cast("long"), F.expr("cast(if(size = 0, 1L, taken div size) as int)"))
    rest = F.expr("if(size = 0, 0L, taken % size)")
    every = every.withColumn("keep", F.explode(F.when(rest > 0, F.concat(whole, F.array(rest))).otherwise(whole)))
    head = F.expr(r"array_join(slice(regexp_extract_all(row.text, '[^\\x20\\x09-\\x0D]+', 0), 1, cast(keep as int)), ' ')")
    changed = {"text": head} | ({"n_chars": F.length(head).cast("long")} if "n_chars" in docs.columns else {})
    columns = [F.when(F.col("keep") >= 0, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return every.select(*columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's part in the mix: doc_id, size, source_size, target, taken."""
    return copied(sample_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "many"), "many")


OP6_SQL = r"""
WITH r AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
q AS (
  SELECT doc_id, source, h, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         0.5::DOUBLE + 0.5::DOUBLE * coalesce(length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::DOUBLE
           / nullif(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 0), 0) AS quality
  FROM r),
k AS (SELECT *, -ln(((h >> 8)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / quality AS key FROM q),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
s1 AS (
  SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         3.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (
  SELECT *, row_number() OVER o AS place,
         ((SELECT sum(source_size) FROM s0)::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / ((SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM s1 WINDOW o AS (ORDER BY cap / weight, source COLLATE "C" NULLS LAST)),
s3 AS (SELECT arg_min(share, place) AS share FROM s2 WHERE cap >= share * weight),
s AS (
  SELECT s2.source, s2.source_size,
         CASE WHEN s2.cap >= s2.share * s2.weight THEN least(s2.cap, s3.share * s2.weight) ELSE s2.cap END AS target
  FROM s2, s3),
c AS (
  SELECT k.doc_id, k.size, s.source_size, s.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.h, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size)::BIGINT ELSE 0 END AS epochs
  FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM c
"""
