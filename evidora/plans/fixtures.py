"""The driver's tables as the engine's tables.

Documents stand for chunks (``source`` is the document and section, ``doc_id`` the order), vectors for chunks' vectors,
``label`` for clusters, words for entities. Every hundredth row is also a question, with its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import search
from ..sources.work import saved

EVERY, K = 100, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def questions(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return rows.select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def hits(spark, d, k: int = K) -> DataFrame:
    return search.vector_topk(vectors(spark, d), questions(spark, d), k, skip_self=True)


def kind(ident):
    n = F.col(ident).cast("long") % 4
    return F.when(n == 0, "Entity").when(n == 3, "Cluster").otherwise("TextChunk")


def seeds(spark, d) -> DataFrame:
    return hits(spark, d).withColumn("label", kind("id"))


def chunks(spark, d) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc_id"), F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("section_path"), F.col("doc_id").alias("position"), "text")


def word_questions(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.col("doc_id") % EVERY == 0)
    return rows.select(F.col("doc_id").cast("string").alias("query_id"), "text")


def mentions(spark, d) -> DataFrame:
    """(chunk_id, entity_id, position) of all words."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.posexplode(tokens(F.col("text"))).alias("position", "entity_id"))


def words(spark, d) -> tuple[DataFrame, DataFrame | None]:
    """(chunk_id, words) of documents whose id is met once, and of the others, if there are any."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), tokens(F.col("text")).alias("words"))
    again = table(spark, d, "documents").groupBy(F.col("doc_id").cast("string").alias("_id")).count().filter("count > 1").select("_id")
    if not again.limit(1).count():
        return rows, None
    again = saved(again, "again")
    same = rows["chunk_id"].eqNullSafe(again["_id"])
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def edges(spark, d) -> DataFrame:
    """(entity_id, chunk_id): each word of each document once. Only documents that share an id have to meet for that."""
    once, again = words(spark, d)
    rows = once.select(F.explode(F.array_distinct("words")).alias("entity_id"), "chunk_id")
    return rows if again is None else rows.unionByName(again.select(F.explode("words").alias("entity_id"), "chunk_id").distinct())


def counts(spark, d) -> DataFrame:
    """(entity_id, chunk_id, tf): how often a document has a word, from the runs of its words in order."""
    once, again = words(spark, d)
    heads = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == 1) | (F.element_at("s", i) != F.element_at("s", F.greatest(i - 1, F.lit(1)))))
    rows = once.filter("size(words) > 0").select("chunk_id", F.sort_array("words").alias("s")).select("chunk_id", "s", heads.alias("heads"))
    ends = F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array(F.size("s") + 1))
    runs = F.arrays_zip("heads", ends.alias("ends"))
    rows = rows.select("chunk_id", "s", F.explode(runs).alias("run"))
    rows = rows.select(F.element_at("s", F.col("run.heads")).alias("entity_id"), "chunk_id", (F.col("run.ends") - F.col("run.heads")).cast("long").alias("tf"))
    if again is None:
        return rows
    return rows.unionByName(again.select(F.explode("words").alias("entity_id"), "chunk_id").groupBy("entity_id", "chunk_id").agg(F.count("*").alias("tf")))


#: Words, those of most documents, whose largest counts go to all tasks, so that their rows needn't move.
FREQUENT = 50_000


def sourced_from(spark, d) -> DataFrame:
    """(entity_id, chunk_id, confidence): how often a document has the word, over the most that any has it.

    The rows of frequent words, four in five, stay where they are; the others meet their words' largest counts."""
    tf = saved(counts(spark, d), "mentions")
    top = saved(tf.groupBy("entity_id").agg(F.max("tf").alias("most"), F.count("*").alias("df")), "words")
    frequent = F.broadcast(saved(top.orderBy(F.desc("df"), "entity_id").limit(FREQUENT).select("entity_id", "most"), "frequent"))
    known = tf.join(frequent, "entity_id", "left")
    rare = known.filter("most is null").drop("most").join(top.select("entity_id", "most"), "entity_id")
    rows = known.filter("most is not null").unionByName(rare)
    return rows.select("entity_id", "chunk_id", (F.col("tf") / F.col("most")).alias("confidence"))


def memberships(spark, d, found: DataFrame | None = None) -> DataFrame:
    """(query_id, id, p): the share of each label among a question's hits."""
    found = hits(spark, d) if found is None else found
    rows = found.join(vectors(spark, d).select("id", "label"), "id")
    return rows.groupBy("query_id", F.col("label").cast("string").alias("id")).agg((F.count("*") / float(K)).alias("p"))
