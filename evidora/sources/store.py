"""Versioned Parquet tables: each write is a new version, and the last of a list of small files says which one counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import finite
from ..schemas import CLUSTERED, EDGES, EMBEDDED, EXTRACTED, NODES, TABLES


class Store:
    """Node and edge tables below a path that any Hadoop file system may hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _file(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def _read_text(self, path: str) -> str | None:
        fs, p = self._file(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self, name: str) -> list[int]:
        fs, p = self._file(f"{self.path}/{name}/_versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def latest(self, name: str) -> str | None:
        """What the last commit of this name says; an empty text, as no commit at all, is None."""
        found = self._versions(name)
        return (self._read_text(f"{self.path}/{name}/_versions/{found[-1]:012d}") or None) if found else None

    def commit(self, name: str, text: str) -> None:
        """Write a small file beside its place, then rename it to the next number. No version is ever overwritten, so a
        reader finds the old one or the new one, whatever breaks off; of two writers at once one fails."""
        n = ([0] + self._versions(name))[-1] + 1
        fs, final = self._file(f"{self.path}/{name}/_versions/{n:012d}")
        _, draft = self._file(f"{self.path}/{name}/_versions/.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"{name} was changed by another writer")

    def table(self, name: str) -> DataFrame:
        schema = TABLES[name][1]
        current = self.latest(name)
        if current is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{current}")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows as the next version; readers of the old one go on reading it."""
        columns = [c.split(" ")[0].split(":")[0] for c in self.spark.createDataFrame([], TABLES[name][1]).columns]
        fresh = uuid.uuid4().hex
        rows.select(*columns).write.parquet(f"{self.path}/{name}/{fresh}")
        self.commit(name, fresh)
        return self.table(name)

    def vacuum(self) -> int:
        """Delete rows of versions that no longer count, and work tables; only while nothing reads them."""
        gone = 0
        for name in [*TABLES, *(f"{t}-new" for t in TABLES), "work"]:
            fs, p = self._file(f"{self.path}/{name}")
            keep = {"_versions", self.latest(name) if name in TABLES else None}
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f.getPath().getName() not in keep:
                    gone += fs.delete(f.getPath(), True)
        return gone

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        """Nodes by key: columns that the rows have overwrite, others stay."""
        key, _ = NODES[name]
        return self.replace(name, upserted(self.table(name), rows, key))

    def add_edges(self, name: str, rows: DataFrame) -> DataFrame:
        """Add edges that aren't there yet and return them; existing ones stay as they are."""
        old = self.table(name)
        new = new_edges(old, rows, list(EDGES[name][0]))
        fresh = uuid.uuid4().hex
        new.select(*old.columns).write.parquet(f"{self.path}/{name}-new/{fresh}")
        new = self.spark.read.schema(old.schema).parquet(f"{self.path}/{name}-new/{fresh}")
        self.replace(name, old.unionByName(new))
        return new


def new_edges(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each edge that isn't there yet."""
    return rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A full outer join: where a new row exists its listed columns count, nulls too; the rest is kept."""
    if key not in new.columns:
        raise ValueError(f"rows have no {key}")
    given = new.columns
    new = new.withColumn(key, required(key))
    marked = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in given if c != key], F.lit(True).alias("_new"))
    rows = old.join(marked, old[key] == marked["_k"], "full")
    columns = []
    for c in old.columns:
        if c == key:
            columns.append(F.coalesce(F.col(key), F.col("_k")).alias(key))
        elif c in given:
            columns.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return rows.select(*columns)


def required(*columns: str) -> Column:
    """The first column, or an error where one of them is null."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return F.when(missing, F.raise_error(F.lit(f"payload without {' or '.join(columns)}"))).otherwise(F.col(columns[0]))


def split_payload(rows: DataFrame, key: str, vector: str | None = None) -> DataFrame:
    """(key, props as a struct, vector): rows without a key or vector are an error."""
    props = F.struct(*[c for c in rows.columns if c not in (key, vector)])
    return rows.select(required(*[c for c in (key, vector) if c]).alias(key), props.alias("props"), *([F.col(vector)] if vector else []))


def counted(entities: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Entities with one more mention for each newly created SOURCED_FROM edge."""
    more = new_edges.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("_more"))
    return entities.join(more, "id", "left").withColumn("mention_count", (F.coalesce("mention_count", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("int")).drop("_more")


def without_version(member_of: DataFrame, version: int) -> DataFrame:
    return member_of.filter(F.col("model_version") != version)


def deprecated(clusters: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Clusters, those in ``gone`` (id) marked."""
    rows = clusters.join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    hit = F.col("_gone").isNotNull()
    return rows.withColumns({"deprecated": F.when(hit, True).otherwise(F.col("deprecated")), "deprecated_at": F.when(hit, now).otherwise(F.col("deprecated_at"))}).drop("_gone")


def moved(status: DataFrame, ids: DataFrame, stage: str, now: Column) -> DataFrame:
    """Statuses of the chunks (id) moved on to a stage, errors cleared."""
    hit = ids.select(F.col("id").alias("chunk_id"), F.lit(True).alias("_hit")).distinct()
    rows = status.join(hit, "chunk_id", "left")
    return rows.withColumns({"stage": F.when(F.col("_hit"), stage).otherwise(F.col("stage")), "error": F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("error")), "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}).drop("_hit")


def restored(status: DataFrame, sourced_from: DataFrame) -> DataFrame:
    """Clustered chunks back to EXTRACTED where an entity comes from them, else to EMBEDDED."""
    known = sourced_from.select("chunk_id", F.lit(True).alias("_known")).distinct()
    back = F.when(F.col("_known"), EXTRACTED).otherwise(EMBEDDED)
    return status.join(known, "chunk_id", "left").withColumn("stage", F.when(F.col("stage") == CLUSTERED, back).otherwise(F.col("stage"))).drop("_known")


def pending(chunks: DataFrame, status: DataFrame, stage: str = EMBEDDED, chunk_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks at a stage in the order of their ids; one of them, or the first few."""
    rows = chunks.join(status.filter(F.col("stage") == stage).select(F.col("chunk_id").alias("id")), "id", "left_semi")
    rows = rows.filter(F.col("id") == chunk_id) if chunk_id is not None else rows
    rows = rows.orderBy("id")
    return rows.limit(limit) if limit is not None else rows


def vector_rows(rows: DataFrame, dim: int, strict: bool) -> DataFrame:
    """(id, embedding), nulls left out. ``strict``: another size or a component that isn't finite is an error; else such
    rows are left out."""
    rows = rows.select("id", "embedding").filter("embedding is not null")
    good = (F.size("embedding") == dim) & finite(F.col("embedding"))
    if not strict:
        return rows.filter(good)
    return rows.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("unusable embedding of "), F.col("id")))))


HEAD = 240


def catalog_rows(chunks: DataFrame) -> DataFrame:
    """Chunk fields and the heads of their texts."""
    return chunks.select("id", "doc_id", "section_path", "page_start", "page_end", "token_count", F.substring("text", 1, HEAD).alias("head"))


def catalog(chunks: DataFrame, path: str) -> None:
    """The catalog as JSON lines, in the order of section and id."""
    catalog_rows(chunks).orderBy("section_path", "id").write.mode("overwrite").json(path)
