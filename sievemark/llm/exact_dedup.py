"""Exact dedup: stateful streaming deduplication.

A narrow table (digest, stable id, content locator) of the documents is a stream's source. The stream's keyed state, in
RocksDB on the executors' disks with its checkpoint in the shared folder, holds for every digest the first arrival's id
and locator. No watermark is set, so nothing expires. Rows whose digest the state already holds are hits; the bytes of
both texts are then fetched by their locators and compared in full, so a collision of digests removes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import bloom
from sievemark.llm.common import exists, materialise, shared_dir, table

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY_SCHEMA = "run long, digest binary, doc_id string, ord long, file string, pos long"
_FIRST = "digest binary, run long, none boolean, ord long, file string, pos long, n long"
#: Copies of one text that a task compares with the first of them; a larger group is parted among tasks.
SALT = 4096


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, rows of one struct ``d`` with the locator ``file``, ``pos``). Documents that aren't read from files are written first."""

    def of(df: DataFrame) -> DataFrame:
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("d"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"))

    try:
        got = of(docs)
        got.schema  # noqa: B018  analysis
        return docs, got
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
            raise
        docs = materialise(docs, "documents")
        return docs, of(docs)


def first_seen(arrivals: DataFrame) -> DataFrame:
    """The stateful operator: per digest the first arrival and the number of arrivals so far, in update mode.

    Order of arrival is (run, ord, file, pos), so that a first arrival is never displaced by a later run.
    """
    rank = F.struct("run", F.col("ord").isNull().alias("none"), "ord", "file", "pos")
    return arrivals.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))


def stream_groups(spark: SparkSession, source: str, state: str) -> DataFrame:
    """The digests of the folder ``source`` that came again since the checkpoint in ``state`` was last used, or came more than
    once since then: (digest, run, none, ord, file, pos) of the first arrival, n arrivals so far."""
    out = shared_dir(spark, "dedup-updates")
    own = spark.newSession()  # the state store's setting stays out of the caller's session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = first_seen(own.readStream.schema(_KEY_SCHEMA).parquet(source))

    def keep(batch: DataFrame, number: int) -> None:
        batch.filter("n > 1").select("digest", "first.*", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    # a digest that repeats in several batches is in each batch's update, always with the same first arrival
    if not exists(spark, out):
        return spark.createDataFrame([], _FIRST)
    k = F.max(F.struct("n", "run", "none", "ord", "file", "pos")).alias("k")
    return spark.read.schema(_FIRST).option("basePath", out).parquet(f"{out}/batch=*").groupBy("digest").agg(k).select("digest", "k.run", "k.none", "k.ord", "k.file", "k.pos", "k.n")


def _hits(docs: DataFrame, kept: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(located documents, hits checked in full: digest, doc_id, kept_doc_id, file, pos)."""
    spark = docs.sparkSession
    docs, rows = located(docs)
    text, key = F.col("d.text").cast("string"), F.col("d.doc_id").cast("long")
    digest = F.unhex(F.sha2(F.encode(text, "utf-8"), 256))
    folder = kept or shared_dir(spark, "dedup")
    source = f"{folder}/arrivals"
    run = spark.read.schema(_KEY_SCHEMA).parquet(source).agg(F.max("run")).first()[0] if exists(spark, source) else None
    run = 0 if run is None else run + 1
    new = rows.filter(text.isNotNull()).select(F.lit(run).cast("long").alias("run"), digest.alias("digest"), F.col("d.doc_id").cast("string").alias("doc_id"), key.alias("ord"), "file", "pos")
    new.write.mode("append").parquet(source)
    firsts = stream_groups(spark, source, f"{folder}/state").select("digest", F.col("run").alias("first_run"), F.col("ord").alias("kept_doc_id"), F.col("file").alias("first_file"), F.col("pos").alias("first_pos"), "n")
    arrivals = spark.read.schema(_KEY_SCHEMA).parquet(source).filter(F.col("run") == run).select("digest", "ord", "file", "pos")
    hits = arrivals.join(firsts, "digest").filter((F.col("first_run") < run) | (F.col("file") != F.col("first_file")) | (F.col("pos") != F.col("first_pos")))
    hits = materialise(hits.select("digest", "ord", "kept_doc_id", "file", "pos", "first_run", "first_file", "first_pos", "n"), "dedup-hits")
    content = rows.select("file", "pos", text.alias("text"))
    older = [r[0] for r in hits.filter(F.col("first_run") < run).select("first_file").distinct().collect()]  # a row a file at most
    first_content = content
    if older:
        first_content = content.union(spark.read.parquet(*older).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"), F.col("text").cast("string").alias("text")))
    # the filters keep what isn't a hit or a first text out of the shuffle of texts; copies meet their first text in parts of SALT
    parts = F.ceil(F.col("n") / SALT).cast("long")
    places = hits.select("digest", F.col("first_file").alias("file"), F.col("first_pos").alias("pos"), parts.alias("parts")).distinct()
    first = bloom.narrowed(first_content, places.select("file", "pos"), ["file", "pos"]).join(places, ["file", "pos"]).dropDuplicates(["file", "pos"])
    first = first.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.col("text").alias("first_text"))
    rest = bloom.narrowed(content, hits.select("file", "pos"), ["file", "pos"]).join(hits.withColumn("salt", F.pmod(F.xxhash64("file", "pos"), parts)), ["file", "pos"])
    same = rest.join(first, ["digest", "salt"]).filter(F.encode("text", "utf-8") == F.encode("first_text", "utf-8"))
    return rows, same.select(F.col("ord").alias("doc_id"), "kept_doc_id", "file", "pos")


def duplicates(docs: DataFrame, state: str | None = None) -> DataFrame:
    """(doc_id, kept_doc_id): a row for every document whose text equals, byte for byte, that of an earlier one.

    The earliest is the one of the least doc_id, nulls last; ties are broken by the locator. Null text: never a duplicate.
    Empty texts equal each other. Repeated rows, also of one doc_id, are duplicates of the first of them. Empty table: no
    rows. Texts of any length are compared whole. Other columns are ignored.

    state: a shared folder that the caller keeps; all calls with it make one stream, so documents are also compared with those
    of earlier calls, which came first whatever their ids. Their files must still be there. Without it each call is by itself.
    The arrivals are taken in when the function is called, once a call.
    """
    return _hits(docs, state)[1].select("doc_id", "kept_doc_id")


def unique(docs: DataFrame, state: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't duplicates in the sense of ``duplicates``. An empty table stays empty."""
    rows, hits = _hits(docs, state)
    gone = materialise(hits.select("file", "pos"), "dedup-gone")
    return bloom.without(rows, gone, ["file", "pos"]).select("d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, kept_doc_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth
  FROM documents WHERE text IS NOT NULL) WHERE nth > 1
"""
