"""Exact deduplication as a stateful stream with a byte check of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize, new_path

_STORE = "spark.sql.streaming.stateStore"
#: State on disk. Each partition's store takes the disk it fills, not blocks allocated ahead, and a batch
#: uploads its changes, not the whole store again.
STATE_CONF = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
FILES_PER_TRIGGER = 64
#: Digests with more than this share of all rows, a thousand at most, are spread over SALTS tasks in joins.
HEAVY_SHARE, SALTS = 1 / 1000, 64
#: Rows of the filter that is broadcast: slots of the digests whose texts are looked at again.
FILTER_SLOTS = 1 << 20


def normalized(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column, hex_digits: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, hex_digits)


def place_of() -> Column:
    """Where a row of a file source is: file and row."""
    return F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A Parquet file or folder as a stream of its files.

    The path is made a pattern that only it matches, as a stream's path is otherwise taken for a folder.
    """
    return (
        spark.readStream.schema(spark.read.parquet(path).schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{path[:-1]}[{path[-1]}]")
    )


def update_state(
    stream: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", hex_digits: int = 64
) -> None:
    """Run the stream over what is there and leave the state's changes of each batch in folder/changes.

    State, in RocksDB and without expiry, by digest of the normalised text: keep_id (smallest id), the
    locator of its content (file and row, the least of those with that id) and group_size. Copies combine before the shuffle. A restart
    from the same folder goes on after the last finished batch; a batch that runs again replaces its rows.
    """
    spark = stream.sparkSession
    rows = stream.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unhex(digest_of(normalized(F.col(f"`{text_col}`")), hex_digits)).alias("digest"),
        place_of().alias("locator"),
    )
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "locator"))  # a null id comes last
    state = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
    state = state.select("digest", F.col("first.id").alias("keep_id"), "first.locator", "group_size")

    def keep(changes: DataFrame, batch: int) -> None:
        changes.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/changes/part={batch}")

    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    try:
        for key, value in STATE_CONF.items():
            spark.conf.set(key, value)
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, keep_id, locator, group_size): the last change of each digest."""
    changes = spark.read.schema(
        "digest binary, keep_id long, locator string, group_size long, batch int"
    ).parquet(f"{folder}/changes/part=*")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("s"))
    return last.select("digest", "s.*")


def _spread(rows: DataFrame, heavy: DataFrame, salts: Column) -> DataFrame:
    """rows with a salt: of digests that are heavy as given (an array is exploded), of the others 0."""
    marked = rows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "digest", "left")  # a thousand rows at most
    return marked.withColumn("salt", F.explode(F.when(F.col("heavy"), salts).otherwise(F.array(F.lit(0))))).drop("heavy")


def _collided(docs: DataFrame, state: DataFrame, heavy: DataFrame, digest: Column, norm: Column) -> DataFrame:
    """(digest): those with a row whose bytes are not those of the row that stays, which its locator finds."""
    groups = state.where("group_size > 1").select("digest", "locator")
    slot = lambda d: F.pmod(F.xxhash64(d), F.lit(FILTER_SLOTS)).cast("int")
    slots = groups.select(slot("digest").alias("slot")).distinct()
    members = docs.select(digest, norm.alias("norm"), place_of().alias("place"))
    members = members.join(F.broadcast(slots), slot("digest") == F.col("slot"), "left_semi")
    keepers = members.join(groups.select("locator"), F.col("place") == F.col("locator")).select("digest", F.col("norm").alias("kept_norm"))
    mine, every = F.array(F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")), F.sequence(F.lit(0), F.lit(SALTS - 1))
    met = _spread(members, heavy, mine).join(_spread(keepers, heavy, every), ["digest", "salt"])
    return met.where("norm <> kept_norm").select("digest").distinct()


def deduplicate(
    docs: DataFrame,
    state: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    hex_digits: int = 64,
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, locator of the keeper.

    docs: a file source, the one whose rows the state has. Rows that hit a digest of another row are compared
    byte by byte with the row that stays, read from where its locator says; where they differ, the digest has
    collided and its rows are grouped by the text itself.

    Of a group the row with the smallest id stays, one only: of rows that repeat the id, that with the least
    locator. Nulls: a null text is empty; a null id comes after all others, and a group of null ids has no
    keep_id, but keeps its first row. Extra columns are not returned. An empty table gives none.
    """
    norm = normalized(F.col(f"`{text_col}`"))
    digest = F.unhex(digest_of(norm, hex_digits)).alias("digest")
    ids = F.col(f"`{id_col}`").cast("long").alias("doc_id")
    state = materialize(state, "state")
    total = state.agg(F.sum("group_size")).first()[0] or 0
    heavy = materialize(state.where(F.col("group_size") > total * HEAVY_SHARE).select("digest"), "state-heavy")
    collided = materialize(_collided(docs, state, heavy, digest, norm), "collided")
    rows = docs.select(ids, digest, F.sha2(norm, 256).alias("text_sha256"), place_of().alias("place"))
    mine, every = F.array(F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")), F.sequence(F.lit(0), F.lit(SALTS - 1))
    columns = ["doc_id", "keep_id", "group_size", "place", "locator", "text_sha256"]
    if collided.isEmpty():
        grouped = _spread(rows, heavy, mine).join(_spread(state, heavy, every), ["digest", "salt"]).select(*columns)
    else:
        texts = docs.select(ids, digest, F.sha2(norm, 256).alias("text_sha256"), norm.alias("norm"), place_of().alias("place"))
        texts = texts.join(collided, "digest", "left_semi")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place"))
        groups = texts.groupBy("digest", "norm").agg(first.alias("first"), F.count("*").alias("group_size"))
        groups = groups.select("digest", "norm", F.col("first.doc_id").alias("keep_id"), F.col("first.place").alias("locator"), "group_size")
        apart = texts.join(groups, ["digest", "norm"])
        kept = state.join(collided, "digest", "left_anti")
        grouped = _spread(rows, heavy, mine).join(_spread(kept, heavy, every), ["digest", "salt"]).select(*columns).unionByName(apart.select(*columns))
    return grouped.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("locator")).alias("kept"), "text_sha256", "locator")


def deduplicate_table(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    hex_digits: int = 64,
    files_per_trigger: int = FILES_PER_TRIGGER,
    folder: str | None = None,
) -> DataFrame:
    """Stream the table at path through the state, then give deduplicate() of its rows.

    folder keeps the state; with the same folder a later call takes in only files that have come since.
    """
    folder = folder or new_path(spark, "exact")
    columns = {"id_col": id_col, "text_col": text_col, "hex_digits": hex_digits}
    update_state(read_stream(spark, path, files_per_trigger), folder, **columns)
    return deduplicate(spark.read.parquet(path), latest_state(spark, folder), **columns)


def op8_exact(spark, sf_dir: str) -> DataFrame:
    return deduplicate_table(spark, f"{sf_dir}/documents.parquet", files_per_trigger=8).drop("locator")


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
