"""The index table and how it follows its chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INDEX, conform
from .embedding import DIM, embed, model_name

CHUNK_COLUMNS = ("url", "page_title", "text", "model")


def build_index(chunks: DataFrame, dim: int = DIM, encoder=None, model: str | None = None) -> DataFrame:
    """Chunks with their vectors; a chunk without a vector is not part of the index."""
    rows = chunks.select("chunk_id", "url", "page_title", "text")
    return conform(embed(rows, "text", dim, encoder, model), INDEX)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``(key, change_type)`` for inserted, updated and deleted keys.

    One grouping over both snapshots instead of an outer join: it combines
    before the shuffle, moves two numbers per key and side instead of the rows,
    and a repeated key is compared as a bag of rows without multiplying.
    """

    def side(df: DataFrame, is_new: bool) -> DataFrame:
        digest = F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
        return df.select(key, digest.alias("_d")).select(
            key,
            F.lit(is_new).alias("_new"),
            F.conv(F.substring("_d", 1, 15), 16, 10).cast("decimal(20,0)").alias("_high"),
            F.conv(F.substring("_d", 16, 15), 16, 10).cast("decimal(20,0)").alias("_low"),
        )

    def total(c: str, of_new: Column) -> Column:
        return F.coalesce(F.sum(F.when(of_new, F.col(c))), F.lit(0))

    is_new = F.col("_new")
    grouped = (
        side(old, False)
        .unionByName(side(new, True))
        .groupBy(key)
        .agg(
            F.count_if(~is_new).alias("_n_old"),
            F.count_if(is_new).alias("_n_new"),
            *[total(c, ~is_new).alias(f"{c}_old") for c in ("_high", "_low")],
            *[total(c, is_new).alias(f"{c}_new") for c in ("_high", "_low")],
        )
    )
    same = (
        (F.col("_n_old") == F.col("_n_new"))
        & (F.col("_high_old") == F.col("_high_new"))
        & (F.col("_low_old") == F.col("_low_new"))
    )
    change = (
        F.when(F.col("_n_old") == 0, "insert").when(F.col("_n_new") == 0, "delete").when(~same, "update")
    )
    return grouped.select(key, change.alias("change_type")).where(F.col("change_type").isNotNull())


def sync_index(
    index: DataFrame, chunks: DataFrame, dim: int = DIM, encoder=None, model: str | None = None
) -> DataFrame:
    """The index after its chunks changed: only new and changed chunks are embedded.

    Chunks embedded by another model count as changed.
    """
    tag = model or model_name(dim)
    has_vector = chunks.where(F.lower("text").rlike("[a-z0-9]")) if encoder is None else chunks
    wanted = has_vector.select("chunk_id", "url", "page_title", "text", F.lit(tag).alias("model"))
    changes = snapshot_diff(index, wanted, "chunk_id", list(CHUNK_COLUMNS))
    kept = index.join(changes.select("chunk_id"), "chunk_id", "left_anti")
    stale = changes.where(F.col("change_type") != "delete").select("chunk_id")
    fresh = build_index(chunks.join(stale, "chunk_id", "left_semi"), dim, encoder, model)
    return conform(kept, INDEX).unionByName(fresh)


def require_unique(df: DataFrame, key: str) -> None:
    """Fail on a key of several rows; the index has one row per key."""
    again = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if again:
        raise ValueError(f"several rows per {key}, such as {[tuple(r) for r in again]}; see one_per_url")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Completely written versions below ``root``."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version-") and fs.exists(done):
            found.append(int(name.removeprefix("version-")))
    return sorted(found)


def index_exists(spark: SparkSession, root: str) -> bool:
    return bool(_versions(spark, root))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version."""
    versions = _versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no index below {root}")
    return spark.read.schema(INDEX).parquet(f"{root}/version-{versions[-1]:06d}")


def upsert_index(
    spark: SparkSession, root: str, chunks: DataFrame, dim: int = DIM, encoder=None, model: str | None = None
) -> DataFrame:
    """Create the index if there is none, else bring it in step with ``chunks``.

    Each call writes a version of its own: a plan cannot overwrite what it
    reads, and readers keep the version they opened.
    """
    versions = _versions(spark, root)
    if versions:
        rows = sync_index(read_index(spark, root), chunks, dim, encoder, model)
    else:
        rows = build_index(chunks, dim, encoder, model)
    following = versions[-1] + 1 if versions else 1
    require_unique(chunks, "chunk_id")
    rows.write.mode("overwrite").parquet(f"{root}/version-{following:06d}")
    return read_index(spark, root)


def vector_models(df: DataFrame) -> DataFrame:
    """Models and vector lengths in use."""
    return df.groupBy("model", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


def check_models(index: DataFrame, questions: DataFrame) -> DataFrame:
    """Models of the questions that the index lacks; no rows means they fit."""
    return vector_models(questions).join(vector_models(index).drop("n"), ["model", "dim"], "left_anti")


def require_same_model(index: DataFrame, questions: DataFrame) -> None:
    """Fail on questions of a foreign model or vector length; of the index's vectors only one per model is read."""
    asked = questions.groupBy("model").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    wrong = asked.join(index.select("model"), "model", "left_anti").select("model").limit(5).collect()
    if wrong:
        raise ValueError(f"questions embedded by models the index does not hold: {wrong}")
    for r in asked.collect():
        held = index.where(F.col("model") == r.model).select(F.size("embedding").alias("length")).first().length
        if not r.low == held == r.high:
            raise ValueError(f"vectors of {r.model} have {held} numbers, the questions' {r.low} to {r.high}")


def latest_version(df: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Newest version per key, compared as a number; 1 where there is none."""
    newest = F.greatest(F.coalesce(F.max(F.col(version).cast("bigint")), F.lit(1)), F.lit(1))
    return df.groupBy(key).agg(newest.alias("latest_version"))


def latest_rows(df: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The row of the newest version per key; only one row per key and task is shuffled."""
    newest = F.max_by(F.struct(*df.columns), F.col(version).cast("bigint")).alias("row")
    return df.groupBy(key).agg(newest).select("row.*")
