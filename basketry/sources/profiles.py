"""User profile files: one JSON document per user."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketry import schemas

# executors get these functions with the job and need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDERS = 256  # that profile files are dealt to
READ_BYTES = 8 << 20  # of documents that go to Spark at a time


def load_profiles(spark: SparkSession, folder: str, user: str | None = None) -> DataFrame:
    """All readable profiles, keyed by file name; one user's if asked.

    The folder is listed by Spark and each document is parsed where it is read;
    documents that are not JSON are dropped.
    """
    pattern = f"{_safe(user)}.json" if user else "*.json"
    rows = (spark.read.schema(schemas.PROFILE).option("multiLine", True)
            .option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern)
            .json(folder))
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    # only percent codes are decoded: a plus in a file name is a plus
    decoded = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return rows.select(decoded.alias("user_id"), *_with_defaults())


def save_profile_files(documents: DataFrame, folder: str) -> int:
    """Write one file per user, ``value`` as it is; how many were written.

    ``documents`` has user_id (unique) and value. Tasks write the files, in a bounded number of folders by hash: a partitioned
    write would make a folder per user, too, and move each when it commits. A file has its name once it is whole, and a task
    that runs again replaces it.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for user, part, value in zip(batch["user_id"], batch["part"], batch["value"]):
                if part not in made:
                    store.create_dir(f"{top}/{part}")
                    made.add(part)
                name = f"{top}/{part}/{_file_name(user)}"
                begun = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(begun) as out:
                    out.write(value.encode())
                store.move(begun, name)
            yield pd.DataFrame({"files": [len(batch)]})

    user = F.col("user_id").cast("string")
    part = F.pmod(F.xxhash64(user), F.lit(FOLDERS)).cast("int")
    rows = documents.select(user.alias("user_id"), part.alias("part"), F.coalesce("value", F.lit("")).alias("value"))
    return rows.mapInPandas(write, "files long").agg(F.sum("files")).first()[0] or 0


def load_profile_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same as ``load_profiles`` for what ``save_profile_files`` wrote; tasks list the folders, so the driver holds no file names."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        for part in (p for batch in batches for p in batch["id"]):
            users, values, size = [], [], 0
            for found in store.get_file_info(fs.FileSelector(f"{top}/{part}", allow_not_found=True)):
                if found.extension != "json":
                    continue
                with store.open_input_stream(found.path) as file:
                    values.append(file.read().decode())
                users.append(_user_of(found.base_name))
                size += len(values[-1])
                if size > READ_BYTES:
                    yield pd.DataFrame({"user_id": users, "value": values})
                    users, values, size = [], [], 0
            yield pd.DataFrame({"user_id": users, "value": values}, dtype=object)

    parts = spark.range(0, FOLDERS, 1, min(FOLDERS, 4 * spark.sparkContext.defaultParallelism))
    rows = parts.mapInPandas(read, "user_id string, value string")
    schema = StructType([*schemas.PROFILE.fields, StructField("_broken", StringType())])
    parsed = rows.select("user_id", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"}).alias("_profile"))
    return parsed.where("_profile IS NOT NULL AND _profile._broken IS NULL").select("user_id", "_profile.*").select(
        "user_id", *_with_defaults())


def _file_name(user: str | None) -> str:
    """No text is quoted to a percent sign alone, so that stands for null."""
    return f"{'%' if user is None else quote(user, safe='')}.json"


def _user_of(file_name: str) -> str | None:
    name = file_name.removesuffix(".json")
    return None if name == "%" else unquote(name)


def _with_defaults() -> list:
    empty = F.array().cast(schemas.PROFILE["wishlist"].dataType)
    lists = [F.coalesce(c, empty).alias(c) for c in ("wishlist", "purchase_history", "cart")]
    return ["user_preferences", *lists, F.coalesce("rec_seed", F.lit(42)).alias("rec_seed")]


def save_profiles(profiles: DataFrame, folder: str) -> None:
    """Write profiles as JSON lines in one partition folder per user hash.

    Writing one file per user would make a file system entry per user; the
    hash partition keeps point reads cheap with a bounded number of files.
    """
    safe = F.regexp_replace(F.regexp_replace("user_id", r"[/\\]", "_"), r"\.\.", "_")
    (profiles.withColumn("user_id", safe)
     .withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(256)))
     .hint("rebalance", F.col("bucket"))  # few files per folder
     .write.mode("overwrite").partitionBy("bucket").json(folder))


def load_saved_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Read back what ``save_profiles`` wrote."""
    schema = "user_id string, bucket long, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schemas.PROFILE.fields)
    return spark.read.schema(schema).json(folder).select("user_id", *_with_defaults())


def entries_from_profiles(profiles: DataFrame) -> DataFrame:
    """Long form of the three lists: user_id, kind and the entry fields."""
    def one(column: str, kind: str) -> DataFrame:
        return profiles.select(
            "user_id", F.lit(kind).alias("kind"), F.inline(F.col(column)))
    return (one("purchase_history", "purchase")
            .unionByName(one("wishlist", "wishlist"))
            .unionByName(one("cart", "cart")))


def _safe(user: str) -> str:
    return user.replace("/", "_").replace("\\", "_").replace("..", "_")
