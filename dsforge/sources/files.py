"""JSONL tables, file listings and references to files, confined to a folder."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def confined(root: str, path: str) -> str:
    """The real path of ``path`` inside ``root``; anything that leads outside is refused."""
    base = os.path.realpath(root)
    real = os.path.realpath(os.path.join(base, path))
    if real != base and not real.startswith(base + os.sep):
        raise PermissionError(f"{path!r} is outside {root!r}")
    return real


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSONL files; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that ``read_jsonl`` drops."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("_v", F.try_parse_json("value"))
    return parsed.where(F.col("_v").isNull()).select(F.col("value").alias("line"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rewrite(df: DataFrame, path: str, form: str = "json") -> None:
    """Replaces a table: written beside it, the old one moved aside, the new one moved in its place, the old one deleted.

    The two moves are not one step on every file system: between them there is no table for a moment. If the second fails the old table is put back; after a crash in between
    ``restore`` does that.
    """
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}.new"
    df.write.format(form).save(beside)
    target, new, old, fs = _places(spark, path, beside)
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        fs.delete(new, True)
        raise OSError(f"{path!r} can't be moved aside; it is unchanged")
    if not fs.rename(new, target):
        if held:
            fs.rename(old, target)
        raise OSError(f"the new table can't be moved to {path!r}; the old one is back")
    if held:
        fs.delete(old, True)


def restore(spark: SparkSession, path: str) -> bool:
    """Puts back the table that a crash of ``rewrite`` left aside; whether there was one to put back."""
    target, _, old, fs = _places(spark, path, path + ".new")
    if fs.exists(target) or not fs.exists(old):
        return False
    return fs.rename(old, target)


def _places(spark: SparkSession, path: str, beside: str) -> tuple:
    jvm = spark.sparkContext._jvm
    target, new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, beside, path + ".old"))
    return target, new, old, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_system(path: str):
    """(file system, path in it) of a path or URI, the same on the driver and on executors: local paths, and every scheme that pyarrow knows."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def write_bytes(path: str, data: bytes) -> None:
    """Writes a whole file where the tables go too."""
    fs, at = file_system(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(data)


def read_bytes(path: str) -> bytes | None:
    """A whole file, None if there is none."""
    fs, at = file_system(path)
    try:
        with fs.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def list_files(spark: SparkSession, root: str, path: str = ".") -> DataFrame:
    """(path, length, modificationTime) of the files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(confined(root, path)).select("path", "length", "modificationTime")


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", "modificationTime").alias("path"))


def read_file(root: str, path: str) -> str:
    with open(confined(root, path), encoding="utf-8", errors="replace") as f:
        return f.read()


def write_file(root: str, path: str, text: str) -> str:
    real = confined(root, path)
    os.makedirs(os.path.dirname(real), exist_ok=True)
    with open(real, "w", encoding="utf-8") as f:
        f.write(text)
    return real


def resolve_refs(value, root: str):
    """Data in which every {"$file": path} stands replaced by the file's text, at every depth."""
    if isinstance(value, dict):
        if "$file" in value:
            return read_file(root, value["$file"])
        return {k: resolve_refs(v, root) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve_refs(v, root) for v in value]
    return value


def join_files(df: DataFrame, files: DataFrame, path_col: str, key: str = "path", content: str = "content") -> DataFrame:
    """Rows with the text of the file they name, null where there is none: references as one join."""
    texts = files.select(F.col(key).alias("_path"), F.col(content).alias("_file_text"))
    # rows without a path never match; in the join they would all meet in one task
    named = df.where(F.col(path_col).isNotNull()).join(texts, F.col(path_col) == F.col("_path"), "left").drop("_path")
    return named.unionByName(df.where(F.col(path_col).isNull()).withColumn("_file_text", F.lit(None).cast("string")))


def rows_argument(spark: SparkSession, value, schema: T.StructType, root: str = ".") -> DataFrame:
    """Rows given as a list, a single dict, JSON text, or the path of a JSON or JSONL file."""
    if isinstance(value, str):
        text = value.strip()
        if text[:1] not in "[{":
            return read_jsonl(spark, confined(root, value), schema)
        try:
            value = json.loads(text)
        except ValueError:
            value = [json.loads(x) for x in text.splitlines() if x.strip()]
    rows = [value] if isinstance(value, dict) else list(value)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


class Memory:
    """A small driver-side store of JSON values by key; a file that can't be read is set aside."""

    def __init__(self, path: str):
        self.path, self.values = path, {}
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    self.values = json.load(f)
            except ValueError:
                shutil.move(path, path.removesuffix(".json") + ".corrupt.json")

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    def set(self, key: str, value) -> None:
        self.values[key] = value
        beside = self.path + ".new"
        with open(beside, "w", encoding="utf-8") as f:
            json.dump(self.values, f, ensure_ascii=False)
        os.replace(beside, self.path)

    def list(self) -> list[str]:
        return sorted(self.values)
