"""Document tables and folders of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import without_extension
from termloom.operators.partitioning import divide


def read_documents(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text) of a Parquet table; other columns are not read."""
    table = spark.read.parquet(path)
    return table.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def _document_name(path: Column, by_folder: bool) -> Column:
    """The name of a file without its extension, or that of its folder."""
    parts = F.split(path, "/")
    return F.element_at(parts, -2) if by_folder else without_extension(F.element_at(parts, -1))


def read_text_folder(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """(doc_id, text): one row per line, named by its file, or by its folder.

    The files are splittable line records, so a large file is read by many
    tasks. A document has many rows, and an empty file has none: how many
    documents there are says `list_text_documents`.
    """
    lines = spark.read.text(path, recursiveFileLookup=by_folder)
    return lines.select(
        _document_name(F.col("_metadata.file_path"), by_folder).alias("doc_id"),
        F.col("value").alias("text"),
    )


def list_text_documents(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """(doc_id) of the text files under `path`, empty ones too.

    Spark's own reads pass over empty files, so tasks list them apart.
    """
    files = list_files(spark, path, subfolders=by_folder)
    return files.select(_document_name(F.col("path"), by_folder).alias("doc_id")).distinct()


def list_files(spark: SparkSession, folder: str, subfolders: bool = True) -> DataFrame:
    """(path) of the files in a folder, or in its subfolders too, hidden ones left out.

    One task lists the folder itself and many its subfolders; names do not come
    to the driver. Special characters are written as Spark does in file paths.
    The folder must be in a file system that tasks reach by its address.
    """

    def listed(batches, whole: bool):
        import re

        import pyarrow as pa
        from pyarrow import fs

        special = re.compile(r"[\x00-\x20\x7f\"#%<>?\[\]\\^`{|}]")

        def quoted(name: str) -> str:
            return special.sub(lambda c: f"%{ord(c[0]):02X}", name)

        def visible(path: str, base: str) -> bool:
            return not any(part[:1] in ("_", ".") for part in path[len(base) :].split("/") if part)

        for batch in batches:
            for path, is_folder in zip(*(column.to_pylist() for column in batch.columns)):
                if not is_folder:
                    found = [(path, False)]
                else:
                    files, base = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                    infos = files.get_file_info(fs.FileSelector(base, recursive=whole))
                    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
                    found = []
                    for info in infos:
                        if visible(info.path, base):
                            within = info.type == fs.FileType.Directory
                            # Folders are listed again, by their plain names.
                            name = info.path if within else quoted(info.path)
                            found.append((prefix + name, within))
                paths, folders = zip(*found) if found else ((), ())
                columns = [pa.array(paths, pa.string()), pa.array(folders, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "folder"])

    schema = "path string, folder boolean"
    root = spark.range(1).select(F.lit(folder.rstrip("/")).alias("path"), F.lit(True).alias("folder"))
    entries = root.mapInArrow(lambda batches: listed(batches, False), schema)
    if subfolders:
        entries = divide(entries).mapInArrow(lambda batches: listed(batches, True), schema)
    return entries.where(~F.col("folder")).select("path")


def stream_documents(
    spark: SparkSession,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    files_per_batch: int | None = None,
    schema: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """(doc_id, text, arrived) of Parquet files as they appear under `path`.

    `path` may be a folder or a pattern. The schema is that of the files there;
    with a `schema` the folder may be empty at first. `tasks` divides the texts
    of every micro-batch over so many tasks, for small files; without it they
    stay as their files are split.
    """
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arriving = reader.parquet(path).select(
        F.col(key).alias("doc_id"),
        F.col(text).alias("text"),
        F.col("_metadata.file_modification_time").alias("arrived"),
    )
    return divide(arriving, tasks) if tasks else arriving
