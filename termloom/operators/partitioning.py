"""How a document table is divided over tasks before its texts are worked on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table of at most so many bytes of files may be shuffled to divide it. The
# bound is the table's own: no larger table is shuffled on a larger cluster.
SMALL_TABLE_BYTES = 64 * 1024 * 1024
SMALL_TABLE_FILES = 100


def is_small(table: DataFrame) -> bool:
    """Whether the files that a table is read from are few and small together."""
    if table.rdd.getNumPartitions() > SMALL_TABLE_FILES:
        return False  # without listing the names of a large table's files
    files = table.inputFiles()
    if not files or len(files) > SMALL_TABLE_FILES:
        return False
    sizes = table.sparkSession.read.format("binaryFile").load(files)
    return sizes.agg(F.sum("length")).first()[0] <= SMALL_TABLE_BYTES


def divide(documents: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hash rows to `tasks`, as many as `spark.sql.shuffle.partitions` unless given.

    Hashing on the text too keeps a document of many rows from one task, and
    unlike a round robin it gives a lost task the same rows again.
    """
    tasks = tasks or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.repartition(tasks, *documents.columns)


def spread(documents: DataFrame) -> DataFrame:
    """Divide a small table over the cores; leave a large one as it is split.

    Tokenizing costs far more than reading, so a small table in one file must
    not be one task. Meant for a table as it is read.
    """
    return divide(documents) if is_small(documents) else documents
