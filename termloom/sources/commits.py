"""The list of commits of a set of tables: which written attempt of a batch counts.

Every delivery writes folders of its own attempt, and then one small file that names
it. That file appears by a rename, so readers see a delivery whole or not at all, and
one that stops half way has never happened. A batch that is sent again is a new attempt,
whose commit takes the place of the former one. Readers that began before go on with
the folders they have planned with, since none is changed.

Tables have one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "number bigint, attempt string, kind string, first_batch bigint, last_batch bigint"
)
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]
BATCH, COMPACTION, RESULTS = "batch", "compaction", "results"


@dataclass(frozen=True, order=True)
class Commit:
    """A commit of the batches from `first_batch` to `last_batch`, or of results."""

    number: int
    attempt: str
    kind: str
    first_batch: int | None
    last_batch: int | None


def new_attempt() -> str:
    return uuid.uuid4().hex


class CommitList:
    """The commits of one folder, oldest first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def read(self) -> list[Commit]:
        """All commits. There is one small row for each delivery."""
        try:
            table = self.spark.read.schema(SCHEMA).json(self.path, recursiveFileLookup=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(Commit(*row) for row in table.collect())

    def add(
        self, attempt: str, kind: str, first_batch: int | None = None, last_batch: int | None = None
    ) -> None:
        """Make a written attempt the one that counts."""
        number = max((commit.number for commit in self.read()), default=-1) + 1
        row = dict(zip(NAMES, (number, attempt, kind, first_batch, last_batch)))
        values = [F.lit(value).alias(name) for name, value in row.items() if value is not None]
        table = self.spark.range(1, numPartitions=1).select(*values)
        table.write.json(f"{self.path}/{number:012d}-{attempt}")

    def batches(self) -> list[Commit]:
        """The commits that count, in the order of their batches."""
        counting: list[Commit] = []
        for commit in self.read():
            if commit.kind != RESULTS:
                counting = [
                    other
                    for other in counting
                    if other.last_batch < commit.first_batch or other.first_batch > commit.last_batch
                ] + [commit]
        return sorted(counting, key=lambda commit: commit.last_batch)

    def results(self) -> Commit | None:
        """The commit of the results that count."""
        return max((c for c in self.read() if c.kind == RESULTS), default=None)


def attempt_path(table: str, batch_id: int, attempt: str) -> str:
    return f"{table}/batch_id={batch_id}/attempt={attempt}"


def read_attempts(spark: SparkSession, table: str, commits: list[Commit], schema: str) -> DataFrame:
    """The rows of a table that `commits` name, with their `batch_id`; no other folder is listed."""
    schema = f"{schema}, batch_id bigint"
    if not commits:
        return spark.createDataFrame([], schema)
    paths = [attempt_path(table, commit.last_batch, commit.attempt) for commit in commits]
    read = spark.read.schema(schema).option("basePath", table).parquet(*paths)
    return read.drop("attempt")
