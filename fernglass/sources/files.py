"""JSON lines, manifests and health of stored tables."""

from __future__ import annotations

import json
import re
import subprocess
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fernglass import schemas


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of a fixed schema; blank lines are skipped, a line that isn't a record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.PASSAGE)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.QUESTION)


def load_source_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.SOURCE_ROW)


def json_lines(df: DataFrame) -> DataFrame:
    """(line): each row as JSON with sorted keys; null fields are written, so that a line has every key."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("line"))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as JSON lines; with ``order``, range-partitioned and sorted, so that the files in their order are the same bytes every time."""
    if order:
        df = df.orderBy(*order)
    json_lines(df).write.mode("overwrite").text(path)


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def git_commit() -> str | None:
    """The commit checked out where the process runs, if there is one."""
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.strip()


@dataclass
class Manifest:
    """What is known of a corpus: its hash, whether it is frozen, and the hashes it had."""

    corpus_hash: str = ""
    frozen: bool = False
    passages: int = 0
    seed: int = 0
    created_at: str = field(default_factory=utc_now)
    commit: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    hash_history: list[dict] = field(default_factory=list)

    @classmethod
    def read(cls, path: str) -> Manifest:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2, sort_keys=True, ensure_ascii=False)
            f.write("\n")


def table_health(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One row (name, state, count, detail): ``down`` without a path, ``empty`` without rows, else ``populated``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        row = (name, "down", 0, f"no table at {path}")
    else:
        n = spark.read.parquet(path).count()
        row = (name, "populated" if n else "empty", n, "")
    return spark.createDataFrame([row], "name string, state string, count long, detail string")


_TABLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def checked_name(name: str) -> str:
    """``name`` if it may be a table's name, else an error."""
    if not _TABLE.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name
