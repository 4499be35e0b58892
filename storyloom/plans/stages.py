"""Stage checkpoints: a Parquet table per stage and a manifest with its settings and content hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages in order.
STAGES = ("text_split", "extraction", "context_propagation", "agent_classification", "scenes", "linking", "theme_annotation")


def run_id(path: str, modified: int) -> str:
    return f"{path.rstrip('/').rsplit('/', 1)[-1]}_{modified}"


def content_hash(df: DataFrame) -> str:
    """16 hex digits that change with the rows, whatever their order: count and xor of row hashes."""
    n, x = df.agg(F.count("*"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*df.columns)) if df.columns else F.lit("")))).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{n}|{x}".encode()).hexdigest()[:16]


class Checkpoints:
    """Stages of one run under a folder of any store that Spark reads.

    A stage counts as there only if its manifest is, with the same settings, and its rows hash as when they were saved:
    anything else is computed anew.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str, settings: dict | None = None):
        self.spark, self.base = spark, f"{folder.rstrip('/')}/{run}"
        self.settings = hashlib.sha256(json.dumps(settings or {}, sort_keys=True).encode()).hexdigest()[:16]

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _manifest(self, stage: str) -> dict | None:
        fs, where = self._fs(f"{self.base}/{stage}.manifest")
        if not fs.exists(where):
            return None
        return json.loads(self.spark.read.text(f"{self.base}/{stage}.manifest", wholetext=True).first()[0])

    def save(self, stage: str, df: DataFrame, description: str = "") -> DataFrame:
        """df written as the stage's table, and read again."""
        df.write.mode("overwrite").parquet(f"{self.base}/{stage}")
        back = self.spark.read.parquet(f"{self.base}/{stage}")
        note = {"stage": stage, "description": description, "settings": self.settings, "hash": content_hash(back), "saved_at": self.spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]}
        self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.base}/{stage}.manifest")
        return back

    def has(self, stage: str) -> bool:
        note = self._manifest(stage)
        return note is not None and note["settings"] == self.settings

    def load(self, stage: str) -> DataFrame | None:
        """The stage's table, None if it is absent or not what was saved."""
        if not self.has(stage):
            return None
        df = self.spark.read.parquet(f"{self.base}/{stage}")
        return df if content_hash(df) == self._manifest(stage)["hash"] else None

    def stage(self, name: str, make: Callable[[], DataFrame], resume: bool = True) -> DataFrame:
        found = self.load(name) if resume else None
        return found if found is not None else self.save(name, make())

    def list(self) -> list[str]:
        return [s for s in STAGES if self.has(s)]

    def last(self) -> str | None:
        return next(iter(reversed(self.list())), None)

    def summary(self) -> list[dict]:
        return [n for n in map(self._manifest, STAGES) if n]

    def clear(self, stage: str) -> None:
        for path in (f"{self.base}/{stage}", f"{self.base}/{stage}.manifest"):
            fs, where = self._fs(path)
            fs.delete(where, True)

    def clear_all(self) -> None:
        fs, where = self._fs(self.base)
        fs.delete(where, True)
