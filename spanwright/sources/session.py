"""Session settings, what a run was made with, and shipping the package to executors."""

from __future__ import annotations

import os
import platform
import tempfile
import zipfile
from dataclasses import dataclass, fields

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that the plans rely on: adaptive plans with skew splitting, offsets and days in one zone.
NEEDED = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}


@dataclass(frozen=True)
class Settings:
    """Defaults of the answer flow; each can be set as spark.spanwright.<name> in the session."""

    max_words: int = 200
    overlap: int = 40
    k: int = 6
    depth: int = 50
    redact: bool = True
    gate: str = "top_ts_rank"
    model: str = "ollama:stub"
    max_cost_usd: float = 0.0

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {}
        for f in fields(cls):
            said = spark.conf.get(f"spark.spanwright.{f.name}", None)
            if said is not None:
                kind = type(f.default)
                given[f.name] = said.lower() in ("true", "1", "yes") if kind is bool else kind(said)
        return cls(**given)


def session(name: str = "spanwright", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (NEEDED | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def run_metadata(spark: SparkSession, label: str, **details: str) -> DataFrame:
    """One row that tells what a run was made with: label, application, versions, settings and details."""
    told = {f.name: str(getattr(Settings.of(spark), f.name)) for f in fields(Settings)} | details
    row = [(label, spark.sparkContext.applicationId, spark.version, pyspark.__version__, platform.python_version(), told)]
    made = spark.createDataFrame(row, "label string, application string, spark string, pyspark string, python string, settings map<string,string>")
    return made.withColumn("made_at", F.current_timestamp())


def ship(spark: SparkSession) -> str:
    """Add this package to every executor's path as a zip file, for clusters on which it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spanwright-"), "spanwright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    return path
