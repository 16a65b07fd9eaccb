"""Which data set a stored graph holds, and the register of uploaded ones.

The register is a small Parquet table on the driver's side of things: a row for each upload.  A
change writes the next version beside the present one and only then moves the pointer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, kind string, sources array<string>, note string"
# Built-in sessions by the marker of their data set, and what a name may look like.
BUILT_IN = {"fraud_oracle": "fraud_oracle", "insurance_claims": "insurance_claims", "insurance_dataset": "insurance_dataset", "data_synthetic": "insurance_dataset", "synthetic": "pdf_demo"}
FALLBACK = "pdf_demo"
NAME = re.compile(r"[A-Za-z0-9 _-]{1,48}")
MARKER_SCHEMA = "name string"


class Catalog:
    """A register under ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, table: str) -> list[int]:
        fs, path = self._fs()
        here = path(f"{self.path}/{table}")
        if not fs.exists(here):
            return []
        done = [s.getPath() for s in fs.listStatus(here)]
        return sorted(int(p.getName()[1:]) for p in done if re.fullmatch(r"v\d+", p.getName()) and fs.exists(path(p, "_SUCCESS")))

    def _read(self, table: str, schema: str) -> DataFrame:
        # a version without its success marker was never finished and does not count
        found = self._versions(table)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/v{found[-1]}")

    def _write(self, table: str, df: DataFrame) -> None:
        n = (self._versions(table) or [0])[-1] + 1
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{table}/v{n}")

    def entries(self) -> DataFrame:
        return self._read("register", SCHEMA)

    def sessions(self) -> DataFrame:
        """``id, kind, marker``: built-in sessions and uploads."""
        built = self.spark.createDataFrame(sorted({(s, "built-in", s) for s in BUILT_IN.values()}), "id string, kind string, marker string")
        return built.unionByName(self.entries().select(F.col("name").alias("id"), F.lit("custom").alias("kind"), F.col("name").alias("marker")))

    def checked_name(self, name: str, besides: str | None = None) -> str:
        """The name with single spaces; ValueError if it is ill-formed or taken."""
        clean = " ".join(name.split())
        if not NAME.fullmatch(clean):
            raise ValueError("a name has 1 to 48 letters, digits, spaces, _ or -")
        if clean in BUILT_IN.values() or (clean != besides and not self.entries().filter(F.col("name") == clean).isEmpty()):
            raise ValueError(f"{clean!r} is taken")
        return clean

    def add(self, name: str, kind: str, sources: list[str], note: str = "") -> str:
        name = self.checked_name(name)
        row = self.spark.createDataFrame([(name, kind, sources, note)], SCHEMA)
        self._write("register", self.entries().unionByName(row))
        return name

    def rename(self, old: str, new: str) -> str:
        new = self.checked_name(new, besides=old)
        self._write("register", self.entries().withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name"))))
        return new

    def remove(self, name: str) -> None:
        self._write("register", self.entries().filter(F.col("name") != name))

    def stamp(self, dataset: str, reset: bool = True) -> None:
        """Mark which data set is loaded; without ``reset`` an earlier mark stays."""
        if reset or self.loaded() is None:
            self._write("marker", self.spark.createDataFrame([(dataset,)], MARKER_SCHEMA))

    def loaded(self) -> str | None:
        row = self._read("marker", MARKER_SCHEMA).orderBy("name").first()
        return row["name"] if row else None

    def current(self) -> str:
        """The session of the loaded data set."""
        marker = self.loaded()
        if marker in BUILT_IN:
            return BUILT_IN[marker]
        known = marker is not None and not self.entries().filter(F.col("name") == marker).isEmpty()
        return marker if known else FALLBACK


def post_state(nodes: DataFrame, edges: DataFrame, policy: str) -> DataFrame:
    """One policy's premium, coverages, endorsements and edges to them."""
    mine = edges.filter((F.col("src") == policy) & F.col("type").isin("COVERS", "ENDORSED_BY"))
    premium = nodes.filter((F.col("label") == "Policy") & (F.col("id") == policy)).agg(F.max(F.col("nums")["premium"]).alias("premium"))
    ends = mine.join(nodes.filter("label = 'Endorsement'").select(F.col("id").alias("dst")), "dst", "left_semi").agg(F.countDistinct("dst").alias("endorsements"))
    counts = mine.agg(F.count_if(F.col("type") == "COVERS").alias("coverages"), F.count_if(F.col("type") == "ENDORSED_BY").alias("endorsement_edges"))
    return premium.crossJoin(counts).crossJoin(ends)


def statements(script: str) -> list[str]:
    """A script's statements between semicolons, without block comments and ``//`` or ``--`` lines."""
    plain = re.sub(r"/\*.*?\*/", "", script, flags=re.S)
    kept = ("\n".join(x for x in part.splitlines() if not x.strip().startswith(("//", "--"))).strip() for part in plain.split(";"))
    return [s for s in kept if s]


def apply_script(spark: SparkSession, script: str) -> int:
    """Run a schema script's statements in order; returns how many there were."""
    found = statements(script)
    for s in found:
        spark.sql(s)
    return len(found)
