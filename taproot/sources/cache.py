"""A fact cache: Parquet snapshots of extracted facts, keyed by path and content.

A snapshot is written to a folder of its own and counts only once its marker is
there, so a reader never sees half of one.  Facts of unchanged sources are joined
in, only the others are read again, and the last ``keep`` snapshots stay.

Whole reports are kept too, by a digest of all that they follow from.  A report
follows from what the facts say of modules, not from where it stands in the text:
a change of a file that leaves its imports, exports and diagnostics alike has the
report of before.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.sources import jsfacts

#: Part of every key: facts of another extractor are not the same facts.
CONTEXT = "jsfacts-2"


@dataclass
class FactCache:
    """Snapshots below ``path``, which any Hadoop file system may hold."""

    path: str
    keep: int = 3

    def _fs(self, spark):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self, spark) -> list[str]:
        """Complete snapshots, the latest first."""
        jvm, fs = self._fs(spark)
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return [n.split("-", 1)[1] for n in sorted(names, reverse=True)]

    def facts(self, sources: DataFrame) -> DataFrame:
        """Facts of ``sources(path, text)``; a new snapshot is written if any was not cached."""
        spark = sources.sparkSession
        digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        key = F.concat(F.lit(CONTEXT + ":"), digest)
        found = self.snapshots(spark)
        if not found:
            return self._commit(jsfacts.extracted(sources), spark, 0)
        old = spark.read.parquet(f"{self.path}/{found[0]}")
        wanted = sources.select("path", key.alias("key"))
        known = old.withColumn("key", F.concat(F.lit(CONTEXT + ":"), "digest"))
        held = known.join(wanted, ["path", "key"], "left_semi").drop("key")
        missing = sources.withColumn("key", key).join(known.select("path", "key"), ["path", "key"], "left_anti").select("path", "text")
        both = wanted.select("path", "key", F.lit(1).alias("new"), F.lit(0).alias("old")).union(known.select("path", "key", F.lit(0), F.lit(1)))
        both = both.groupBy("path", "key").agg(F.max("new").alias("new"), F.max("old").alias("old"))
        if both.where("new <> old").isEmpty():
            return old
        return self._commit(held.unionByName(jsfacts.extracted(missing)), spark, len(found))

    def _commit(self, facts: DataFrame, spark, before: int) -> DataFrame:
        name = uuid.uuid4().hex
        facts.write.parquet(f"{self.path}/{name}")
        jvm, fs = self._fs(spark)
        order = max([int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/done"))], default=-1) + 1 if before else 0
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/{order:09}-{name}"))
        out.write(bytearray(json.dumps({"context": CONTEXT}).encode()))
        out.close()
        for old in self.snapshots(spark)[self.keep :]:
            for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")):
                if s.getPath().getName().endswith(old):
                    fs.delete(s.getPath(), False)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
        return spark.read.parquet(f"{self.path}/{name}")

    def report(self, spark, key: str) -> dict[str, DataFrame] | None:
        """The tables of a complete report that was kept under ``key``."""
        jvm, fs = self._fs(spark)
        base = f"{self.path}/reports/{key}"
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/done")):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/tables"))]
        return {n: spark.read.parquet(f"{base}/tables/{n}") for n in names}

    def keep_report(self, spark, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Writes a report's tables, then its marker; reports beyond the last ``keep`` go."""
        jvm, fs = self._fs(spark)
        path = jvm.org.apache.hadoop.fs.Path
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/reports/{key}/tables/{name}")
        fs.create(path(f"{self.path}/reports/{key}/done")).close()
        held = sorted(fs.listStatus(path(f"{self.path}/reports")), key=lambda s: -s.getModificationTime())
        for old in held[self.keep :]:
            fs.delete(old.getPath(), True)
        return self.report(spark, key)


def digest_of(df: DataFrame) -> str:
    """A digest of a table's rows in any order: two 64-bit hashes of each row, added up and combined."""
    one, two = F.xxhash64(*df.columns), F.xxhash64(F.lit(17), *df.columns)
    row = df.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("a"), F.bit_xor(two).alias("b")).first()
    return hashlib.sha256(f"{CONTEXT}|{row['n']}|{row['a']}|{row['b']}".encode()).hexdigest()[:32]
