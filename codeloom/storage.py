"""Shared folders, lineage cuts, and a versioned table root on Parquet."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import model


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, on one machine only, a temporary folder that is set as it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder, so that an iteration's plan doesn't grow and a lost executor costs one round."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def project_hash(root: str) -> str:
    """The folder name of a project: the first 8 bytes of its root's sha256, in hex."""
    return hashlib.sha256(root.encode()).hexdigest()[:16]


class IndexNotReady(RuntimeError):
    """The first bulk index of a table root isn't finished."""


class TableRoot:
    """Tables under ``<base>/<project hash>/gen-<uuid>/``, and numbered pointer files of which the last names the current generation.

    Spark has no MERGE on Parquet, so a commit writes a whole new generation and then renames one small file to the
    next pointer's name. No step takes a pointer away before its successor stands, so a crash leaves the old or the
    new generation; two commits at once can't both take a number. Readers keep the generation that they opened. A schema or indexer version that differs from the
    stored one reads as empty, so the index is rebuilt.
    """

    TABLES = {"nodes": model.NODES, "edges": model.EDGES, "declarations": model.DECLARATIONS, "vectors": model.VECTORS, "indexed_files": model.INDEXED_FILES}

    def __init__(self, spark: SparkSession, base: str, project: str, schema_version: str = "1", indexer_version: str = "1"):
        self.spark, self.root = spark, f"{base.rstrip('/')}/{project_hash(project)}"
        self.versions = {"schemaVersion": schema_version, "indexerVersion": indexer_version}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """The numbers of the pointers, last first."""
        p, fs = self._fs(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n[8:]) for n in names if n.startswith("CURRENT-")), reverse=True)

    def meta(self) -> dict:
        """The last pointer's content: generation, versions and times; empty if there is none or versions differ."""
        numbers = self._pointers()
        if not numbers:
            return {}
        found = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/CURRENT-{numbers[0]:012}").collect()))
        return found if all(found.get(k) == v for k, v in self.versions.items()) else {}

    def read(self, table: str) -> DataFrame:
        meta = self.meta()
        if not meta or table not in meta.get("tables", []):
            return self.spark.createDataFrame([], self.TABLES[table])
        return model.conform(self.spark.read.schema(self.TABLES[table]).parquet(f"{self.root}/{meta["generation"]}/{table}"), self.TABLES[table])  # an empty table may have no file

    def ready(self) -> dict:
        """meta, or IndexNotReady while the first bulk index runs."""
        meta = self.meta()
        if not meta.get("bulkIndexedAt"):
            raise IndexNotReady(f"no finished index under {self.root}")
        return meta

    def commit(self, tables: dict[str, DataFrame], **meta: str) -> None:
        """Write a generation with ``tables`` (others are carried over) and make it current."""
        before, generation = self.meta(), f"gen-{uuid.uuid4().hex}"
        for name in self.TABLES:
            df = tables[name] if name in tables else self.read(name)
            df = model.conform(df, self.TABLES[name])
            if name == "edges":  # six kinds: a query of one kind lists one folder
                df.write.partitionBy("kind").parquet(f"{self.root}/{generation}/{name}")
            else:
                df.write.parquet(f"{self.root}/{generation}/{name}")
        kept = {k: v for k, v in before.items() if k not in ("generation", "tables")}
        self._point(json.dumps(kept | meta | self.versions | {"generation": generation, "tables": list(self.TABLES)}))

    def _point(self, text: str) -> None:
        numbers = self._pointers()
        new, fs = self._fs(f"{self.root}/.new-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._fs(f"{self.root}/CURRENT-{(numbers or [0])[0] + 1:012}")
        if fs.exists(target) or not fs.rename(new, target):
            fs.delete(new, False)
            raise OSError(f"another commit took {target}")
        for number in numbers[1:]:  # the one before stays for readers that have just listed it
            fs.delete(self._fs(f"{self.root}/CURRENT-{number:012}")[0], False)


def cluster_edges(edges: DataFrame, files: int, by: str = "toId") -> DataFrame:
    """Edges laid out so that Parquet statistics find one endpoint's rows in few files."""
    return edges.repartitionByRange(files, F.col(by)).sortWithinPartitions(by, "id")
