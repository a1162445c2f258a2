"""An archive as a folder of Parquet tables in generations: append, remove, subset, merge, verify, all committed by a manifest row."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import live, newest


def params_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


def visit_shards(df: DataFrame, shard: str, visit: Callable[[object, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """visit(shard value, its rows in batches) for every shard, shard by shard within a task: rows of a shard come together and in
    batches, so none is held whole; tasks run side by side. Null shards are one shard."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, group in groupby((g for p in parts for g in split(p)), key=lambda x: x[0]):
            yield from visit(key, (rows for _, rows in group))

    def split(p: pd.DataFrame) -> Iterator[tuple[object, pd.DataFrame]]:
        marks = p[shard].astype(object).where(p[shard].notna(), None)
        for _, rows in p.groupby((marks != marks.shift()).where(~(marks.isna() & marks.shift().isna()), False).cumsum(), sort=False):
            yield marks.loc[rows.index[0]], rows

    return df.repartition(shard).sortWithinPartitions(shard).mapInPandas(run, schema)


def completed(headers: DataFrame, rows: DataFrame, key: str = "taxon") -> DataFrame:
    """Rows of the taxa whose last header says COMPLETE: what a writer that died left half done is not read. headers: key, stage, at."""
    last = headers.groupBy(key).agg(F.max_by("stage", "at").alias("_stage")).where("_stage = 'COMPLETE'")
    return rows.join(last.select(key), key, "left_semi")


class Dataset:
    """Tables under root: one folder per table and generation, and `_manifest`, whose rows make generations visible."""

    MANIFEST = "generation int, table string, path string, kind string, n_rows bigint, params string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: dict[str, DataFrame], params: dict | None = None) -> Dataset:
        d = cls(spark, root)
        d._commit(1, {k: (v, "data") for k, v in tables.items()}, params or {})
        return d

    def _commit(self, generation: int, tables: dict[str, tuple[DataFrame, str]], params: dict) -> None:
        """Write the tables, then the manifest rows that make them visible. A generation that another writer has claimed fails: the claim
        is a folder that the file system creates for one of them only."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{generation}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(path.getParent())
        if not fs.createNewFile(path):
            raise RuntimeError(f"generation {generation} of {self.root} is claimed by another writer")
        rows = []
        for name, (df, kind) in tables.items():
            path = f"{name}/g{generation}-{uuid.uuid4().hex[:8]}"
            df.withColumn("generation", F.lit(generation)).write.parquet(f"{self.root}/{path}")
            rows.append((generation, name, path, kind, self.spark.read.parquet(f"{self.root}/{path}").count(), params_hash(params)))
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/_manifest")

    def generation(self) -> int:
        return self.manifest().agg(F.max("generation")).first()[0]

    def _read(self, name: str, kind: str) -> DataFrame | None:
        paths = [f"{self.root}/{r.path}" for r in self.manifest().where((F.col("table") == name) & (F.col("kind") == kind)).collect()]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def rows(self, name: str, key: str = "genome_id") -> DataFrame:
        """Newest row of each key, deleted or not."""
        return newest(self._read(name, "data"), key)

    def live(self, name: str, key: str = "genome_id") -> DataFrame:
        rows, gone = self.rows(name, key), self._read("tombstones", "tombstone")
        return rows if gone is None else live(rows, gone)

    def append(self, tables: dict[str, DataFrame], params: dict | None = None) -> None:
        self._commit(self.generation() + 1, {k: (v, "data") for k, v in tables.items()}, params or {})

    def remove(self, ids: DataFrame) -> None:
        """Deletions are tombstones alone; rows stay where they are."""
        self._commit(self.generation() + 1, {"tombstones": (ids.select("genome_id").distinct(), "tombstone")}, {})

    def rebuild(self, root: str, tables: dict[str, Callable[[DataFrame], DataFrame]], source: str, params: dict) -> Dataset:
        """A new archive from this one's live rows of `source`: each table is made again from them, unless the parameters are those this
        archive was made with; then it is taken over as it is."""
        made = {r.params for r in self.manifest().where("kind = 'data' and generation = 1").select("params").distinct().collect()}
        same = made == {params_hash(params)}
        base = self.live(source).drop("generation")
        out = {source: base} | {t: self.live(t).drop("generation") if same else make(base) for t, make in tables.items()}
        return Dataset.create(self.spark, root, out, params)

    def subset(self, root: str, keep: DataFrame, tables: list[str]) -> Dataset:
        """Same ids, kept rows only."""
        return Dataset.create(self.spark, root, {t: self.live(t).drop("generation").join(keep.select("genome_id").distinct(), "genome_id", "left_semi") for t in tables})

    def replace_column(self, name: str, new: DataFrame, column: str) -> None:
        """Write back a scored column: what was known must not be lost, or the call fails."""
        old = self.rows(name).select("genome_id", F.col(column).alias("_old"))
        joined = old.join(new.select("genome_id", F.col(column).alias("_new")), "genome_id", "left")
        lost = joined.where("_old is not null and _new is null").limit(1).count()
        if lost:
            raise ValueError(f"{column}: known values would be lost")
        rest = self.rows(name).drop(column, "generation").join(new.select("genome_id", column), "genome_id", "left")
        self.append({name: rest})

    def verify(self, name: str, others: list[str]) -> DataFrame:
        """Rows of each table against the catalogue, and against what the manifest says."""
        base = self.rows(name).select("genome_id")
        out = None
        for t in others:
            have = self.rows(t).select("genome_id").distinct()
            row = base.join(have.withColumn("_has", F.lit(1)), "genome_id", "left").agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("expected"), F.count("_has").alias("present"))
            out = row if out is None else out.unionByName(row)
        said = self.manifest().groupBy("table").agg(F.sum("n_rows").alias("manifest_rows"))
        return out.join(said, "table", "left")
