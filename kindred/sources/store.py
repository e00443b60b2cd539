"""The store of faces and prototypes: Parquet parts and pointers that name those which make up the table.

A part is never overwritten. Rows that come are a part of their own; a change of rows writes the table anew as one part.
Either way a pointer of a new name is put in place by a rename, so a reader finds the newest whole one at any moment, also
after a crash. Parts that none of the last pointers names are deleted. There is one writer."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import tables
from kindred.functions import vectors as V

FACES = "id long, source string, frame_idx int, track_id int, bbox struct<x1:double,y1:double,x2:double,y2:double>, det_score double, quality double, embedding array<float>, cluster_id int, person_id string, created_at double"


def update_assignments(faces: DataFrame, new: DataFrame) -> DataFrame:
    """``faces`` with cluster_id and person_id of ``new`` (id, cluster_id, person_id) where it has the id, nulls included."""
    own = new.select("id", F.struct("cluster_id", "person_id").alias("new"))
    hit = F.col("new").isNotNull()
    joined = faces.join(own, "id", "left")
    return joined.withColumns({c: F.when(hit, F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("cluster_id", "person_id")}).select(faces.columns)


def labelled(faces: DataFrame) -> DataFrame:
    """The faces that have a person."""
    return faces.filter("person_id IS NOT NULL").select("id", "embedding", "person_id")


class Table:
    """A table under one folder of any file system that Spark writes to."""

    #: Pointers whose parts stay for readers that began before; parts after which an addition writes the table anew.
    POINTERS, PARTS = 5, 64

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        """Names of the pointers, the newest first."""
        where = self._path(f"{self.path}/pointers")
        found = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted((x for x in found if x.endswith(".json") and not x.startswith(".")), reverse=True)

    def _load(self, name: str) -> dict | None:
        try:
            found = json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/pointers/{name}").collect()))
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def meta(self) -> dict:
        return next((m for x in self._pointers() if (m := self._load(x)) is not None), {})

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The table; or the given parts, as a pointer's metadata names them."""
        own = self.meta().get("parts", []) if parts is None else parts
        if not own:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{x}" for x in own))

    def _put(self, rows: DataFrame, keep: list[str], before: dict, meta: dict) -> str:
        part = f"part-{time.time_ns():020d}"
        rows.write.parquet(f"{self.path}/{part}")
        self._point([*keep, part], before, meta)
        return part

    def _point(self, parts: list[str], before: dict, meta: dict) -> None:
        name = f"{time.time_ns():020d}.json"
        temporary, final = self._path(f"{self.path}/pointers/.{name}"), self._path(f"{self.path}/pointers/{name}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({**before, **meta, "parts": parts}).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise OSError(f"{final} can't be put in place")
        self._clean()

    def _named(self, pointer: str) -> set[str]:
        found = self._load(pointer) or {}
        return {*found.get("parts", []), *found.get("base", [])}

    def _clean(self) -> None:
        names = self._pointers()
        if len(names) <= self.POINTERS:
            return
        held = set().union(*map(self._named, names[: self.POINTERS]))
        for n in names[self.POINTERS :]:
            for x in self._named(n) - held:
                self._fs.delete(self._path(f"{self.path}/{x}"), True)
            self._fs.delete(self._path(f"{self.path}/pointers/{n}"), False)

    def note(self, **meta) -> None:
        """Metadata alone."""
        before = self.meta()
        self._point(before.get("parts", []), before, meta)

    def write(self, rows: DataFrame, **meta) -> str:
        """The table anew, as one part, with ``meta`` over what the last pointer says."""
        return self._put(rows, [], self.meta(), meta)

    def append(self, rows: DataFrame, **meta) -> str:
        """One more part; what is stored isn't read, but for once in ``PARTS`` times."""
        before = self.meta()
        kept = before.get("parts", [])
        if len(kept) >= self.PARTS:
            return self._put(self.read(kept).unionByName(rows), [], before, meta)
        return self._put(rows, kept, before, meta)


class FaceStore(Table):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, FACES)

    def add(self, rows: DataFrame, now: float | None = None, **meta) -> None:
        """Appends rows; ids go on from the last one, without gaps, in the order of source, frame and what id they have."""
        before = self.meta()
        last = int(before["last_id"]) if "last_id" in before else int(self.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        names = tables.numbered(rows, "id", *(c for c in ("source", "frame_idx", "track_id", "id") if c in rows.columns), first=last + 1)
        kinds, made = self.spark.createDataFrame([], FACES).dtypes, names
        for name, kind in kinds:
            if name not in made.columns:
                made = made.withColumn(name, F.lit((time.time() if now is None else now) if name == "created_at" else None).cast(kind))
        made = tables.cut(made.select([F.col(n).cast(k).alias(n) for n, k in kinds]))
        self.append(made, last_id=last + made.count(), **meta)
        tables.drop(made)

    def clear(self) -> int:
        n = self.read().count()
        self.write(self.spark.createDataFrame([], FACES), last_id=0)
        return n

    def assign(self, new: DataFrame, **meta) -> None:
        self.write(update_assignments(self.read(), new), **meta)

    def embeddings(self) -> DataFrame:
        return self.read().select("id", "embedding")

    def labelled(self) -> DataFrame:
        return labelled(self.read())


class PrototypeStore(Table):
    def __init__(self, spark: SparkSession, path: str):
        from kindred.operators.identity import SCHEMA

        super().__init__(spark, path, SCHEMA)

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The prototypes, their vectors made unit vectors again; those without one are left out."""
        rows = super().read(parts).filter("vector IS NOT NULL")
        return rows.withColumn("vector", V.l2_normalize(F.col("vector")))

    def next_number(self) -> int:
        """Numbers go on also where persons were deleted."""
        found = self.meta().get("next_number")
        return self.read().count() if found is None else found
