"""Tables of Parquet files that are rewritten in part, with one commit a version.

A version is a manifest, ``_versions/<number>.json``, a list of data files.
A rewrite reads the key column, finds the files that hold a changed row,
writes those anew and leaves the others as they are.  Its manifest is written
aside and given its number by one rename that fails if the number is taken:
of two writers that began at the same version one wins, the other one's files
are removed and its rewrite fails as a whole.  Readers see whole versions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import swapped


class ConflictError(RuntimeError):
    """Another writer has committed the version that a rewrite would make."""


@dataclass(frozen=True)
class Versioned:
    """A table at one version; ``files`` are relative to ``path``."""

    spark: SparkSession
    path: str
    version: int
    files: tuple[str, ...]
    schema: str

    @staticmethod
    def create(df: DataFrame, path: str) -> Versioned:
        """Version 0 of a new table."""
        empty = Versioned(df.sparkSession, path.rstrip("/"), -1, (), df.schema.json())
        return empty._committed(empty._written(df))

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> Versioned:
        """The latest version, or an earlier one."""
        path = path.rstrip("/")
        hadoop, fs = _fs(spark, path)
        numbers = [int(n.removesuffix(".json")) for n in (f.getPath().getName() for f in fs.listStatus(hadoop.Path(f"{path}/_versions"))) if n.removesuffix(".json").isdigit()]
        number = max(numbers) if version is None else version
        about = json.loads("".join(r.value for r in spark.read.text(f"{path}/_versions/{number}.json", wholetext=True).collect()))
        return Versioned(spark, path, number, tuple(about["files"]), about["schema"])

    def read(self) -> DataFrame:
        return self._read(self.files)

    def replace_rows(self, fresh: DataFrame, key: str) -> Versioned:
        """The next version: each row whose key ``fresh`` has (once) gives way to that row; other rows, and other files, stay."""
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        touched = self.read().select(key, name.alias("_file")).join(fresh.select(key).distinct(), key, "left_semi")
        touched = {r["_file"] for r in touched.select("_file").distinct().collect()}  # names of files, no more than the manifest has
        old = tuple(f for f in self.files if f.rsplit("/", 1)[-1] in touched)
        if not old:
            return self
        new = self._written(swapped(self._read(old), fresh, key))
        return self._committed(tuple(f for f in self.files if f not in old) + new, made=new)

    def _read(self, files: tuple[str, ...]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.schema))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def _written(self, df: DataFrame) -> tuple[str, ...]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        hadoop, fs = _fs(self.spark, self.path)
        names = sorted(f.getPath().getName() for f in fs.listStatus(hadoop.Path(f"{self.path}/{folder}")))
        return tuple(f"{folder}/{n}" for n in names if n.endswith(".parquet"))

    def _committed(self, files: tuple[str, ...], made: tuple[str, ...] = ()) -> Versioned:
        number = self.version + 1
        hadoop, fs = _fs(self.spark, self.path)
        target, aside = hadoop.Path(f"{self.path}/_versions/{number}.json"), hadoop.Path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"files": files, "schema": self.schema}).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, target, none)  # fails if the target is there
        except Py4JJavaError as e:
            for f in (aside, *map(hadoop.Path, sorted({f"{self.path}/{m.rsplit('/', 1)[0]}" for m in made}))):
                fs.delete(f, True)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise ConflictError(f"version {number} of {self.path} is taken") from None
        return Versioned(self.spark, self.path, number, files, self.schema)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
