"""Incremental views of a changing source tree, by Structured Streaming.

Changes come as rows (path, version, text); a null text is a removal. The newest
version of a path wins, whatever order rows arrive in. A batch parses only the files
whose content changed. References are bound again when a batch changed anything, and
only the changed files are parsed for it; the inheritance closure is kept unless
declarations changed. Every batch's state lies in the folder under its number, so a
query that starts again from its checkpoint goes on from the state of its last batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..apex import bind
from ..apex.facts import facts, relation
from ..storage import shared_dir
from ..storage import _fs as fs_of

CHANGES = "path string, version long, text string"


def fingerprint(text):
    return F.xxhash64(text)


def newest(changes: DataFrame) -> DataFrame:
    """One row per path: its greatest version."""
    g = changes.groupBy("path").agg(F.max_by(F.struct("version", "text"), "version").alias("m"))
    return g.select("path", F.col("m.version").alias("version"), F.col("m.text").alias("text"))


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (path, version, text) after changes; older versions are ignored. A removal
    stays as a row without text, so that an older version cannot bring the file back."""
    return newest(files.unionByName(newest(changes)))


def dirty(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Paths whose content differs from what is known; equal content is no change."""
    old = files.select("path", F.col("version").alias("v0"), fingerprint("text").alias("h0"))
    new = newest(changes).join(old, "path", "left")
    fresh = F.col("v0").isNull() | (F.col("version") > F.col("v0"))
    return new.where(fresh & ~F.col("h0").eqNullSafe(fingerprint("text"))).select("path", "text")


def declarations(symbols: DataFrame) -> DataFrame:
    """(path, h): a hash of what other files can see of each file."""
    s = symbols.where("kind not in ('LocalVar','CatchVar','ForEachVar','SwitchBindingVar')")
    h = F.xxhash64("kind", "name", "container", "type_name", "modifiers", "visibility", "supers")
    return s.groupBy("path").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("local", h.alias("h"))))).alias("h"))


class Incremental:
    """State between batches: files, their facts, and the program bound from them."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """folder: where states are kept; a new one in the shared folder if not given."""
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}").rstrip("/")
        self.rebinds = 0
        self.version = 0
        self.files = spark.createDataFrame([], CHANGES)
        self.facts = facts(spark.createDataFrame([], "path string, text string"))
        self._program: bind.Program | None = None
        self._closure: DataFrame | None = None
        last = self._last()
        if last:
            self._load(*last)

    # -- states ------------------------------------------------------------
    def _last(self) -> tuple[int, int] | None:
        fs, p = fs_of(self.spark, f"{self.folder}/states")
        if not fs.exists(p):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/states/{n}/meta/_SUCCESS"))]
        if not done:
            return None
        name = max(done, key=int)
        meta = json.loads(self.spark.read.text(f"{self.folder}/states/{name}/meta").first()[0])
        return int(name), meta["rebinds"]

    def _load(self, version: int, rebinds: int) -> None:
        at = f"{self.folder}/states/{version}"
        self.version, self.rebinds = version, rebinds
        self.files = self.spark.read.parquet(f"{at}/files")
        self.facts = self.spark.read.parquet(f"{at}/facts")
        self._program = None

    def _store(self, version: int, files: DataFrame, known: DataFrame) -> None:
        """The state of a batch; the one before the last goes."""
        at = f"{self.folder}/states/{version}"
        files.write.mode("overwrite").parquet(f"{at}/files")
        known.write.mode("overwrite").parquet(f"{at}/facts")
        meta = self.spark.createDataFrame([(json.dumps({"rebinds": self.rebinds}),)], "value string")
        meta.coalesce(1).write.mode("overwrite").text(f"{at}/meta")
        old, self.version = self.version, version
        self._load(version, self.rebinds)
        fs, p = fs_of(self.spark, f"{self.folder}/states")
        for s in fs.listStatus(p):
            if s.getPath().getName().isdigit() and int(s.getPath().getName()) not in (old, version):
                fs.delete(s.getPath(), True)

    # -- views -------------------------------------------------------------
    @property
    def symbols(self) -> DataFrame:
        return relation(self.facts, "symbols")

    @property
    def uses(self) -> DataFrame:
        return relation(self.facts, "uses")

    @property
    def program(self) -> bind.Program:
        """The relations bound from the kept facts: no file is parsed for it."""
        if self._program is None:
            self._program = bind.Program(self.files.where("text is not null").select("path", "text"), known=self.facts)
            self._program._closure = self._closure
        return self._program

    def batch(self, changes: DataFrame, epoch: int) -> None:
        """For foreachBatch. A batch seen before changes nothing: its number is not
        above that of the state, and its versions are not newer."""
        if epoch + 1 <= self.version:
            return
        todo = dirty(self.files, changes).persist()
        try:
            files = apply_changes(self.files, changes)
            if not todo.take(1):
                self._store(epoch + 1, files, self.facts)
                return
            before = declarations(self.symbols)
            kept = self.facts.join(todo.select("path"), "path", "left_anti").select(self.facts.columns)
            known = kept.unionByName(facts(todo.where("text is not null")))
            after = declarations(relation(known, "symbols"))
            moved = bool(before.exceptAll(after).take(1) or after.exceptAll(before).take(1))
            self.rebinds += moved
            if moved:
                self._closure = None
            elif self._program is not None:
                self._closure = self._program.closure
            self._store(epoch + 1, files, known)
        finally:
            todo.unpersist()


def start(changes: DataFrame, state: Incremental, checkpoint: str, trigger: str = "500 milliseconds", then: Callable[[Incremental], None] | None = None):
    """A streaming query that keeps state up to date with a stream of changes."""

    def each(df: DataFrame, epoch: int) -> None:
        state.batch(df, epoch)
        if then:
            then(state)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
