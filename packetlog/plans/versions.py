"""Tables kept as versions behind a commit log.

Under a root folder lie data folders (Parquet, written by one Spark job each, never
changed) and ``_log``: one small file per version that lists the data folders of that
version, the number of ids given out (``next_id``) and an ``epoch`` that every clear
advances. A version exists from the moment its file does, and the file is created
complete and only if its number is free, so of two writers one commits and the other
sees the new version and applies its change to that. Readers take the newest
version; nothing they read is overwritten, and a writer that is lost leaves at most a
data folder that no version names.

Ids are reserved in the log before rows are written: concurrent imports get disjoint
ranges without reading old rows. A range whose import fails stays unused, as with a
database's counter.

A table may keep a derived one (a roll-up): rows made from each data folder, written
once and committed with it. The log names the derived folders and the data folders they
cover, so readers get both of one version, and data that an other writer added without
is derived when read.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path

KEPT_VERSIONS = 2


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists_error(error: Py4JJavaError) -> bool:
    return "FileAlreadyExists" in error.java_exception.getClass().getName()


def rename_if_free(spark: SparkSession, source: str, target: str) -> bool:
    """Rename that fails if the target exists: one step on a distributed store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, options)
        return True
    except Py4JJavaError as error:
        if _exists_error(error):
            return False
        raise


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file at ``path`` unless there is one; false if there is.

    The text is written to a file of another name, which then gets the name: by a hard
    link on a local file system (one step even between threads), by a rename elsewhere."""
    jvm = spark.sparkContext._jvm
    target, fs = _file_system(spark, path)
    parent = target.getParent()
    fs.mkdirs(parent)
    draft = jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        place = fs.resolvePath(draft)
        if place.toUri().getScheme() != "file":
            return rename_if_free(spark, draft.toString(), path)
        source = jvm.java.nio.file.Paths.get(place.toUri())
        try:
            jvm.java.nio.file.Files.createLink(source.resolveSibling(target.getName()), source)
            return True
        except Py4JJavaError as error:
            if _exists_error(error):
                return False
            raise
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file, such as one of ``create_once``."""
    hpath, fs = _file_system(spark, path)
    stream = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Measure:
    """Facts about rows, taken while they are written and kept in the log.

    ``columns``: named aggregates; ``merge``: the facts of two sets of rows as those of
    both; ``pays``: whether rows with such facts get derived rows stored."""

    def __init__(self, columns: list[Column], merge: Callable[[dict, dict], dict], pays: Callable[[dict], bool]):
        self.columns, self.merge, self.pays = columns, merge, pays


class VersionedTable:
    """A table of ``schema`` at ``root``; the last ``kept`` versions stay readable."""

    def __init__(self, spark: SparkSession, root: str, schema, kept: int = KEPT_VERSIONS,
                 derive: Callable[[DataFrame], DataFrame] | None = None, measure: "Measure | None" = None):
        self.spark, self.root, self.schema, self.kept = spark, root.rstrip("/"), schema, kept
        self.derive, self.measure = derive, measure

    # -------------------------------------------------------------- versions

    def _entry(self, version: int) -> str:
        return f"{self.root}/_log/{version:020d}.json"

    def versions(self) -> list[int]:
        path, fs = _file_system(self.spark, f"{self.root}/_log")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict:
        """The log entry of a version (default: the newest; of a new table: empty)."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "folders": [], "next_id": 0, "epoch": 0}
        return json.loads(read_text(self.spark, self._entry(version)))

    def commit(self, now: dict, **changes) -> bool:
        """Make the version after ``now``; false if another writer has made it."""
        new = now | changes | {"version": now["version"] + 1, "time": _dt.datetime.now(_dt.timezone.utc).isoformat()}
        if not create_once(self.spark, self._entry(new["version"]), json.dumps(new)):
            return False
        self._sweep(new["version"])
        return True

    def _sweep(self, newest: int) -> None:
        """Remove the data folders that only versions older than the kept ones name."""
        first = newest - self.kept + 1
        if first <= 1:
            return
        named = lambda v: {f for key in ("folders", "derived") for f in self.state(v).get(key, [])}
        kept = {f for v in range(first, newest + 1) for f in named(v)}
        for folder in named(first - 1) - kept:
            self.discard(folder)

    # ------------------------------------------------------------------ data

    def write(self, rows: DataFrame) -> str:
        """Write rows as a data folder that no version names yet."""
        return self._write(rows.select(*self.schema.names), "v")

    def _write(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}={uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.root}/{folder}")
        except Exception:
            self.discard(folder)
            raise
        return folder

    def discard(self, folder: str) -> None:
        delete_path(self.spark, f"{self.root}/{folder}")

    def _rows(self, state: dict) -> DataFrame:
        if not state["folders"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in state["folders"]])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version))

    # --------------------------------------------------------------- derived

    def _write_measured(self, rows: DataFrame) -> tuple[str, dict | None]:
        """A new data folder and the facts about its rows."""
        if not self.measure:
            return self.write(rows), None
        seen = Observation()
        folder = self.write(rows.select(*self.schema.names).observe(seen, *self.measure.columns))
        return folder, seen.get

    def facts(self, state: dict | None = None) -> dict | None:
        """Facts about all rows of a version, or None if some were not measured."""
        state = state or self.state()
        known = state.get("measured", {})
        return known["facts"] if state["folders"] and known.get("folders") == state["folders"] else None

    def _derived(self, folder: str, facts: dict | None) -> list[str]:
        """The folder of the rows derived from a data folder, if this table keeps any."""
        if not self.derive or facts is not None and not self.measure.pays(facts):
            return []
        return [self._write(self.derive(self._rows({"folders": [folder]})), "d")]

    def _read_derived(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def read_derived(self, version: int | None = None) -> DataFrame:
        """Derived rows of every data folder of a version, not merged."""
        state = self.state(version)
        folders, covers = state["folders"], state.get("covers", [])
        kept = state.get("derived", []) if set(covers) <= set(folders) else []
        if not kept:
            return self.derive(self._rows(state))
        rest = [f for f in folders if f not in covers]
        rows = self._read_derived(kept)
        return rows.unionByName(self.derive(self._rows({"folders": rest}))) if rest else rows

    def merge_derived(self, merge: Callable[[DataFrame], DataFrame], least: int = 2) -> None:
        """Put one folder in place of the derived ones, if there are ``least`` of them."""
        while True:
            now = self.state()
            if len(now.get("derived", [])) < max(least, 2) or not set(now["covers"]) <= set(now["folders"]):
                return
            folder = self._write(merge(self._read_derived(now["derived"])), "d")
            if self.commit(now, derived=[folder]):
                return
            self.discard(folder)

    # --------------------------------------------------------------- changes

    def replace(self, make: Callable[[DataFrame], DataFrame]) -> str:
        """New content from the current one. If another writer commits meanwhile, it
        is made again from theirs, so no change is lost. Returns its path."""
        while True:
            now = self.state()
            folder = self.write(make(self._rows(now)))
            if self.commit(now, folders=[folder], derived=[], covers=[]):
                return f"{self.root}/{folder}"
            self.discard(folder)

    def clear(self) -> None:
        """No rows; ids start again."""
        while True:
            now = self.state()
            if self.commit(now, folders=[], derived=[], covers=[], next_id=0, epoch=now["epoch"] + 1):
                return

    def append(self, rows: DataFrame, n: int, id_col: str = "id") -> None:
        """Add rows whose ids run from 1 to at most ``n``, moved behind all ids that
        were given out before."""
        while True:
            now = self.state()
            if not self.commit(now, next_id=now["next_id"] + n):
                continue  # another writer took the range
            folder, facts = self._write_measured(rows.withColumn(id_col, F.col(id_col) + now["next_id"]))
            derived = self._derived(folder, facts)
            while (state := self.state())["epoch"] == now["epoch"]:
                more = {"derived": [*state.get("derived", []), *derived], "covers": [*state.get("covers", []), folder]} if derived else {}
                if facts is not None and (not state["folders"] or self.facts(state)):
                    both = self.measure.merge(self.facts(state), facts) if state["folders"] else facts
                    more["measured"] = {"folders": [*state["folders"], folder], "facts": both}
                if self.commit(state, folders=[*state["folders"], folder], **more):
                    return
            for f in (folder, *derived):
                self.discard(f)  # cleared meanwhile: the ids start again

    def renew(self, rows: DataFrame, n: int) -> None:
        """These rows, ids 1 to at most ``n``, in place of all others, in one step."""
        folder, facts = self._write_measured(rows)
        derived = self._derived(folder, facts)
        measured = {} if facts is None else {"folders": [folder], "facts": facts}
        while True:
            now = self.state()
            if self.commit(now, folders=[folder], derived=derived, covers=[folder] if derived else [], measured=measured,
                           next_id=n, epoch=now["epoch"] + 1):
                return
