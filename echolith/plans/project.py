"""Stages with fingerprints: a stage runs again only when its settings, input files or upstream change."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """run gets the session, the settings and the results it comes after; a stage that is not enabled is left out."""

    name: str
    run: Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    settings: tuple[str, ...] = ()
    version: int = 1
    enabled: Callable[[dict], bool] = lambda config: True


@dataclass
class Project:
    """Stages whose results are Parquet tables below ``path``, one folder for each fingerprint.

    Settings that name files or folders count with the sizes and times of
    these. All paths go through Spark's file systems, so they may be remote.
    """

    path: str
    stages: list[Stage]
    config: dict = field(default_factory=dict)

    def fingerprints(self, spark: SparkSession) -> dict[str, str]:
        out: dict[str, str] = {}
        for s in self.stages:
            used = {k: self.config.get(k) for k in s.settings}
            parts = [s.name, s.version, used, [self._stamp(spark, v) for v in used.values()], [out[a] for a in s.after]]
            out[s.name] = hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]
        return out

    def needed(self, wanted: list[str] | None = None) -> list[Stage]:
        """The wanted stages and all that they come after, in order."""
        by_name, names = {s.name: s for s in self.stages}, set()
        todo = list(wanted or by_name)
        while todo:
            if (n := todo.pop()) not in names:
                names.add(n)
                todo += by_name[n].after
        return [s for s in self.stages if s.name in names]

    def status(self, spark: SparkSession) -> dict[str, str]:
        """done, failed (with these settings), outdated (done with others), skipped or pending."""
        prints, out = self.fingerprints(spark), {}
        fs, root = self._at(spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        for s in self.stages:
            at = f"{s.name}-{prints[s.name]}"
            runs = [n for n in names if n.rpartition("-")[0] == s.name and not n.endswith(".failed") and self._exists(spark, f"{n}/_SUCCESS")]
            out[s.name] = "skipped" if not s.enabled(self.config) else "done" if at in runs else "failed" if f"{at}.failed" in names else "outdated" if runs else "pending"
        return out

    def run(self, spark: SparkSession, wanted: list[str] | None = None, force: bool = False) -> dict[str, DataFrame]:
        """The results of the wanted stages and of what they need; the first stage that fails is marked and ends the run."""
        prints, out = self.fingerprints(spark), {}
        for s in self.needed(wanted):
            if not s.enabled(self.config):
                continue
            at = f"{s.name}-{prints[s.name]}"
            if force or not self._exists(spark, f"{at}/_SUCCESS"):
                try:
                    s.run(spark, self.config, {a: out[a] for a in s.after if a in out}).write.mode("overwrite").parquet(self._full(at))
                except Exception as e:
                    self._mark(spark, f"{at}.failed", f"{type(e).__name__}: {e}")
                    raise
                self._unmark(spark, f"{at}.failed")
            out[s.name] = spark.read.parquet(self._full(at))
        return out

    def _full(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    @staticmethod
    def _at(spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _exists(self, spark: SparkSession, name: str) -> bool:
        fs, at = self._at(spark, self._full(name))
        return fs.exists(at)

    def _mark(self, spark: SparkSession, name: str, text: str) -> None:
        fs, at = self._at(spark, self._full(name))
        stream = fs.create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _unmark(self, spark: SparkSession, name: str) -> None:
        fs, at = self._at(spark, self._full(name))
        fs.delete(at, False)

    def _stamp(self, spark: SparkSession, value) -> list | None:
        """Size, number and latest time of the files that a setting names; None if it names none."""
        if not isinstance(value, str) or "/" not in value:
            return None
        try:
            fs, at = self._at(spark, value)
            if not fs.exists(at):
                return None
        except Exception:  # no path at all
            return None
        held, found = fs.getContentSummary(at), [fs.getFileStatus(at).getModificationTime()]
        if fs.getFileStatus(at).isDirectory():
            files = fs.listFiles(at, True)
            while files.hasNext():
                found.append(files.next().getModificationTime())
        return [held.getLength(), held.getFileCount(), max(found)]
