"""Tables in versions: written aside, published by one atomic step, read as of a version.

A version is a small manifest, ``_versions/<number>.json``: the folders of the
table's parts, and a note.  A write stages new parts in folders of their own and
then moves a finished manifest to the next number, which fails if that number is
taken.  So readers see the old version or the new one, never a mixture; a failed
attempt leaves folders that no manifest names, and ``clean`` removes them.  Parts
that did not change are named again, not copied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.sources.scratch import filesystem, removed


class Conflict(RuntimeError):
    """Another writer has published since the version that this write began from."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, str]
    note: dict = field(default_factory=dict)


class Versions:
    """The versions of one table under ``path``; one writer at a time succeeds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        system, p = filesystem(self.spark, f"{self.path}/_versions")
        if not system.exists(p):
            return []
        names = (s.getPath().getName() for s in system.listStatus(p))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The version of that number, or the newest; null if there is none."""
        if number is None:
            known = self.numbers()
            if not known:
                return None
            number = known[-1]
        system, p = filesystem(self.spark, f"{self.path}/_versions/{number:012d}.json")
        stream = system.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def read(self, version: Version | None = None, parts: Iterable[str] | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default), pinned to its folders; null if it has none of the ``parts``."""
        at = version or self.version()
        folders = [f for name, f in sorted(at.parts.items()) if parts is None or name in set(parts)] if at else []
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def stage(self, rows: DataFrame, *by: str) -> str:
        """Write rows to a folder that no version names yet, with a folder inside for each value of ``by``."""
        name = f"data/{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*by) if by else rows.write
        writer.parquet(f"{self.path}/{name}")
        return name

    def publish(self, parts: dict[str, str], base: Version | None, note: dict | None = None) -> Version:
        """Make ``parts`` the version after ``base`` (null: the first)."""
        made = Version(base.number + 1 if base else 1, dict(parts), note or {})
        draft, to = (f"{self.path}/_versions/{n}" for n in (f"draft-{uuid.uuid4().hex}", f"{made.number:012d}.json"))
        system, p = filesystem(self.spark, draft)
        out = system.create(p, False)
        try:
            out.write(json.dumps({"parts": made.parts, "note": made.note}).encode())
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(system.makeQualified(p), system.makeQualified(jvm.org.apache.hadoop.fs.Path(to)), never_over)
        except Exception as error:
            system.delete(p, False)
            if made.number in self.numbers():
                raise Conflict(f"version {made.number} exists") from error
            raise
        return made

    def clean(self, keep: int = 2) -> list[str]:
        """Remove older versions than the last ``keep`` and all folders that none of these names; the writer calls it between writes."""
        numbers = self.numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        named = {f.split("/")[1] for v in kept for f in v.parts.values()}
        gone = [f"_versions/{n:012d}.json" for n in numbers[:-keep]]
        for inside, spared in (("data", named), ("_versions", {f"{n:012d}.json" for n in numbers})):
            system, p = filesystem(self.spark, f"{self.path}/{inside}")
            if system.exists(p):
                gone += [f"{inside}/{s.getPath().getName()}" for s in system.listStatus(p) if s.getPath().getName() not in spared]
        for name in gone:
            removed(self.spark, f"{self.path}/{name}")
        return gone


def rewritten(table: Versions, change, note: dict | None = None) -> Version:
    """The next version of a table of one part: ``change`` gets the newest rows (null for none) and returns all rows."""
    base = table.version()
    return table.publish({"rows": table.stage(change(table.read(base) if base else None))}, base, note)
