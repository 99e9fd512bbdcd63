"""A feature cache that follows its inputs: by fold, across applications, published in one step.

A cache is a folder with data and manifests. A manifest names every part (the table of one fold) by a key: a digest of
the fold's windows, the flags, and name, size and time of every source file that the fold depends on. Files of a source
with dates are looked at once, in one aggregate over the files not yet known, for the days they hold; a fold depends on
the files whose days meet one of its windows. So a new or changed file, another fold or another flag makes only those
parts stale that depend on it; all stale folds are built in one pass, and the rest is read as it is.

Data goes to a new folder first and is seen by nobody until the manifest that names it is renamed to the next number,
which fails if another application took that number; then its parts are taken over and the next number is tried.
The driver holds one entry for each source file, as it does to plan a scan.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import Path
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponflow.operators.folds import Fold
from couponflow.session import ROWS_PER_FILE, settings

Days = tuple[str | None, str | None]


@dataclass(frozen=True)
class Source:
    """Files of one input. ``read`` (files to events) is given where folds depend on the days in the files."""

    name: str
    paths: tuple[str, ...]
    read: Callable[[list[str]], DataFrame] | None = None
    received: str = "date_received"
    bought: str = "date"


@dataclass
class Manifest:
    """``parts``: key to fold and folder. ``days``: source, then file mark to first and last day received and bought."""

    number: int = 0
    schema: str | None = None
    parts: dict[str, dict] = field(default_factory=dict)
    days: dict[str, dict[str, list]] = field(default_factory=dict)


class _Files:
    """The few file operations that a cache needs, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def system(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        system = self.system(folder)
        if not system.exists(self.path(folder)):
            return []
        return [s.getPath().getName() for s in system.listStatus(self.path(folder))]

    def listed(self, path: str) -> Iterator[tuple[str, int, int]]:
        """Path, size and time of all data files below ``path``."""
        found = self.system(path).listFiles(self.path(path), True)
        while found.hasNext():
            status = found.next()
            if not status.getPath().getName().startswith(("_", ".")):
                yield status.getPath().toString(), status.getLen(), status.getModificationTime()

    def text(self, path: str) -> str:
        stream = self.system(path).open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.system(path).create(self.path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Whether ``old`` became ``new``; not if ``new`` is there already."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(new).toUri(), self.conf)
        try:
            context.rename(self.path(old), self.path(new), self._no_options())
        except Py4JJavaError as failed:
            if "FileAlreadyExists" in failed.java_exception.getClass().getName():
                return False
            raise
        return True

    def _no_options(self):
        kind = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        return self.jvm.java.lang.reflect.Array.newInstance(kind.valueOf("NONE").getClass(), 0)

    def delete(self, path: str) -> None:
        self.system(path).delete(self.path(path), True)


def code_mark() -> str:
    """Digest of the code that makes features, as a flag for parts that must not outlive it."""
    digest = hashlib.sha256()
    package = Path(__file__).resolve().parents[1]
    for module in sorted(p for d in ("functions", "operators", "plans", "sources") for p in (package / d).glob("*.py")):
        digest.update(module.read_bytes())
    return digest.hexdigest()


def _plain(path: str) -> str:
    """A path without scheme and escapes, the same for listings and for ``input_file_name``."""
    return unquote(urlparse(path).path) if ":" in path.split("/")[0] else path


def _meets(days: Sequence[str | None], start: date | None, end: date | None) -> bool:
    first, last = days
    if first is None:
        return False
    return (end is None or first <= end.isoformat()) and (start is None or last >= start.isoformat())


def depends(fold: Fold, received: Sequence[str | None], bought: Sequence[str | None]) -> bool:
    """Whether a file with these first and last days can change the part of ``fold``."""
    return (
        _meets(received, fold.label_from, fold.label_to)
        or _meets(received, fold.recv_from, fold.recv_to)
        or _meets(bought, fold.buy_from, fold.buy_to)
    )


class FeatureCache:
    """Parts by fold under ``folder``, which all applications that share the cache can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark)
        #: Folds built and folds reused by the last call of :meth:`table`.
        self.built: list[int] = []
        self.reused: list[int] = []

    def table(
        self,
        folds: Sequence[Fold],
        sources: Sequence[Source],
        flags: dict[str, object],
        build: Callable[[list[Fold]], DataFrame],
    ) -> DataFrame:
        """The parts of ``folds``. ``build`` makes those of stale folds, marked by a column ``fold``."""
        manifest = self.latest()
        files = {s.name: {self._mark(f): f[0] for p in s.paths for f in self.files.listed(p)} for s in sources}
        days = {s.name: self._days(s, files[s.name], manifest.days.get(s.name, {})) for s in sources}
        keys = {f.fold: self._key(f, flags, sources, files, days) for f in folds}
        stale = [f for f in folds if keys[f.fold] not in manifest.parts]
        self.built = [f.fold for f in stale]
        self.reused = [f.fold for f in folds if f.fold not in self.built]
        if stale:
            manifest = self._add(manifest, build(stale), {f.fold: keys[f.fold] for f in stale}, days)
        paths = [f"{self.folder}/{manifest.parts[keys[f.fold]]['path']}" for f in folds]
        schema = T.StructType.fromJson(json.loads(manifest.parts[keys[folds[0].fold]]["schema"]))
        return self.spark.read.schema(schema).parquet(*paths)

    def latest(self) -> Manifest:
        numbers = self._numbers()
        if not numbers:
            return Manifest()
        return Manifest(**json.loads(self.files.text(f"{self.folder}/manifest-{numbers[-1]:08d}.json")))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the data that only manifests before the last ``keep`` name, and those manifests. Not while others read."""
        numbers = self._numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        used = {p["path"].split("/")[0] for n in kept for p in self._manifest(n).parts.values()}
        gone = [n for n in self.files.names(self.folder) if n.startswith("data-") and n not in used]
        for name in [f"manifest-{n:08d}.json" for n in old] + gone:
            self.files.delete(f"{self.folder}/{name}")
        return gone

    def forget(self, keys: set[str]) -> None:
        """Publish a manifest without the parts ``keys``."""
        manifest = self.latest()
        manifest.parts = {k: p for k, p in manifest.parts.items() if k not in keys}
        self._publish(manifest)

    def _manifest(self, number: int) -> Manifest:
        return Manifest(**json.loads(self.files.text(f"{self.folder}/manifest-{number:08d}.json")))

    def _numbers(self) -> list[int]:
        names = self.files.names(self.folder)
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    @staticmethod
    def _mark(file: tuple[str, int, int]) -> str:
        return f"{_plain(file[0])}|{file[1]}|{file[2]}"

    def _days(self, source: Source, files: dict[str, str], known: dict[str, list]) -> dict[str, list]:
        """First and last days of every file; only files that are new or changed are read."""
        if source.read is None:
            return {}
        new = {_plain(path): mark for mark, path in files.items() if mark not in known}
        found = {mark: known[mark] for mark in files if mark in known}
        if new:
            ends = [
                f(F.col(c)).cast("string").alias(f"{n}_{c}")
                for c in (source.received, source.bought)
                for n, f in (("first", F.min), ("last", F.max))
            ]
            events = source.read([files[m] for m in new.values()])
            rows = events.groupBy(F.input_file_name().alias("_file")).agg(*ends).collect()
            seen = {_plain(r["_file"]): [[r[1], r[2]], [r[3], r[4]]] for r in rows}
            # A file without rows is in no group and changes nothing.
            found |= {mark: seen.get(path, [[None, None], [None, None]]) for path, mark in new.items()}
        return found

    def _key(self, fold: Fold, flags, sources, files, days) -> str:
        needed = {}
        for source in sources:
            marks = files[source.name]
            if source.read is not None:
                marks = [m for m in marks if depends(fold, *days[source.name][m])]
            needed[source.name] = sorted(marks)
        text = json.dumps([asdict(fold), flags, needed], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def _add(self, manifest: Manifest, rows: DataFrame, keys: dict[int, str], days) -> Manifest:
        name = f"data-{uuid.uuid4().hex}"
        writer = rows.withColumn("part", F.col("fold")).write.partitionBy("part").option("maxRecordsPerFile", ROWS_PER_FILE)
        # A task has a writer for each fold; otherwise all rows, which are wide, would be sorted by fold first.
        with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(len(keys) + 1)}):
            writer.parquet(f"{self.folder}/{name}")
        made = set(self.files.names(f"{self.folder}/{name}"))
        for fold, key in keys.items():
            part = f"{name}/part={fold}"
            if f"part={fold}" not in made:
                # A fold without rows: a table of its own, so that it is not built again and again.
                part = f"{name}/empty-{fold}"
                rows.limit(0).write.parquet(f"{self.folder}/{part}")
            manifest.parts[key] = {"fold": fold, "path": part, "schema": rows.schema.json()}
        manifest.days = days
        return self._publish(manifest)

    def _publish(self, manifest: Manifest) -> Manifest:
        draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        while True:
            manifest.number += 1
            self.files.write(draft, json.dumps(asdict(manifest)))
            if self.files.rename(draft, f"{self.folder}/manifest-{manifest.number:08d}.json"):
                return manifest
            # Another application was first: take over what it has, and try the next number.
            self.files.delete(draft)
            theirs = self.latest()
            manifest.number = theirs.number
            manifest.parts = theirs.parts | manifest.parts
            for source, known in theirs.days.items():
                manifest.days[source] = known | manifest.days.get(source, {})
