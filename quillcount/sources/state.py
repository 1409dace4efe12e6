"""A versioned table of counts for each root: Parquet generations and a pointer.

A commit writes a whole new generation beside the old one and then renames a new pointer over the old, under a
lock, so a reader sees one generation or the other. Spark writes the entries; the pointer is a small JSON file.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators import invalidation as inv
from .files import canonical_root, root_name

SCHEMA_VERSION = inv.SCHEMA_VERSION
ENTRIES = "path string, size long, mtime_ns long, digest string, classification string, characters long, words long, lines long, methods map<string,bigint>"


class StateError(Exception):
    """A store's failure; kind names it."""

    kind = "persistence"


class Conflict(StateError):
    kind = "conflict"


class Corrupt(StateError):
    kind = "corrupt"


class Incompatible(StateError):
    kind = "incompatible"


class LockTimeout(StateError):
    kind = "lock"


@dataclass
class Snapshot:
    root: str
    schema_version: int
    generation: int
    entries: DataFrame | None


@dataclass
class Status:
    root: str
    present: bool
    schema_version: int = 0
    entries: int = 0
    bytes: int = 0
    generation: int = 0
    modified_at: float | None = None


class ParquetStore:
    """load, commit, commit_and_prune, status, clear: state of any number of roots below one folder."""

    def __init__(self, spark: SparkSession, folder: str, lock_seconds: float = 30.0) -> None:
        if os.path.exists(folder) and not os.path.isdir(folder):
            raise NotADirectoryError(folder)
        self.spark, self.folder, self.lock_seconds = spark, folder, lock_seconds

    def _home(self, root: str) -> str:
        return os.path.join(self.folder, root_name(root))

    def _pointer(self, root: str) -> str:
        return os.path.join(self._home(root), "pointer.json")

    @contextlib.contextmanager
    def _locked(self, root: str) -> Iterator[None]:
        os.makedirs(self._home(root), mode=0o700, exist_ok=True)
        end = time.monotonic() + self.lock_seconds
        with open(os.path.join(self._home(root), "lock"), "w") as f:
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() > end:
                        raise LockTimeout(root) from None
                    time.sleep(0.01)
            yield

    def _quarantine(self, root: str, kind: str) -> None:
        os.rename(self._pointer(root), os.path.join(self._home(root), f"pointer.quarantine-{kind}-{time.time_ns()}"))

    def _read(self, root: str) -> dict | None:
        try:
            with open(self._pointer(root)) as f:
                raw = f.read()
        except FileNotFoundError:
            return None
        try:
            found = json.loads(raw)
            complete = {*found} >= {"schema_version", "root", "generation", "folder"} and os.path.isdir(os.path.join(self._home(root), found["folder"]))
        except ValueError:
            complete = False
        if not complete:
            self._quarantine(root, "corrupt")
            raise Corrupt(root)
        if found["schema_version"] != SCHEMA_VERSION or found["root"] != canonical_root(root):
            self._quarantine(root, "incompatible")
            raise Incompatible(root)
        return found

    def load(self, root: str) -> Snapshot | None:
        """The latest generation, or None. What can't be used is moved aside and raised as what it is."""
        found = self._read(root)
        if found is None:
            return None
        entries = self.spark.read.schema(ENTRIES).parquet(os.path.join(self._home(root), found["folder"]))
        try:  # every page is read here once, so that damage shows now and not in a later plan
            entries.write.format("noop").mode("overwrite").save()
        except (PySparkException, Py4JJavaError) as failure:
            self._quarantine(root, "corrupt")
            raise Corrupt(f"{root}: {str(failure)[:200]}") from failure
        return Snapshot(found["root"], found["schema_version"], found["generation"], entries)

    def _publish(self, root: str, generation: int, entries: DataFrame) -> int:
        home = self._home(root)
        name = f"generation-{generation}-{uuid.uuid4().hex[:8]}"
        inv.checked(entries).sort("path").write.parquet(os.path.join(home, name))
        temporary = os.path.join(home, f".pointer-{uuid.uuid4().hex[:8]}")
        with open(temporary, "w") as f:
            json.dump({"schema_version": SCHEMA_VERSION, "root": canonical_root(root), "generation": generation, "folder": name}, f)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, 0o600)
        os.replace(temporary, self._pointer(root))
        # The generation before stays, as a reader may hold it; older ones go.
        for old in sorted((p for p in os.listdir(home) if p.startswith("generation-") and p != name), key=lambda p: int(p.split("-")[1]))[:-1]:
            shutil.rmtree(os.path.join(home, old), ignore_errors=True)
        return generation

    def commit(self, root: str, updates: DataFrame, base_generation: int = 0) -> int:
        """Merge updates that were made on top of a generation; the new generation.

        A stored generation older than the base is a conflict. On a newer one, only updates that agree with it are
        merged; if there were some and none does, that is a conflict too.
        """
        return self._commit(root, updates, base_generation, None)

    def commit_and_prune(self, root: str, updates: DataFrame, observed: DataFrame, base_generation: int = 0, full_walk: bool = True) -> int:
        """commit, and drop entries whose path wasn't observed unless another writer came between. Nothing to do: no new generation."""
        if not full_walk:
            raise PermissionError("pruning needs a full walk")
        return self._commit(root, updates, base_generation, observed)

    def _commit(self, root: str, updates: DataFrame, base: int, observed: DataFrame | None) -> int:
        with self._locked(root):
            recovered = False
            try:
                latest = self.load(root)
            except (Corrupt, Incompatible):
                latest, recovered = None, True
            stored = latest.generation if latest else 0
            if latest and stored < base or not latest and base and not recovered:
                raise Conflict(f"generation {stored} is older than {base}")
            entries = latest.entries if latest else self.spark.createDataFrame([], ENTRIES)
            moved = stored > base
            if moved and latest:
                agreed = inv.compatible_updates(entries, updates)
                if agreed.isEmpty() and not updates.isEmpty():
                    raise Conflict("all updates were overtaken")
                updates = agreed
            merged = inv.merge(entries, updates)
            if observed is not None and not moved:
                gone = entries.join(observed, "path", "left_anti")
                if latest and updates.isEmpty() and gone.isEmpty():
                    return stored
                merged = inv.prune(merged, observed, True)
            return self._publish(root, stored + 1, merged)

    def status(self, root: str) -> Status:
        found = self._read(root)
        if found is None:
            return Status(canonical_root(root), False)
        folder = os.path.join(self._home(root), found["folder"])
        size = sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder))
        n = self.spark.read.schema(ENTRIES).parquet(folder).count()
        return Status(found["root"], True, found["schema_version"], n, size, found["generation"], os.path.getmtime(self._pointer(root)))

    def clear(self, root: str) -> None:
        """Forget a root; its lock stays."""
        with self._locked(root):
            for p in os.listdir(self._home(root)):
                path = os.path.join(self._home(root), p)
                if p != "lock":
                    shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)

    def clear_all(self) -> None:
        if os.path.isdir(self.folder):
            for p in os.listdir(self.folder):
                shutil.rmtree(os.path.join(self.folder, p), ignore_errors=True)


class MemoryStore:
    """A double for tests: entries as plain rows; a commit needs the very generation it was based on."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.roots = spark, {}

    def load(self, root: str) -> Snapshot | None:
        if root not in self.roots:
            return None
        generation, rows = self.roots[root]
        return Snapshot(root, SCHEMA_VERSION, generation, self.spark.createDataFrame(rows, ENTRIES))

    def commit(self, root: str, updates: DataFrame, base_generation: int = 0) -> int:
        held = self.load(root)
        if (held.generation if held else 0) != base_generation:
            raise Conflict(root)
        merged = inv.merge(held.entries if held else self.spark.createDataFrame([], ENTRIES), updates)
        self.roots[root] = (base_generation + 1, merged.select("path", *inv.ENTRY).collect())
        return base_generation + 1

    def commit_and_prune(self, root: str, updates: DataFrame, observed: DataFrame, base_generation: int = 0, full_walk: bool = True) -> int:
        generation = self.commit(root, updates, base_generation)
        kept = inv.prune(self.load(root).entries, observed, full_walk).select("path", *inv.ENTRY).collect()
        self.roots[root] = (generation, kept)
        return generation

    def status(self, root: str) -> Status:
        held = self.roots.get(root)
        return Status(root, True, SCHEMA_VERSION, len(held[1]), 0, held[0]) if held else Status(root, False)

    def clear(self, root: str) -> None:
        self.roots.pop(root, None)

    def clear_all(self) -> None:
        self.roots.clear()
