"""Inbox state as a log of commits over parts, one set of rows per source.

A commit is a small file ``log/<n>.json`` that names, for every source, the part folder with its rows. A
writer puts the rows of the sources it changed into a new part and commits a log entry that keeps all other
sources where they are; their files are not touched. Many sources may share a part: rows lie in Parquet
folders by a digest of the source id, so a reader opens only the sources it wants.

Writers don't wait for each other. The log file is created only if it does not exist; of two writers of the
same number one loses, reads the newest entry and goes on from there. If the other one left its sources
alone, the rows it has written still hold and only the entry is made anew; else the change is applied again
to the newest state. A writer that dies leaves a part that no entry names, and the old state in force.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.operators.inbox import ANOMALY_SCHEMA, MUTE_SCHEMA, RUN_SCHEMA, InboxState
from billweave.sources import storage

log = logging.getLogger(__name__)

STATE_FORMAT = 2
TABLES = {"anomalies": ANOMALY_SCHEMA, "mutes": MUTE_SCHEMA, "runs": RUN_SCHEMA}
#: How often a change is brought to the newest state before it is given up.
ATTEMPTS = 8
#: A log file that cannot be parsed may still be being written: so often and long (in seconds) it is read again.
READS, PAUSE = 5, 0.1
_PART = "source_part"


class StateConflict(RuntimeError):
    """Other writers were faster too many times."""


@dataclass(frozen=True)
class Entry:
    """A commit: the part folder of each source. Version 0 is the state before the first commit."""

    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)


@dataclass
class StateStore:
    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")

    def _versions(self) -> list[int]:
        names = [e.name.removesuffix(".json") for e in storage.list_folder(self.spark, f"{self.path}/log") if not e.is_dir]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, version: int) -> dict | None:
        """A log file's content; None if it stays unreadable, as that of a writer that died on it does."""
        for _ in range(READS):
            try:
                entry = json.loads(storage.read_small(self.spark, f"{self.path}/log/{version}.json"))
                return entry if isinstance(entry, dict) else {}
            except ValueError:
                time.sleep(PAUSE)
        return None

    def entry(self) -> Entry:
        """The newest commit. One of a format that this code does not know is left alone for inspection, and
        the state counts as empty."""
        for version in reversed(self._versions()):
            found = self._read(version)
            if found is None:
                continue
            if found.get("format") != STATE_FORMAT:
                log.warning("%s/log/%s.json has an unknown format, starting empty", self.path, version)
                return Entry(version)
            return Entry(version, found["parts"])
        return Entry()

    def load(self, sources: list[str] | None = None, entry: Entry | None = None) -> InboxState:
        """The newest state, or that of ``entry``, of the sources named (all by default)."""
        parts: dict[str, list[str]] = {}
        for source, part in (entry or self.entry()).parts.items():
            if sources is None or source in sources:
                parts.setdefault(part, []).append(source)
        return InboxState(*[self._rows(name, schema, parts) for name, schema in TABLES.items()])

    def _rows(self, name: str, schema: str, parts: dict[str, list[str]]) -> DataFrame:
        out = None
        for part, ids in sorted(parts.items()):
            rows = self.spark.read.schema(f"{schema}, {_PART} string").parquet(f"{self.path}/parts/{part}/{name}")
            digests = [md5(i.encode()).hexdigest() for i in ids]
            rows = rows.where(F.col(_PART).isin(digests) & F.col("source_id").isin(ids)).drop(_PART)
            out = rows if out is None else out.unionAll(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _write(self, state: InboxState, sources: list[str] | None) -> tuple[str, list[str]]:
        """Write the rows to a new part; returns it and the sources that it holds."""
        part, found = uuid.uuid4().hex, set()
        for name, frame in (("anomalies", state.anomalies), ("mutes", state.mutes), ("runs", state.runs)):
            folder = f"{self.path}/parts/{part}/{name}"
            # A source's rows are few; one task a source keeps its files at one.
            rows = frame.withColumn(_PART, F.md5(F.col("source_id"))).repartition(_PART)
            rows.write.partitionBy(_PART).parquet(folder)
            if sources is None:
                back = self.spark.read.schema(f"{TABLES[name]}, {_PART} string").parquet(folder)
                found |= {r.source_id for r in back.select("source_id").distinct().collect()}
        return part, sorted(found) if sources is None else list(sources)

    def _commit(self, entry: Entry) -> bool:
        text = json.dumps({"format": STATE_FORMAT, "parts": entry.parts}, sort_keys=True)
        return storage.create_marker(self.spark, f"{self.path}/log/{entry.version}.json", text)

    def save(self, state: InboxState) -> int:
        """Replace the whole state; returns the version."""
        return self._update(lambda _: state, None).version

    def update(self, change: Callable[[InboxState], InboxState], sources: list[str] | None = None) -> InboxState:
        """Load, change and save in one step; returns the stored state.

        With ``sources``, ``change`` gets and returns the rows of these sources only, and no others are read
        or written. It may be called again if another writer changed one of them meanwhile."""
        return self.load(sources, self._update(change, sources))

    def _update(self, change: Callable[[InboxState], InboxState], sources: list[str] | None) -> Entry:
        made = read = None
        for _ in range(ATTEMPTS):
            base = self.entry()
            ours = base.parts if sources is None else {s: base.parts.get(s) for s in sources}
            if made is None or ours != read:
                made, read = self._write(change(self.load(sources, base)), sources), ours
            part, ids = made
            kept = {} if sources is None else {s: p for s, p in base.parts.items() if s not in sources}
            entry = Entry(max([base.version, *self._versions()]) + 1, kept | {s: part for s in ids})
            # Files above the base are a newer commit's, or that of a writer that died on it.
            newer = entry.version > base.version + 1 and self.entry().version != base.version
            if not newer and self._commit(entry):
                return entry
            log.info("%s: another writer committed before version %s", self.path, entry.version)
        raise StateConflict(self.path)

    def vacuum(self, keep: int = 10, older_than: timedelta = timedelta(days=1)) -> None:
        """Delete all but the newest ``keep`` commits, and the parts that none of these names. Parts younger
        than ``older_than`` may belong to a writer that has not committed yet and stay."""
        versions = self._versions()
        kept = versions[-keep:]
        named = {part for v in kept for part in ((self._read(v) or {}).get("parts") or {}).values()}
        for version in versions[:-keep]:
            storage.delete_folder(self.spark, f"{self.path}/log/{version}.json")
        limit = (datetime.now() - older_than).timestamp() * 1000
        for entry in storage.list_folder(self.spark, f"{self.path}/parts"):
            if entry.name not in named and entry.modified_ms <= limit:
                storage.delete_folder(self.spark, entry.path)
