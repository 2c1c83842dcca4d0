"""Snapshots of a table: what a version consists of, as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql.types import StructType

from lamellar.errors import InvalidArgument

FORMAT_VERSION = 1
DELTA_KINDS = ("primary_key", "positional", "equality")


@dataclass(frozen=True)
class Fragment:
    """Rows [start, end) of a folder or file; row is their stored ordinal, or their position in an external file.

    buckets: into how many parts the folder is dealt by ranges of span ordinals; 0
    for external files.  total: rows written to the folder.  deletes: a table of (file_path, pos), or (vector) of positions, if any.
    bytes: of the folder's files, if it was written here.
    """

    path: str
    start: int
    end: int
    buckets: int = 0
    total: int = 0
    span: int = 0
    deletes: str | None = None
    live: int | None = None
    vector: bool = False
    bytes: int = 0

    @property
    def rows(self) -> int:
        return self.live if self.live is not None else self.end - self.start


@dataclass(frozen=True)
class ColumnGroup:
    columns: tuple[str, ...]
    fragments: tuple[Fragment, ...] = ()
    format: str = "parquet"

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.fragments)


@dataclass(frozen=True)
class DeltaLog:
    path: str
    entries: int
    kind: str = "primary_key"

    def __post_init__(self):
        if self.kind not in DELTA_KINDS:
            raise InvalidArgument(f"unknown delta kind {self.kind}")


@dataclass(frozen=True)
class Statistic:
    paths: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Index:
    column: str
    kind: str
    id: int = 0
    files: tuple[str, ...] = ()
    params: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class LobFile:
    column: str
    path: str
    rows: int
    valid_rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: dict[str, Any] = field(default_factory=lambda: {"type": "struct", "fields": []})
    groups: tuple[ColumnGroup, ...] = ()
    deltas: tuple[DeltaLog, ...] = ()
    statistics: dict[str, Statistic] = field(default_factory=dict)
    indexes: tuple[Index, ...] = ()
    lobs: tuple[LobFile, ...] = ()

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(self.schema)

    @property
    def columns(self) -> list[str]:
        return [c for g in self.groups for c in g.columns]

    @property
    def rows(self) -> int:
        return self.groups[0].rows if self.groups else 0

    def group_of(self, column: str) -> int | None:
        return next((i for i, g in enumerate(self.groups) if column in g.columns), None)

    def lobs_of(self, column: str) -> list[LobFile]:
        return [x for x in self.lobs if x.column == column]

    def with_paths(self, change) -> "Manifest":
        """Every path of the manifest changed: to relative ones for storage, to absolute ones after."""
        return replace(
            self,
            groups=tuple(replace(g, fragments=tuple(replace(f, path=change(f.path), deletes=f.deletes and change(f.deletes)) for f in g.fragments)) for g in self.groups),
            deltas=tuple(replace(d, path=change(d.path)) for d in self.deltas),
            statistics={k: replace(s, paths=tuple(map(change, s.paths))) for k, s in self.statistics.items()},
            indexes=tuple(replace(i, files=tuple(map(change, i.files))) for i in self.indexes),
            lobs=tuple(replace(x, path=change(x.path)) for x in self.lobs),
        )

    def dumps(self) -> str:
        return json.dumps({"format_version": FORMAT_VERSION, **asdict(self)}, indent=1, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> "Manifest":
        d = json.loads(text)
        if not 1 <= d.pop("format_version", 0) <= FORMAT_VERSION:
            raise InvalidArgument("unknown manifest format")
        return cls(
            version=d["version"],
            schema=d["schema"],
            groups=tuple(ColumnGroup(tuple(g["columns"]), tuple(Fragment(**f) for f in g["fragments"]), g["format"]) for g in d["groups"]),
            deltas=tuple(DeltaLog(**x) for x in d["deltas"]),
            statistics={k: Statistic(tuple(s["paths"]), s["metadata"]) for k, s in d["statistics"].items()},
            indexes=tuple(Index(**{**x, "files": tuple(x["files"])}) for x in d["indexes"]),
            lobs=tuple(LobFile(**x) for x in d["lobs"]),
        )
