"""Typed options of writers, readers and transactions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from lamellar.errors import InvalidProperty, NotSupported

#: Registered formats; all but the first are read through external imports or not at all.
FORMATS = ("parquet", "vortex", "lance-table", "iceberg-table", "paimon-table")
CODECS = ("uncompressed", "snappy", "gzip", "lz4", "zstd")
POLICIES = ("single", "schema_based", "size_based")


@dataclass(frozen=True)
class Option:
    default: Any
    parse: Callable[[Any], Any]
    valid: Callable[[Any], bool] = lambda _: True


def _bool(v: Any) -> bool:
    if isinstance(v, bool):
        return v
    if str(v).lower() in ("true", "false"):
        return str(v).lower() == "true"
    raise ValueError(v)


def _list(v: Any) -> tuple[str, ...]:
    return tuple(v) if isinstance(v, (list, tuple)) else tuple(x.strip() for x in str(v).split(",") if x.strip())


def _whole(least: int = 0, most: int = 2**63 - 1) -> tuple[Callable[[Any], int], Callable[[int], bool]]:
    return int, lambda v: least <= v <= most


OPTIONS: dict[str, Option] = {
    "writer.policy": Option("single", str, lambda v: v in POLICIES),
    "writer.format": Option("parquet", str, lambda v: v in FORMATS),
    "writer.split.schema_based.patterns": Option((), _list),
    "writer.split.schema_based.formats": Option((), _list, lambda v: all(x in FORMATS for x in v)),
    "writer.split.size_based.max_avg_column_size": Option(0, *_whole()),
    "writer.split.size_based.max_columns_in_group": Option(0, *_whole()),
    "writer.file_rolling.rows": Option(65_536, *_whole(1)),
    "writer.file_rolling.size": Option(0, *_whole()),
    "writer.row_group_size": Option(32 << 20, *_whole(1 << 10)),
    "writer.compression": Option("zstd", str, lambda v: v in CODECS),
    "writer.compression_level": Option(3, *_whole(-7, 22)),
    "writer.enable_dictionary": Option(True, _bool),
    "writer.enc.enable": Option(False, _bool),
    "reader.logical_chunk_rows": Option(8192, *_whole(1)),
    "reader.take.broadcast_rows": Option(100_000, *_whole()),
    "transaction.commit.num-retries": Option(1, *_whole(0, 10)),
    "iceberg.snapshot_id": Option(None, int),
    "lob.inline_threshold": Option(64 << 10, *_whole()),
    "lob.rows_per_file": Option(100_000, *_whole(1)),
}


class Properties(Mapping):
    """All options with their values; unknown names and invalid values are errors."""

    def __init__(self, values: Mapping[str, Any] | None = None):
        self._values = {k: o.default for k, o in OPTIONS.items()}
        for name, value in (values or {}).items():
            if name not in OPTIONS:
                raise InvalidProperty(f"unknown property {name}")
            if value is None and OPTIONS[name].default is None:
                continue
            try:
                parsed = OPTIONS[name].parse(value)
            except (TypeError, ValueError) as e:
                raise InvalidProperty(f"{name}: {value!r} has the wrong type") from e
            if not OPTIONS[name].valid(parsed):
                raise InvalidProperty(f"{name}: {value!r} is out of range")
            self._values[name] = parsed
        if self["writer.enc.enable"]:
            raise NotSupported("Parquet encryption needs a key management class on Spark's class path; set parquet.crypto.factory.class there")

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def writable_format(self, name: str) -> str:
        if name not in FORMATS:
            raise InvalidProperty(f"unknown format {name}")
        if name != "parquet":
            raise NotSupported(f"{name} cannot be written")
        return name
