"""Contracts that operators take: frozen, checked before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("insert", "upsert", "sync")


@dataclass(frozen=True)
class ManagedTable:
    """A table whose rows are declared elsewhere.

    keys: composite key. columns: managed columns besides the keys. skip_diff: columns that are
    written but not compared. sync_updates: whether mode "sync" also plans updates.
    """

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    skip_diff: tuple[str, ...] = ()
    mode: str = "upsert"
    sync_updates: bool = False
    max_rows: int | None = None
    max_bytes: int | None = None

    def __post_init__(self) -> None:
        if not self.keys or set(self.keys) & set(self.columns):
            raise ValueError("a managed table needs keys, apart from its other columns")
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {MODES}")
        if not set(self.skip_diff) <= set(self.columns):
            raise ValueError("skip_diff names columns that are not managed")


@dataclass(frozen=True)
class Thresholds:
    """Limits of snapshot statistics; a limit of 0 or less is off, others must be exceeded."""

    table_bytes: int = 0
    dead_rows: int = 0
    unused_indexes: int = 0
    complexity: float = 0
    growth_bytes: int = 0
