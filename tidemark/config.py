"""What is mirrored: tables, their partitions and who may read them."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

FORMATS = {"HOUR": "yyyyMMddHH", "DAY": "yyyyMMdd", "MONTH": "yyyyMM", "YEAR": "yyyy"}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Unit:
    """A column whose value, as text, is an access unit of the given type."""

    unit_type: str
    column: str


@dataclass(frozen=True)
class TimeLayout:
    """Partitions by hour, day, month or year of a column."""

    column: str
    granularity: str

    def __post_init__(self):
        if self.granularity not in FORMATS:
            raise ValueError(f"unknown granularity {self.granularity!r}")
        if not self.column or self.column.startswith("_PARTITION"):
            raise ValueError("a time layout needs a real column")


@dataclass(frozen=True)
class RangeLayout:
    """Partitions of ``interval`` integers in [start, end), and one for all other values and null."""

    column: str
    start: int
    end: int
    interval: int

    def __post_init__(self):
        if not self.column or self.interval <= 0 or self.start >= self.end:
            raise ValueError("a range layout needs a column, a positive interval and start < end")


@dataclass(frozen=True)
class Table:
    """One mirrored table; without a layout it is replaced whole.

    Rows are sorted by ``order`` in their files; files hold Bloom filters of ``index``,
    and sketches of the columns ``estimate`` are kept for counts. Partitions of over a million
    rows are cut by the hash of ``split`` columns, a key that rows keep, into pieces that are
    refreshed each on its own.
    """

    name: str
    source: str
    layout: TimeLayout | RangeLayout | None = None
    last: int | None = None
    rls: tuple[Unit, ...] | None = None
    order: tuple[str, ...] = ()
    index: tuple[str, ...] = ()
    estimate: tuple[str, ...] = ()
    split: tuple[str, ...] = ()
    schema: str = ""

    def __post_init__(self):
        if not NAME.fullmatch(self.name):
            raise ValueError(f"bad table name {self.name!r}")
        if self.last is not None and (not isinstance(self.layout, TimeLayout) or self.last < 1):
            raise ValueError("last keeps the newest partitions of a time layout only")
        if self.split and self.layout is None:
            raise ValueError("only partitions are split")

    def canonical(self) -> str:
        """JSON that changes when anything in the configuration does."""
        return json.dumps(asdict(self) | {"kind": type(self.layout).__name__}, sort_keys=True)


@dataclass(frozen=True)
class Schema:
    """A namespace: its tables and the claim that names a requester."""

    tables: tuple[Table, ...] = ()
    claim: str | None = None


@dataclass(frozen=True)
class Config:
    """All namespaces. Tables are stamped with their schema; secured ones need its claim."""

    schemas: Mapping[str, Schema] = field(default_factory=dict)

    def __post_init__(self):
        stamped = {}
        for name, schema in self.schemas.items():
            if not NAME.fullmatch(name):
                raise ValueError(f"bad schema name {name!r}")
            if len({t.name for t in schema.tables}) < len(schema.tables):
                raise ValueError(f"a table is named twice in {name}")
            if any(t.rls is not None for t in schema.tables) and not schema.claim:
                raise ValueError(f"{name} has secured tables but no claim")
            stamped[name] = replace(schema, tables=tuple(replace(t, schema=name) for t in schema.tables))
        object.__setattr__(self, "schemas", stamped)

    def tables(self) -> list[Table]:
        return [t for s in self.schemas.values() for t in s.tables]


def read_config(text: str) -> tuple[Config, list[tuple[str, str | None, str]]]:
    """A configuration from JSON, and (schema, table, problem) of what had to be left out of it.

    An object of schemas by name, each with ``claim`` and ``tables``; a table's fields are those
    of :class:`Table`, its layout has a column and either a granularity or start, end and
    interval. A bad entry spoils no other one, and none is taken in part.
    """
    schemas, bad = {}, []
    for name, entry in json.loads(text).items():
        claim, tables = entry.get("claim"), {}
        if not NAME.fullmatch(name):
            bad.append((name, None, f"bad schema name {name!r}"))
            continue
        for given in entry.get("tables", ()):
            fields = dict(given)
            try:
                if (layout := fields.get("layout")) is not None:
                    fields["layout"] = TimeLayout(**layout) if "granularity" in layout else RangeLayout(**layout)
                if (units := fields.get("rls")) is not None:
                    fields["rls"] = tuple(Unit(**u) for u in units)
                table = Table(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
                if table.name in tables:
                    raise ValueError("named twice")
                if table.rls is not None and not claim:
                    raise ValueError("secured, but the schema has no claim")
            except (TypeError, ValueError) as e:
                bad.append((name, given.get("name"), str(e)))
            else:
                tables[table.name] = table
        schemas[name] = Schema(tuple(tables.values()), claim)
    return Config(schemas), bad
