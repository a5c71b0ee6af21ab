"""The field dictionary: definitions from YAML or JSON, checked, and resolution of header fields against it."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath


@dataclass(frozen=True)
class Definition:
    """What the dictionary says of a field."""

    canonical_name: str
    source_name: str = ""
    occurrence: int | None = None
    kind: str = "STRING"
    entity: str = "charger"
    unit: str | None = None
    sentinels: tuple[float, ...] = ()
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    required: bool = False
    pattern: str | None = None


@dataclass
class Dictionary:
    """Definitions by name and occurrence, by name, by folded name and by pattern, tried in this order."""

    units: tuple[str, ...] = ()
    fields: list[Definition] = field(default_factory=list)

    @classmethod
    def load(cls, documents: dict[str, str], root: str) -> Dictionary:
        """From texts by path, beginning at root; `include` lists are followed relative to the file that has them."""
        out = cls()
        todo, seen = [root], set()
        while todo:
            path = todo.pop(0)
            if path in seen:
                continue
            seen.add(path)
            body = _parse(documents[path], path)
            todo += [str(PurePosixPath(path).parent / p) for p in body.get("include", ())]
            out.units += tuple(body.get("units", ()))
            for f in body.get("fields", ()):
                out.fields.append(Definition(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}))
        out.check()
        return out

    def check(self) -> None:
        names = [f.canonical_name for f in self.fields]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"defined twice: {', '.join(twice)}")
        odd = sorted({f.unit for f in self.fields if f.unit and self.units and f.unit not in self.units})
        if odd:
            raise ValueError(f"unknown units: {', '.join(odd)}")

    def resolve(self, name: str, occurrence: int = 1) -> Definition | None:
        fold = lambda s: re.sub(r"\s+", " ", s.strip()).casefold()
        plain = [f for f in self.fields if not f.pattern]
        for fits in (
            lambda f: f.source_name == name and f.occurrence == occurrence,
            lambda f: f.source_name == name and f.occurrence is None,
            lambda f: fold(f.source_name) == fold(name) and f.occurrence in (None, occurrence),
        ):
            found = next((f for f in plain if fits(f)), None)
            if found:
                return found
        return next((f for f in self.fields if f.pattern and re.fullmatch(f.pattern, name)), None)

    def table(self, spark):
        """The definitions as a table, to join or broadcast: its size is that of the dictionary files."""
        rows = [(f.canonical_name, f.source_name, f.occurrence, f.kind, f.entity, f.unit, [float(s) for s in f.sentinels], list(f.allowed), f.low, f.high, f.required) for f in self.fields]
        return spark.createDataFrame(rows, "canonical_name string, source_name string, occurrence int, kind string, entity string, unit string, sentinels array<double>, allowed array<string>, low double, high double, required boolean")


def _parse(text: str, path: str) -> dict:
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML dictionaries need the yaml package; JSON ones don't") from e
    return yaml.safe_load(text) or {}
