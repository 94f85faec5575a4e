"""Configuration files, searched from a folder upwards."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

NAMES = (".srcgraph.yaml", ".srcgraph.yml", ".srcgraph.json")


class ConfigNotFoundError(FileNotFoundError):
    pass


@dataclass
class Watch:
    enabled: bool = False
    interval: float = 0.0
    debounce: float = 0.0


@dataclass
class Config:
    root: str = ""
    db: str = ""
    port: int = 0
    watch: Watch = field(default_factory=Watch)
    path: str = ""


def duration(value: object) -> float:
    """Seconds of a number or of a text such as ``1m30s`` or ``500ms``."""
    if value in (None, ""):
        return 0.0
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    unit = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", str(value))
    if "".join(a + b for a, b in parts) != str(value):
        raise ValueError(f"invalid duration: {value!r}")
    return sum(float(a) * unit[b] for a, b in parts)


def _yaml(text: str) -> dict:
    """Nested mappings of scalars by indentation, all that a configuration needs."""
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    for raw in text.splitlines():
        row = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not row.strip() or row.strip() == "---":
            continue
        m = re.fullmatch(r"(\s*)([\w.-]+)\s*:\s*(.*)", row)
        if not m:
            raise ValueError(f"parse config: {raw!r}")
        depth, key, value = len(m[1]), m[2], m[3].strip()
        while stack[-1][0] >= depth:
            stack.pop()
        if value:
            plain = value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1 else value
            low = plain.lower()
            stack[-1][1][key] = plain if plain != value else low == "true" if low in ("true", "false") else int(plain) if re.fullmatch(r"-?\d+", plain) else plain
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return out


def _resolved(base: str, path: str) -> str:
    path = os.path.expanduser(path)
    return os.path.normpath(path if os.path.isabs(path) else os.path.join(base, path))


def find(start: str) -> str:
    at = os.path.abspath(start)
    while True:
        for name in NAMES:
            if os.path.exists(p := os.path.join(at, name)):
                return p
        if (up := os.path.dirname(at)) == at:
            raise ConfigNotFoundError("no configuration file found")
        at = up


def load(start: str = "") -> Config:
    path = find(start or os.getcwd())
    with open(path, encoding="utf-8") as f:
        text = f.read()
    raw = json.loads(text) if path.endswith(".json") else _yaml(text)
    base, watch = os.path.dirname(path), raw.get("watch") or {}
    return Config(
        root=_resolved(base, raw["root"]) if raw.get("root") else "",
        db=_resolved(base, raw["db"]) if raw.get("db") else "",
        port=int((raw.get("server") or {}).get("port") or 0),
        watch=Watch(bool(watch.get("enabled")), duration(watch.get("interval")), duration(watch.get("debounce"))),
        path=path,
    )
