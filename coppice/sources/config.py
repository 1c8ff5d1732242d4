"""The project's configuration file and its root. Small, and read where the driver runs, before any plan."""

from __future__ import annotations

import math
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from coppice.operators.patterns import Benchmarks

#: Keys that each table may have.
KEYS = {"": ("root", "version", "ignore", "health", "toolchain", "patterns"), "health": ("ignore-unexplained",), "toolchain": ("manager",), "patterns": ("metrics",), "patterns.metrics": ("high", "medium", "low")}
MANAGERS = ("mise", "asdf")
VCS = (".git", ".jj")


class ConfigError(ValueError):
    def __init__(self, line: int, said: str):
        super().__init__(f"line {line} {said}")


@dataclass(frozen=True)
class Config:
    root: str | None = None
    dialect: int = 0
    dialect_given: bool = False
    ignore: tuple[str, ...] = ()
    ignore_unexplained: tuple[str, ...] = ()
    manager: str | None = None
    benchmarks: Benchmarks = field(default_factory=Benchmarks)


def key_lines(text: str) -> dict[str, int]:
    """Where each top-level key or table first stands."""
    out: dict[str, int] = {}
    table = False
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*\[+\s*([\w-]+)", line):
            table = True
            out.setdefault(m[1], n)
        elif not table and (m := re.match(r"\s*\"?([\w-]+)\"?(?:\.[\w.-]+)?\s*=", line)):
            out.setdefault(m[1], n)
    return out


def parse_config(text: str) -> Config:
    """Checks types, keys, ranges and order; errors name the line."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"at line (\d+)", str(e))
        raise ConfigError(int(m[1]) if m else 1, str(e)) from e
    lines = key_lines(text)

    def fail(key: str, said: str):
        raise ConfigError(lines.get(key.split(".")[0], 1), said)

    def table(at: str) -> dict:
        own = raw
        for k in filter(None, at.split(".")):
            own = own.get(k, {})
        if not isinstance(own, dict):
            fail(at, f"`{at}` must be a table")
        for k in own:
            if k not in KEYS[at]:
                raise ConfigError(lines.get(k if not at else at.split(".")[0], 1), f"uses unknown key `{k}`")
        return own

    top = table("")
    health, tools, _, metrics = table("health"), table("toolchain"), table("patterns"), table("patterns.metrics")

    def patterns(own: dict, key: str, at: str, name: str) -> tuple[str, ...]:
        found = own.get(key, [])
        if not isinstance(found, list) or not all(isinstance(p, str) for p in found):
            fail(at, f"`{key}` must be a list of strings")
        if any(not p.strip() for p in found):
            fail(at, f"must not contain an empty {name} pattern")
        return tuple(found)

    root, version, manager = top.get("root"), top.get("version"), tools.get("manager")
    if root is not None and (not isinstance(root, str) or not root.strip()):
        fail("root", "must not use an empty root path")
    if version is not None and version not in ("0", "1"):
        fail("version", f"uses unsupported version `{version}`")
    if manager is not None and manager not in MANAGERS:
        fail("toolchain", f"uses unsupported toolchain manager `{manager}`")
    values = {k: metrics.get(k, getattr(Benchmarks(), k)) for k in KEYS["patterns.metrics"]}
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and 0 <= v <= 1 for v in values.values()):
        fail("patterns", "pattern metric benchmark values must be decimals from 0.0 through 1.0")
    if not values["high"] >= values["medium"] >= values["low"]:
        fail("patterns", "pattern metric benchmarks must be ordered high >= medium >= low")
    return Config(root, int(version or 0), version is not None, patterns(top, "ignore", "ignore", "ignore"), patterns(health, "ignore-unexplained", "health", "health ignore-unexplained"), manager, Benchmarks(**values))


@dataclass(frozen=True)
class Root:
    path: str
    source: str  # config, vcs or folder
    config: Config
    config_path: str | None = None

    def warning(self) -> str | None:
        return {
            "config": None, "vcs": f"warning: using inferred VCS root `{self.path}`; add a config file for predictable root selection",
            "folder": f"warning: using current directory `{self.path}` as the project root; add a config file for predictable root selection",
        }[self.source]

    def diagnostics(self, name: str) -> list[tuple[str, str, int, str]]:
        """(severity, path, line, message): a warning where no dialect is given."""
        if self.config.dialect_given:
            return []
        if self.config_path:
            return [("warning", self.config_path, 1, f"missing `version` in {name}; using compatibility parsing rules; set `version = \"1\"` to use the current rules")]
        return [("warning", f"{self.path}/{name}", 1, f"no {name} found; using compatibility parsing rules")]


def find_root(start: str, name: str = "coppice.toml") -> Root:
    """The nearest config upward, else the nearest version-control root, else the folder itself."""
    here = Path(start).resolve()
    above = [here, *here.parents]
    for folder in above:
        at = folder / name
        if at.is_file():
            config = parse_config(at.read_text(encoding="utf-8"))
            root = (folder / config.root).resolve() if config.root else folder
            if not root.is_dir():
                raise ValueError(f"{at} points to a root that is not a directory")
            return Root(str(root), "config", config, str(at))
    vcs = next((f for f in above if any((f / m).exists() for m in VCS)), None)
    return Root(str(vcs or here), "vcs" if vcs else "folder", Config())
