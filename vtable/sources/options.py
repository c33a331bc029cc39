"""Table options: defaults, `k=v;k=v` strings and files of `k=v` lines."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    """sync: FULL forces each commit file to the disk. l0_limit: files of level 0 that make a compaction due; stall_limit: that make a
    commit compact first (0: never). l1_mb: size that makes level 1 due, ten times as much for each further one. file_mb: size of
    compacted files. retain: versions behind the newest that stay readable."""

    sync: str = "FULL"
    l0_limit: int = 4
    stall_limit: int = 0
    l1_mb: int = 512
    file_mb: int = 64
    retain: int = 0
    coerce_nulls: bool = False

    def with_(self, given: dict[str, str]) -> Options:
        """Known keys with readable values are taken, others are ignored."""
        out = self
        for f in fields(self):
            if f.name not in given:
                continue
            raw, old = str(given[f.name]).strip(), getattr(self, f.name)
            if isinstance(old, bool):
                out = replace(out, **{f.name: raw.lower() in ("1", "true", "on", "yes")})
            elif isinstance(old, int):
                if raw.lstrip("-").isdigit():
                    out = replace(out, **{f.name: int(raw)})
            elif raw.upper() in ("OFF", "NORMAL"):
                out = replace(out, **{f.name: raw.upper()})
            else:
                out = replace(out, **{f.name: "FULL"})
        return out


def parse_string(text: str) -> dict[str, str]:
    """Options of `k=v;k=v`; those of a file named by config_file come before them."""
    given = {k.strip(): v.strip() for k, _, v in (part.partition("=") for part in text.split(";")) if k.strip() and v.strip()}
    return (parse_file(given["config_file"]) if "config_file" in given else {}) | given


def parse_file(path: str) -> dict[str, str]:
    lines = (line.partition("#")[0].strip() for line in Path(path).read_text().splitlines())
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in lines if "=" in line)}
