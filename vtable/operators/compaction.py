"""Which files to compact."""

from __future__ import annotations

from collections.abc import Sequence

from ..sources.log import DataFile
from ..sources.options import Options

MEGABYTE = 1_000_000
#: How much larger each level may be than the one above.
FANOUT = 10


def overlapping(files: Sequence[DataFile], others: Sequence[DataFile]) -> list[DataFile]:
    """Those of others that may hold a key of files; a file without bounds may hold any."""
    return [o for o in others if any(f.may_hold(o.low, o.high) or o.low is None for f in files)]


def scores(files: Sequence[DataFile], options: Options) -> dict[int, float]:
    """How full each level is; over 1 is due. Level 0 counts commits, the others bytes."""
    out = {0: len({f.folder for f in files if not f.level}) / max(1, options.l0_limit)}
    for level in {f.level for f in files} - {0}:
        out[level] = sum(f.bytes for f in files if f.level == level) / (options.l1_mb * MEGABYTE * FANOUT ** (level - 1))
    return out


def pick(files: Sequence[DataFile], options: Options) -> tuple[list[DataFile], int]:
    """Files of the fullest level that is due, with those of the next that overlap, and the level to write; none if nothing is due.

    All of level 0 goes at once, since its files overlap; of a further level the file with the oldest rows goes.
    """
    if not files:
        return [], 0
    found = scores(files, options)
    level = max(found, key=lambda k: (found[k], -k))
    if found[level] < 1:
        return [], 0
    own = [f for f in files if f.level == level]
    chosen = own if not level else [min(own, key=lambda f: (f.high_v, f.path))]
    return [*chosen, *overlapping(chosen, [f for f in files if f.level == level + 1])], level + 1
