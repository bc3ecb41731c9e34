"""Which project a store belongs to, and where it is kept.

A workspace is named outright or found by walking up from a given folder to one that
holds a marker.  The current folder is never taken by itself: a change of folder
would silently change which store is read.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import NamedTuple

from ..errors import EngineError

#: The variable that names a workspace outright, what marks one, and the folder of its store.
VARIABLE = "VERITRAIL_WORKSPACE"
MARKERS = (".git", ".hg", "pyproject.toml", "package.json")
FOLDER = ".veritrail"


class Workspace(NamedTuple):
    root: Path
    method: str

    @property
    def store(self) -> Path:
        return self.root / FOLDER / "store"


def resolve(env: Mapping[str, str], start: str | Path | None = None) -> Workspace:
    if named := env.get(VARIABLE):
        return Workspace(Path(named).resolve(), "variable")
    if start is None:
        raise EngineError("workspace_unresolved", f"{VARIABLE} is not set and no folder was given")
    first = Path(start).resolve()
    for folder in (first, *first.parents):
        if any((folder / marker).exists() for marker in MARKERS):
            return Workspace(folder, "marker")
    raise EngineError("workspace_unresolved", f"no marker at or above {first}")


def prepare(workspace: Workspace) -> Path:
    """The folder of the store, made with the rule that keeps its content out of version control."""
    top = workspace.root / FOLDER
    top.mkdir(mode=0o700, parents=True, exist_ok=True)
    ignore = top / ".gitignore"
    if not ignore.exists():
        ignore.write_text("*\n")
    return workspace.store
