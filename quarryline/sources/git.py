"""Repository checkouts: a driver-side step before a scan."""

from __future__ import annotations

import os
import shutil
import subprocess
from pathlib import Path


def is_url(source: str) -> bool:
    return source.startswith(("http://", "https://", "git@"))


def _git(*args: str, cwd: str | None = None) -> str:
    return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True, timeout=600).stdout.strip()


def checkout(source: str, folder: str, branch: str | None = None, force: bool = False) -> dict:
    """A shallow clone of a URL (pulled if it is there, anew with ``force``), or a local folder as it is."""
    if not is_url(source):
        path = Path(source)
        if not path.is_dir():
            raise NotADirectoryError(source)
    else:
        path = Path(folder) / source.rstrip("/").rpartition("/")[2].removesuffix(".git")
        if path.exists() and force:
            shutil.rmtree(path)
        if path.exists():
            _git("pull", "--ff-only", cwd=str(path))
        else:
            _git("clone", "--depth", "1", *(["--branch", branch] if branch else []), source, str(path))
    try:
        commit, branch = _git("rev-parse", "HEAD", cwd=str(path)), _git("rev-parse", "--abbrev-ref", "HEAD", cwd=str(path))
    except (subprocess.CalledProcessError, FileNotFoundError):
        commit = None
    return {"name": path.name, "path": str(path), "commit_hash": commit, "branch": branch}


def changed_paths(folder: str, since: str) -> list[str] | None:
    """Paths changed between a commit and HEAD, both names of a rename; None (everything) where git can't tell."""
    try:
        lines = _git("diff", "--name-status", "-M", since, "HEAD", cwd=folder).splitlines()
    except (subprocess.CalledProcessError, subprocess.TimeoutExpired, FileNotFoundError):
        return None
    return sorted({p for line in lines for p in line.split("\t")[1:]})


def discover(root: str) -> list[dict]:
    """Name, path and commit of the checkouts in a folder."""
    out = []
    for folder in sorted(Path(root).iterdir()) if Path(root).is_dir() else ():
        if (folder / ".git").exists():
            try:
                commit = _git("rev-parse", "HEAD", cwd=str(folder))
            except (subprocess.CalledProcessError, subprocess.TimeoutExpired, FileNotFoundError):
                commit = None
            out.append({"name": folder.name, "path": str(folder), "commit_hash": commit})
    return out


class Roots:
    """Where repositories lie: the folders of ``repos_dir``, or those of an environment variable (a list of paths) instead."""

    def __init__(self, repos_dir: str, variable: str = "QUARRYLINE_REPO_PATHS"):
        self.repos_dir, self.variable, self._known = repos_dir, variable, None

    def all(self) -> dict[str, str]:
        if self._known is None:
            named = [p for p in os.environ.get(self.variable, "").split(os.pathsep) if p]
            folders = [Path(p) for p in named] if named else sorted(p for p in Path(self.repos_dir).glob("*") if p.is_dir())
            self._known = {p.name: str(p) for p in folders if p.is_dir()}
        return self._known

    def resolve(self, name: str) -> str | None:
        return self.all().get(name)

    def invalidate(self) -> None:
        self._known = None


def ignore_patterns(folder: str, name: str = ".ragignore") -> list[str]:
    """The patterns of a repository's own ignore file."""
    path = Path(folder) / name
    lines = path.read_text(encoding="utf-8", errors="replace").splitlines() if path.is_file() else []
    return [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
