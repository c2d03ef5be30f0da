"""Opening of repositories."""

from __future__ import annotations

import logging
import subprocess
import tempfile
from pathlib import Path

from tessera.model import Repository, RepositorySource, SourceType

logger = logging.getLogger("tessera")


def ingest(source: RepositorySource, clone_into: str | None = None) -> Repository:
    """Opens a local folder or clones a repository; any other type is a ValueError.

    clone_into: the folder that clones go to.  Executors read files by path, so on a
    cluster it must be one that all of them mount.
    """
    try:
        kind = SourceType(source.source_type)
    except ValueError:
        raise ValueError(f"unsupported source type: {source.source_type}") from None
    return _open_local(source) if kind is SourceType.LOCAL else _clone(source, clone_into)


def _open_local(source: RepositorySource) -> Repository:
    path = Path(source.location)
    if not path.exists():
        raise FileNotFoundError(f"no such repository: {path}")
    if not path.is_dir():
        raise NotADirectoryError(f"not a directory: {path}")
    return Repository(path.name, str(path), source)


def _clone(source: RepositorySource, into: str | None) -> Repository:
    """Clones into a new folder, whose name is the repository's; a failure is a RuntimeError."""
    target = Path(tempfile.mkdtemp(prefix="tessera-", dir=into))
    command = ["git", "clone", "--quiet"]
    if source.branch:
        command += ["--branch", source.branch]
    if source.shallow:
        command += ["--depth", "1"]
    try:
        subprocess.run([*command, "--", source.location, str(target)], check=True, capture_output=True, text=True)
    except (OSError, subprocess.CalledProcessError) as e:
        raise RuntimeError(f"clone of {source.location} failed: {getattr(e, 'stderr', None) or e}") from e
    return Repository(target.name, str(target), source)
