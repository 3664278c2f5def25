"""Tables kept in versions: written aside, put in place by a rename, old versions pruned."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .files import extension, read, write

TAG = re.compile(r"^[A-Za-z0-9._-]+$")
STATUS = "format string, path string, ok boolean, bytes long, message string"


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _size(system: fs.FileSystem, path: str) -> int:
    info = system.get_file_info(path)
    if info.is_file:
        return info.size
    return sum(f.size or 0 for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file)


def versions(folder: str, name: str, fmt: str | None = None) -> list[str]:
    """Paths of a table's versions, newest first by time of change, then by name."""
    system, path = _system(folder)
    found = [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith(f"{name}_v") and (fmt is None or extension(f.path) == fmt)]
    return [f.path for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.base_name), reverse=True)]


def write_versioned(df: DataFrame, folder: str, name: str, formats: list[str], tag: str | None = None, keep: int = 3, today: dt.date | None = None) -> DataFrame:
    """Writes one version per format and keeps the ``keep`` newest of each; returns a row of status per format."""
    tag = tag or (today or dt.date.today()).isoformat()
    if not TAG.match(tag):
        raise ValueError(f"not a version tag: {tag!r}")
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    rows = []
    for fmt in formats:
        final, held = f"{path}/{name}_v{tag}.{fmt}", f"{path}/.{uuid.uuid4().hex}.{fmt}"
        try:
            write(df, f"{scheme}{held}")
            for old in system.get_file_info([final]):
                if old.type == fs.FileType.Directory:
                    system.delete_dir(final)
                elif old.type == fs.FileType.File:
                    system.delete_file(final)
            system.move(held, final)
            rows.append((fmt, final, True, _size(system, final), ""))
        except Exception as e:  # one format that fails does not stop the others; its row says why
            rows.append((fmt, final, False, 0, str(e)[:500]))
        for old in [v for v in versions(folder, name, fmt) if v != final][max(0, keep - 1) :]:
            system.delete_dir(old) if system.get_file_info(old).type == fs.FileType.Directory else system.delete_file(old)
    return df.sparkSession.createDataFrame(rows, STATUS)


def latest(folder: str, name: str, formats: list[str] | None = None) -> str:
    """The newest version; a table without versions is found by its plain name."""
    found = [v for v in versions(folder, name) if formats is None or extension(v) in formats]
    if found:
        return found[0]
    system, path = _system(folder)
    plain = [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.rsplit(".", 1)[0] == name and (formats is None or extension(f.path) in formats)]
    if not plain:
        raise FileNotFoundError(f"no version of {name} in {folder}")
    return max(plain, key=lambda f: (f.mtime_ns or 0, f.base_name)).path


def read_latest(spark: SparkSession, folder: str, name: str, formats: list[str] | None = None) -> DataFrame:
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return read(spark, scheme + latest(folder, name, formats))
