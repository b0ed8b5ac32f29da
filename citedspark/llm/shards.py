"""Arrays that tasks write to the shared folder and other tasks map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs


#: Hadoop's names of stores that pyarrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}
#: Maps that a worker keeps open; the machine allows some 65,000 to a process.
MAPS = 4096


def _uri(folder: str) -> str:
    scheme, _, rest = folder.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}://{rest}"


def _place(folder: str) -> tuple[fs.FileSystem, str, bool]:
    """(file system, path, whether it is a plain local path) of a folder."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder, True
    if folder.startswith("file:"):
        path = folder.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path.lstrip("/"), True
    system, path = fs.FileSystem.from_uri(_uri(folder))
    return system, path, isinstance(system, fs.LocalFileSystem)


def write(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under a name of its own and move it into place, so a task may run again."""
    system, path, _ = _place(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(own, f"{path}/{name}")


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """The array of a name, mapped into memory.

    A store that cannot be mapped is copied to the task's temporary folder first, shard by shard.
    """
    system, path, local = _place(folder)
    whole = f"{path}/{name}"
    if not local:
        with system.open_input_stream(whole) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
            while piece := source.read(1 << 22):
                copy.write(piece)
        whole = copy.name
    # As a plain array, whose slices cost less than those of a memmap; it keeps the mapping.
    found = np.asarray(np.memmap(whole, kind, "r")) if os.path.getsize(whole) else np.zeros(0, kind)
    if not local:
        os.unlink(whole)  # the mapping keeps it
    return found


@lru_cache(maxsize=MAPS)
def kept(folder: str, name: str, kind: str) -> np.ndarray:
    """`mapped`, with the maps used lately kept open; one that is dropped is opened again when needed."""
    return mapped(folder, name, kind)
