"""Whole files written by tasks into the shared folder, safe against repeated attempts.

A task writes under a name of its own and then moves the file to its final name.
An attempt that is repeated after a lost executor writes the same bytes and
moves them over the first ones.
"""

from __future__ import annotations

import uuid


def put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")
