"""Files that executors and driver reach by URI from Python."""

from __future__ import annotations

import json

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    """Whole or not at all on a local disk: a temporary name is renamed."""
    import os
    import uuid

    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    if isinstance(fs, pafs.LocalFileSystem):
        tmp = f"{path}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
    else:
        with fs.open_output_stream(path, compression=None) as f:
            f.write(data)


def read_json(uri: str):
    return json.loads(read_bytes(uri))


def write_json(uri: str, content) -> None:
    """As UTF-8 text with two spaces of indent; folders are made."""
    write_bytes(uri, json.dumps(content, ensure_ascii=False, indent=2).encode())


def files(uri: str, suffix: str) -> list[str]:
    """The files of that suffix: the path itself, or those in the folder."""
    fs, path = filesystem(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [uri]
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted(f"{uri.rstrip('/')}/{f.base_name}" for f in found if f.base_name.lower().endswith(suffix))
