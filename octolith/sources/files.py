"""Plain files on the file systems that pyarrow reaches, for codecs that run in executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs as pafs


def open_fs(uri: str):
    """(file system, path): local paths, file: URIs and whatever pyarrow knows (hdfs, s3, gs, ...)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Under a temporary name first, so that a repeated task leaves one whole file."""
    write_pieces(uri, [data])


def write_pieces(uri: str, pieces: Iterable[bytes]) -> None:
    """One file of bytes that come in pieces."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as f:
        for data in pieces:
            f.write(data)
    fs.move(part, path)


def read_whole(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def exists(uri: str) -> bool:
    fs, path = open_fs(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def expand(sources: list[str]) -> list[str]:
    """Files as they are, directories as all files below them, in order."""
    out = []
    for s in sources:
        fs, path = open_fs(s)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.Directory:
            below = fs.get_file_info(pafs.FileSelector(path, recursive=True))
            out += [s.rstrip("/") + x.path[len(path.rstrip("/")) :] for x in sorted(below, key=lambda x: x.path) if x.is_file]
        else:
            out.append(s)
    return out


def clear_directory(uri: str, keep: str = "journal") -> None:
    """Empty an output directory but for its journal, or make it."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        fs.create_dir(path, recursive=True)
        return
    for x in fs.get_file_info(pafs.FileSelector(path)):
        if x.base_name == keep:
            continue
        if x.type == pafs.FileType.Directory:
            fs.delete_dir(x.path)
        else:
            fs.delete_file(x.path)


def delete(uris: list[str]) -> None:
    """Sources of a finished conversion."""
    for u in uris:
        fs, path = open_fs(u)
        fs.delete_file(path)
