"""Folders of the lake and of staged tables, on any file system Arrow can open."""

from __future__ import annotations

import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    fs, inner = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return fs, inner.rstrip("/")


def delete_folder(path: str) -> None:
    """Remove a folder and what is in it; one that is not there is no error."""
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type != pafs.FileType.NotFound:
        fs.delete_dir(inner)


def folders(path: str) -> list[str]:
    """Names of the folders directly below ``path``, sorted."""
    fs, inner = filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory)


def exists(path: str) -> bool:
    fs, inner = filesystem(path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound


def files(path: str) -> list[str]:
    """Names of the files directly below ``path``, sorted."""
    fs, inner = filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == pafs.FileType.File)


def read_text(path: str) -> str:
    fs, inner = filesystem(path)
    with fs.open_input_stream(inner) as source:
        return source.read().decode()


def write_text(path: str, text: str) -> None:
    """Write a small file; its folder is made where it is missing."""
    fs, inner = filesystem(path)
    fs.create_dir(inner.rpartition("/")[0])
    with fs.open_output_stream(inner) as sink:
        sink.write(text.encode())


def delete_file(path: str) -> None:
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type != pafs.FileType.NotFound:
        fs.delete_file(inner)
