"""Random access to local files and object stores, on the driver or in tasks."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

from pyarrow import fs


def resolve(path: str, options: dict | None = None) -> tuple[fs.FileSystem, str]:
    """Buckets of s3:// are read anonymously unless options are given; any
    options, even none in a dict, are taken as they are."""
    if path.startswith("s3://"):
        settings = {"anonymous": True} if options is None else dict(options)
        return fs.S3FileSystem(**settings), path.removeprefix("s3://")
    if path.startswith("gs://"):
        return fs.GcsFileSystem(**(options or {})), path.removeprefix("gs://")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def read_range(path: str, start: int, stop: int, options: dict | None = None) -> bytes:
    files, at = resolve(path, options)
    with files.open_input_file(at) as f:
        f.seek(start)
        return f.read(stop - start)


def read_ranges(path: str, ranges: list[tuple[int, int]], options: dict | None = None) -> Iterator[bytes]:
    """Several ranges of one file, which is opened once."""
    if not ranges:
        return
    files, at = resolve(path, options)
    with files.open_input_file(at) as f:
        for start, stop in ranges:
            f.seek(start)
            yield f.read(stop - start)


def local(path: str) -> str | None:
    """The plain path of a file that can be written at any place; else None."""
    files, at = resolve(path)
    return at if isinstance(files, fs.LocalFileSystem) else None


def writing(path: str, options: dict | None = None):
    """A stream to a new file, in a folder that is made if it lacks."""
    files, at = resolve(path, options)
    if isinstance(files, fs.LocalFileSystem):
        files.create_dir(os.path.dirname(at), recursive=True)
    return files.open_output_stream(at, compression=None)


def read_all(path: str, options: dict | None = None) -> bytes:
    files, at = resolve(path, options)
    with files.open_input_file(at) as f:
        return f.read()


def size(path: str, options: dict | None = None) -> int:
    files, at = resolve(path, options)
    return files.get_file_info(at).size


def exists(path: str, options: dict | None = None) -> bool:
    files, at = resolve(path, options)
    return files.get_file_info(at).type == fs.FileType.File


def text_lines(path: str, options: dict | None = None) -> Iterator[str]:
    """Lines of a text file, one after another; .gz and .bgz are unpacked."""
    files, at = resolve(path, options)
    with files.open_input_stream(at, compression="gzip" if path.endswith((".gz", ".bgz")) else None) as f, io.TextIOWrapper(f, "utf-8", newline="") as text:
        yield from text
