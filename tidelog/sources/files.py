"""Files of any file system pyarrow can reach (mounted folders, HDFS, object stores), from the driver and from workers alike."""

from __future__ import annotations

from pyarrow import fs


def locate(path) -> tuple[fs.FileSystem, str]:
    """(file system, path within it); a path without a scheme is a mounted folder."""
    p = str(path)
    if p.startswith("file:"):
        return fs.LocalFileSystem(), "/" + p[5:].lstrip("/")
    return fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)


def names(folder) -> dict[str, int]:
    """The plain files in ``folder`` with their sizes; a missing folder has none."""
    f, p = locate(folder)
    found = f.get_file_info(fs.FileSelector(p, allow_not_found=True))
    return {i.base_name: i.size for i in found if i.type == fs.FileType.File}


def size(path) -> int:
    f, p = locate(path)
    info = f.get_file_info(p)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(str(path))
    return info.size


def make_folder(folder) -> None:
    f, p = locate(folder)
    f.create_dir(p, recursive=True)


def open_read(path):
    f, p = locate(path)
    return f.open_input_file(p)


def open_write(path):
    f, p = locate(path)
    return f.open_output_stream(p)


def move(source, target) -> None:
    f, p = locate(source)
    f.move(p, locate(target)[1])


def remove_folder(folder) -> None:
    f, p = locate(folder)
    if f.get_file_info(p).type == fs.FileType.Directory:
        f.delete_dir(p)


def read_range(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)
