"""Files in any store that Arrow knows (local paths, file://, s3://, gs://, hdfs://)."""

from __future__ import annotations

import fnmatch
from contextlib import contextmanager

from pyarrow import fs


def resolved(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str = "*") -> list[str]:
    """Comma-separated files and folders; folders give their files that match, sorted."""
    out: list[str] = []
    for one in path.split(","):
        store, root = resolved(one.strip())
        info = store.get_file_info(root)
        prefix = one.strip()[: len(one.strip()) - len(root)] if "://" in one else ""
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(root))
            out += sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob))
        elif info.type == fs.FileType.File:
            out.append(one.strip())
        else:
            raise FileNotFoundError(one.strip())
    return out


def opened(path: str):
    """A seekable input file."""
    store, at = resolved(path)
    return store.open_input_file(at)


def read_range(path: str, offset: int = 0, size: int | None = None) -> bytes:
    """Part of a file; a range beyond the end is cut, not an error."""
    with opened(path) as f:
        f.seek(min(offset, f.size()))
        return f.read(size)


class _Sink:
    def __init__(self, raw):
        self.raw, self.written = raw, 0

    def write(self, data: bytes) -> int:
        self.raw.write(data)
        self.written += len(data)
        return len(data)

    def tell(self) -> int:
        return self.written

    def size(self) -> int:
        return self.written


@contextmanager
def published(folder: str, name: str, attempt: str):
    """Something to write to that becomes folder/name when the block ends well."""
    store, root = resolved(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{attempt}"
    raw = store.open_output_stream(draft)
    try:
        yield _Sink(raw)
    except BaseException:
        raw.close()
        store.delete_file(draft)
        raise
    raw.close()
    store.move(draft, f"{root}/{name}")
