"""Byte files in the shared folder, written and range-read by tasks."""

from __future__ import annotations

import sys
from collections import OrderedDict

from lucidgraph.llm.shared import by_value


def open_store(uri: str):
    """(filesystem, path) of a folder URI as executors see it; the folder is made."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    return store, path


class Ranges:
    """Reads byte ranges of the files of a folder; keeps at most ``most`` files open."""

    def __init__(self, uri: str, most: int = 64):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.most, self.open = most, OrderedDict()

    def file(self, name: str):
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.store.open_input_file(f"{self.path}/{name}")
        self.open.move_to_end(name)
        return self.open[name]

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)

    def read_all(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            return f.read()

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()


by_value(sys.modules[__name__])
