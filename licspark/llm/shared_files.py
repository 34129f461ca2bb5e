"""Binary files in a folder that all executors share: a mounted path, or a store that pyarrow.fs can open."""

import os
import re
from typing import BinaryIO

from pyarrow import fs


def _local(path: str) -> str | None:
    return re.sub("^file:(//)?", "", path) if re.match("file:|/", path) else None


def create(path: str) -> BinaryIO:
    """New file for writing; its folder is made where the store has folders."""
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    return store.open_output_stream(place)


def open_at_will(path: str) -> BinaryIO:
    """File for reading with seek."""
    if local := _local(path):
        return open(local, "rb")
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)
