"""Byte streams on the shared store, from tasks. Names are unique to an attempt; only committed manifests name them."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def _at(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def open_new(folder: str, suffix: str):
    """A new file in folder: (uri, output stream). A retried task gets another name."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = _at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, store.open_output_stream(path, compression=None)


def open_old(uri: str):
    """A seekable file."""
    store, path = _at(uri)
    return store.open_input_file(path)
