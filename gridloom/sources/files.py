"""Byte ranges of files: local paths, http(s) addresses, any URI that Arrow's file systems know, or bytes already at hand."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import time
import urllib.error
import urllib.request
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from gridloom.errors import SourceError


class HttpFile:
    """Ranges of a file behind http(s). Servers that don't know ranges send it whole, once."""

    ATTEMPTS, PATIENCE = 4, 60

    def __init__(self, url: str):
        self.url, self.whole = url, None
        status, headers, data = self._get("bytes=0-0")
        self.version = headers.get("ETag") or headers.get("Last-Modified") or ""
        if status == 206 and re.search(r"/\d+$", headers.get("Content-Range", "")):
            self.length = int(headers["Content-Range"].rpartition("/")[2])
        else:
            self.whole, self.length = data if status == 200 else self._get(None)[2], 0
            self.length = len(self.whole)

    def _get(self, wanted: str | None) -> tuple[int, dict, bytes]:
        """One answer; what may pass (a server's fault, a broken connection) is tried again, later each time."""
        for attempt in range(self.ATTEMPTS):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": wanted} if wanted else {}), timeout=self.PATIENCE) as answer:
                    return answer.status, dict(answer.headers), answer.read()
            except urllib.error.HTTPError as e:
                if e.code == 416:  # an empty file has no first byte
                    return 200, {}, b""
                if e.code < 500 and e.code != 429 or attempt + 1 == self.ATTEMPTS:
                    raise
            except OSError:
                if attempt + 1 == self.ATTEMPTS:
                    raise
            time.sleep(0.2 * 2**attempt)
        raise OSError(self.url)

    def size(self) -> int:
        return self.length

    def read_at(self, length: int, offset: int) -> bytes:
        if not length:
            return b""
        if self.whole is not None:
            return self.whole[offset : offset + length]
        status, _, data = self._get(f"bytes={offset}-{offset + length - 1}")
        data = data[offset : offset + length] if status == 200 else data
        if len(data) != length:
            raise OSError(f"{len(data)} of {length} bytes came")
        return data


@dataclass
class Tally:
    """Requests made and bytes fetched by this process so far."""

    requests: int = 0
    bytes: int = 0


TALLY = Tally()


class PageCache:
    """Pages of far files, the least recently used gone first; ``capacity`` bytes at most in a process.

    A file goes by its name, size and version (ETag or time of change), so that a new one is read anew. Missing pages that lie next to one another are one request, so that the many
    short reads of a header, and neighbouring chunks, share theirs. A read of a quarter of the capacity or more passes by.
    """

    def __init__(self, capacity: int = 64 << 20, page: int = 1 << 16):
        self.capacity, self.page, self.held = capacity, page, 0
        self.pages: OrderedDict[tuple, bytes] = OrderedDict()

    def read(self, key: tuple[str, int, str], offset: int, length: int, fetch: Callable[[int, int], bytes]) -> bytes:
        """Bytes of the file ``key`` (name, size, version); ``fetch(offset, length)`` makes a request."""
        if not length or length * 4 >= self.capacity:
            return fetch(offset, length) if length else b""
        first, last = offset // self.page, (offset + length - 1) // self.page
        found = {}
        for k in range(first, last + 1):
            if (data := self.pages.get((key, k))) is not None:
                self.pages.move_to_end((key, k))
                found[k] = data
        k = first
        while k <= last:
            end = k
            while end <= last and end not in found:
                end += 1
            if end > k:
                data = fetch(k * self.page, min(end * self.page, key[1]) - k * self.page)
                for n in range(k, end):
                    found[n] = data[(n - k) * self.page : (n - k + 1) * self.page]
                    self._keep((key, n), found[n])
            k = end + 1
        data = b"".join(found[k] for k in range(first, last + 1))
        return data[offset - first * self.page :][:length]

    def _keep(self, name: tuple, data: bytes) -> None:
        self.pages[name] = data
        self.held += len(data)
        while self.held > self.capacity:
            self.held -= len(self.pages.popitem(last=False)[1])


CACHE = PageCache()


class ByteSource:
    """Random access by (offset, length); what was asked for but isn't there is an error. Far files are read through ``CACHE``."""

    def __init__(self, uri: str | bytes):
        self.uri = uri if isinstance(uri, str) else "<bytes>"
        if isinstance(uri, bytes | bytearray | memoryview):
            self.data, self.file, self.size = bytes(uri), None, len(uri)
            return
        from pyarrow import fs

        public = re.sub(r"^file:/+", "/", uri)
        try:
            self.version = ""
            if re.match("https?://", public):
                self.file = HttpFile(public)
                self.version = self.file.version
            else:
                system, path = (fs.LocalFileSystem(), os.path.abspath(public)) if "://" not in public else fs.FileSystem.from_uri(uri)
                self.file = system.open_input_file(path)
                self.version = str(system.get_file_info(path).mtime_ns) if "://" in public else ""
            self.data, self.size, self.far = None, self.file.size(), "://" in public
        except (OSError, ValueError) as e:
            raise SourceError(f"can't open {uri}: {e}") from e

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise SourceError(f"{self.uri}: bytes {offset} to {offset + length} of {self.size}")
        if self.data is not None:
            return self.data[offset : offset + length]
        return CACHE.read((self.uri, self.size, self.version), offset, length, self._fetch) if self.far and CACHE.capacity else self._fetch(offset, length)

    def _fetch(self, offset: int, length: int) -> bytes:
        TALLY.requests += 1
        TALLY.bytes += length
        return self.file.read_at(length, offset)

    def head(self, length: int) -> bytes:
        return self.read(0, min(length, self.size))

    def tail(self, length: int) -> bytes:
        n = min(length, self.size)
        return self.read(self.size - n, n)

    def all(self) -> bytes:
        return self.read(0, self.size)


def is_folder(uri: str) -> bool:
    """Whether the path, local or of an Arrow file system, is a folder."""
    from pyarrow import fs

    public = re.sub(r"^file:/+", "/", uri)
    if re.match("https?://", public):
        return False
    system, path = (fs.LocalFileSystem(), os.path.abspath(public)) if "://" not in public else fs.FileSystem.from_uri(uri)
    return system.get_file_info(path).type == fs.FileType.Directory


def put(uri: str, data: bytes) -> str:
    """Write a file whole, with the folders above it; its path."""
    from pyarrow import fs

    public = re.sub(r"^file:/+", "/", uri)
    system, path = (fs.LocalFileSystem(), os.path.abspath(public)) if "://" not in public else fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)
    return uri


def scratch(spark) -> str:
    """A new folder below the one that executors share (``spark.checkpoint.dir``); it goes when Python ends. Where the
    setting is missing, a local session takes a temporary one, and a cluster fails."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
    out = f"{there.rstrip('/')}/gridloom-files-{uuid.uuid4().hex}"
    atexit.register(_remove, out)
    return out


def _remove(uri: str) -> None:
    from pyarrow import fs

    public = re.sub(r"^file:/+", "/", uri)
    try:
        system, path = (fs.LocalFileSystem(), public) if "://" not in public else fs.FileSystem.from_uri(uri)
        system.delete_dir(path)
    except OSError:
        pass
