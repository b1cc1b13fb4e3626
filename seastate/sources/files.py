"""Files by URI from any Python process: listing by globs, opening, and moving into place."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow.fs as pafs


@dataclass(frozen=True, order=True)
class File:
    path: str
    size: int
    stamp: int


def system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; without a scheme, a local path."""
    scheme, _, rest = uri.partition(":") if re.match(r"[a-z][a-z0-9+.-]+:/", uri) else ("file", "", uri)
    if scheme == "file":
        return pafs.LocalFileSystem(), posixpath.abspath(rest.removeprefix("//"))
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest, '/:@?&=%*,+~')}")


def pattern(glob: str) -> re.Pattern:
    """A glob's paths: * and ? stay within a folder, {a,b} is either."""
    out, depth = "", 0
    for c in glob:
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
    return re.compile(out + ")" * depth)


def found(uris: str | list[str]) -> list[File]:
    """All files of paths, folders (all that is in them) and globs, by path; names that begin with _ or . are left out below a folder. Nothing is opened."""
    out: dict[str, File] = {}
    for uri in [uris] if isinstance(uris, str) else uris:
        fs, at = system(uri)
        fixed = re.match(r"[^*?{]*", at)[0]
        if fixed != at:
            base, test = fixed.rpartition("/")[0] or "/", pattern(at)
        else:
            info = fs.get_file_info(at)
            if info.type == pafs.FileType.File:
                out[at] = File(at, info.size, info.mtime_ns or 0)
                continue
            base, test = at.rstrip("/"), None
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True)):
            shown = not any(part[:1] in "_." for part in info.path[len(base) :].strip("/").split("/"))
            if info.type == pafs.FileType.File and shown and (test is None or test.fullmatch(info.path)):
                out[info.path] = File(info.path, info.size, info.mtime_ns or 0)
    return [out[p] for p in sorted(out)]


def opened(fs: pafs.FileSystem, path: str) -> tuple[BinaryIO, bool]:
    """The file's bytes, unpacked if they are gzip's, and whether they are."""
    raw = io.BufferedReader(fs.open_input_file(path), 1 << 20)
    packed = raw.peek(2)[:2] == b"\x1f\x8b"
    return (gzip.GzipFile(fileobj=raw), True) if packed else (raw, False)


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)
