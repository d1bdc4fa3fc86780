"""Landed feed files as a data source for batch and stream: RSS and Atom alike, one row per item."""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.parsers import expat

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ITEM_TAGS = ("item", "entry")  # RSS, Atom
CHUNK = 1 << 18
TASK_BYTES = 8 << 20


class ItemCutter:
    """Cuts the raw text of each item out of one file while the file is parsed; holds one item and one chunk."""

    def __init__(self) -> None:
        self.error: str | None = None
        self._parser: expat.XMLParserType | None = None
        self._decode = None
        self._encoding = "utf-8"
        self._held, self._base = bytearray(), 0  # bytes of the file from `_base` on
        self._passed = 0  # where the last part outside items starts
        self._open: int | None = None  # where the open item starts
        self._depth = 0
        self._items: list[str] = []

    def feed(self, chunk: bytes) -> list[str]:
        """Items that end in ``chunk``; an empty chunk ends the file. After an error nothing follows."""
        if self._parser is None:
            self._begin(chunk)
        data = self._decode(chunk, not chunk).encode() if self._decode else chunk
        self._held += data
        try:
            self._parser.Parse(data, not chunk)
        except expat.ExpatError as e:
            self.error = str(e)
        keep = self._passed if self._open is None else self._open
        del self._held[: keep - self._base]
        self._base = keep
        items, self._items = self._items, []
        return items

    def _begin(self, head: bytes) -> None:
        wide = head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
        self._decode = codecs.getincrementaldecoder("utf-16")("replace").decode if wide else None
        self._parser = expat.ParserCreate("utf-8" if wide else None)
        self._parser.StartElementHandler = self._start
        self._parser.EndElementHandler = self._end
        self._parser.CharacterDataHandler = self._parser.CommentHandler = self._between
        if not wide:
            self._parser.XmlDeclHandler = self._declared

    def _declared(self, version: str, encoding: str | None, standalone: int) -> None:
        self._encoding = encoding or "utf-8"

    def _between(self, text: str) -> None:
        self._passed = self._parser.CurrentByteIndex

    def _start(self, tag: str, attributes: dict) -> None:
        if self._open is not None:
            self._depth += 1
            return
        self._passed = self._parser.CurrentByteIndex
        if tag in ITEM_TAGS:
            self._open = self._passed

    def _end(self, tag: str) -> None:
        if self._open is None:
            return
        if self._depth:
            self._depth -= 1
            return
        at = self._parser.CurrentByteIndex  # of the end tag, or behind <item/>
        end = at - self._base
        if self._held.startswith(f"</{tag}".encode(), end):
            end = self._held.index(b">", end) + 1
        self._items.append(self._held[self._open - self._base : end].decode(self._encoding, "replace"))
        self._open, self._passed = None, at


@dataclass
class Files(InputPartition):
    """Files of one task: (feed, name)."""

    files: list[tuple[str, str]]


class LandedFiles:
    """The files below ``root``: a folder per feed (``feed=`` in front is left out), read in the order of their names.

    ``root`` is a local path or an address that every task can open. Names that start with ``_`` or ``.`` are skipped.
    """

    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.limit = int(options.get("limit", 100))

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def listed(self) -> list[tuple[str, str, int]]:
        """(feed, name, bytes) in order."""
        files, root = self._at()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        out = []
        for info in found:
            parts = info.path[len(root) :].strip("/").split("/")
            if info.type == fs.FileType.File and len(parts) > 1 and not any(p[0] in "_." for p in parts):
                out.append((parts[0].removeprefix("feed="), "/".join(parts), info.size))
        return sorted(out)

    def tasks(self, found: list[tuple[str, str, int]]) -> list[Files]:
        """Neighbouring files together up to ``TASK_BYTES``, so small files do not make a task each."""
        out, held = [], 0
        for feed, name, size in found:
            if not out or held + size > TASK_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].files.append((feed, name))
            held += size
        return out

    def rows(self, task: Files) -> Iterator[tuple]:
        """The first ``limit`` items of each file, then one row without text that ends the file and holds its error."""
        files, root = self._at()
        for feed, name in task.files:
            cutter, n = ItemCutter(), 0
            with files.open_input_stream(f"{root}/{name}") as f:
                chunk = f.read(CHUNK)
                done = not chunk
                while not done and n < self.limit:
                    for xml in cutter.feed(chunk)[: self.limit - n]:
                        yield feed, name, n, xml, None
                        n += 1
                    done = cutter.error or not chunk
                    chunk = chunk and f.read(CHUNK)
            yield feed, name, n, None, cutter.error


class FeedReader(LandedFiles, DataSourceReader):
    def partitions(self) -> Sequence[Files]:
        return self.tasks(self.listed())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class FeedStreamReader(LandedFiles, DataSourceStreamReader):
    """An offset is the name of the last file taken, for each feed: it grows with the feeds, not with the files."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {feed: name for feed, name, _ in self.listed()}

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        return self.tasks([f for f in self.listed() if start.get(f[0], "") < f[1] <= end.get(f[0], "")])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class FeedFiles(DataSource):
    """``landed_feeds``: the items of feed files, batch or stream.

    Each file is one fetch of a feed; of each the first ``limit`` (100) items count, the collector's own rule. Rows: feed,
    file, pos (from 0 in each file), xml (the item), error. Every file ends with one row whose xml is null: its pos is the
    number of items, its error the reason why the rest of the file could not be parsed. An empty file has no items.

    A stream takes the files of a feed in the order of their names, so collectors name them in ascending order (by time, say)
    and move them in when complete; a file named before one already taken is not read. Files that were taken may be moved away.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_feeds"

    def schema(self) -> str:
        return "feed string, file string, pos long, xml string, error string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)
