"""Subtitle files as data sources: a reader with a reason for what can't be read, a writer with two phases.

``register(spark)`` makes the formats known:

* ``spark.read.format("subrip").load(folder)``: a row a file, its cues as an array;
* ``spark.read.format("whole_text").load(folder)``: a row a file, its text, for logs;
* ``rows.write.format("file_edits")``: one file a row (path, content), or its
  removal where the content is null. A column ``fallback`` says where a file
  goes that can't be written in its place. Paths are distinct.

Folders are reached through pyarrow's file systems: a path, or an address of a
scheme that they know, which the driver and all executors see alike.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# fixed values: reasons why a file has no cues
NO_CUES = "the track parsed to no cues at all"
UNREADABLE = "the track could not be extracted: "
#: Why a file is left as it is.
NOT_OURS, GONE = "the file there is not ours", "the file is no longer there"

_EDGES = re.compile(f"^(?:[\t-\r\x85]|(?![\x1c-\x1f])\\s)+|(?:[\t-\r\x85]|(?![\x1c-\x1f])\\s)+$")
_TIME = re.compile(r"(?:([+-]?[0-9]+):)?([+-]?[0-9]+):([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?|[+-]?[0-9]+\.)(?:(?![\x1c-\x1f])[\s\x85].*)?")
_NUMBER = re.compile(r"[+-]?[0-9]{1,5}")


def stripped(text: str) -> str:
    """Without white space at the ends; the separators U+001C to U+001F are none."""
    return _EDGES.sub("", text)


def seconds_of(text: str) -> float | None:
    """Seconds of [HH:]MM:SS with a point or a comma; what follows a blank is position data; nothing for anything else."""
    m = _TIME.fullmatch(stripped(text).replace(",", "."))
    return int(m[1] or 0) * 3600.0 + int(m[2]) * 60.0 + float(m[3]) if m else None


def cues_of(content: str) -> list[tuple[int, float, float, str]]:
    """(cue_idx, start_s, end_s, text) of a SubRip text, by the rules of ``sources.srt.parsed``."""
    blocks: list[tuple[str, list[str]]] = []
    open_ = False
    for line in re.split("\r\n|\r|\n", content.lstrip("﻿")):
        if "-->" in line:
            blocks.append((line, []))
            open_ = True
        elif open_ and stripped(line):
            blocks[-1][1].append(stripped(line))
        else:
            open_ = False
    found = []
    for timing, body in blocks:
        if body and len(body[-1]) <= 5 and _NUMBER.fullmatch(body[-1]):
            body.pop()
        start, end = (seconds_of(x) for x in timing.split("-->", 1))
        if body and start is not None and end is not None:
            found.append((len(found), start, max(start, end), " ".join(body)))
    return found


def decoded(raw: bytes) -> str:
    """Text by its byte order mark, UTF-8 without one; what is no text becomes U+FFFD."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[2:].decode(name, "replace")
    return raw.decode("utf-8-sig", "replace")


def file_system(path: str):
    """(pyarrow's file system of a path or address, the path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Some files: (path, size, time in nanoseconds)."""

    listed: list[tuple[str, int, int]]


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("name a folder or file to load")
        self.root, self.pattern, self.most = options["path"], options.get("pattern", "*"), int(options.get("maxbytes", 32 << 20))

    def partitions(self) -> list[Files]:
        """Listed, not opened; files of together ``maxBytes``, or one larger, are a partition."""
        from pyarrow import fs

        system, root = file_system(self.root)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        every = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        parts, size = [Files([])], 0
        for f in sorted((f for f in every if f.is_file and fnmatch.fnmatchcase(f.base_name, self.pattern)), key=lambda f: f.path):
            if parts[-1].listed and size + f.size > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].listed.append((f.path, f.size, f.mtime_ns or 0))
            size += f.size
        return parts

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.root)
        for path, size, at in partition.listed:
            try:
                with system.open_input_stream(path) as f:
                    text, error = decoded(f.read()), None
            except OSError as e:  # one file that can't be read is a row with its reason
                text, error = None, UNREADABLE + (e.strerror or type(e).__name__)
            yield path, size, datetime.fromtimestamp(at / 1e9, UTC), *self.told(text, error)

    def told(self, text: str | None, error: str | None) -> tuple:
        return text, error


class _SubripReader(_FolderReader):
    def told(self, text: str | None, error: str | None) -> tuple:
        cues = cues_of(text) if text is not None else []
        return cues, error or (None if cues else NO_CUES)


class WholeText(DataSource):
    """A row a file: ``path``, ``bytes``, ``modified``, ``content``, ``error``. Options: ``pattern`` of names, ``maxBytes`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "whole_text"

    def schema(self) -> str:
        return "path string, bytes long, modified timestamp, content string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader({k.lower(): v for k, v in self.options.items()})


class Subrip(WholeText):
    """A row a file: ``path``, ``bytes``, ``modified``, its ``cues`` and the ``error`` of a file that has none or can't be read."""

    @classmethod
    def name(cls) -> str:
        return "subrip"

    def schema(self) -> str:
        return "path string, bytes long, modified timestamp, cues array<struct<cue_idx:int,start_s:double,end_s:double,text:string>>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _SubripReader({k.lower(): v for k, v in self.options.items()})


def is_ours(path: str, markers: set[str]) -> bool:
    """Whether a file's name has one of the markers between its points."""
    stem = path.replace("\\", "/").rsplit("/", 1)[-1].lower().rsplit(".", 1)[0]
    return bool(markers & set(stem.split(".")))


@dataclass
class Prepared(WriterCommitMessage):
    """Where a task has listed what it prepared."""

    manifest: str | None


class EditWriter(DataSourceWriter):
    """Tasks write beside each file under a temporary name; the commit asks again whose the file is, and moves.

    The temporary name is made of the job's token alone, so a task that runs
    again writes over what its predecessor left. What a task prepared is listed
    in a file of the ``log`` folder; the driver gets the list's name.
    """

    #: Moves at once.
    LANES = 16

    def __init__(self, options: dict[str, str], columns: list[str]):
        missing = {"path", "content"} - set(columns)
        if missing or "log" not in options:
            raise ValueError(f"file edits need columns path and content, and a folder in the option log; missing: {sorted(missing) or 'log'}")
        self.at = [columns.index(c) if c in columns else None for c in ("path", "content", "fallback")]
        self.token = uuid.uuid4().hex
        self.log = f"{options['log'].rstrip('/')}/{self.token}"
        self.markers = {m for m in options.get("markers", "").lower().split(",") if m}

    def _temporary(self, path: str) -> str:
        return f"{path}.{self.token}.tmp"

    def _note(self, name: str, text: str) -> None:
        system, there = file_system(f"{self.log}/{name}")
        system.create_dir(there.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(there) as f:
            f.write(text.encode())

    def _put(self, path: str, content: str, noted: set[str]) -> str | None:
        """Write beside a path; why it could not be, or nothing. The folder is noted first, for who cleans up after a task that was killed."""
        system, there = file_system(path)
        folder = path.rsplit("/", 1)[0]
        try:
            system.create_dir(there.rsplit("/", 1)[0], recursive=True)
            if folder not in noted:
                noted.add(folder)
                self._note(f"folders/{hashlib.sha1(folder.encode()).hexdigest()}", folder)
            with system.open_output_stream(self._temporary(there)) as f:
                f.write(content.encode())  # UTF-8 without a byte order mark
        except OSError as e:
            return f"{type(e).__name__}: {e.strerror or 'failed'}"
        return None

    def _aborted(self) -> bool:
        system, there = file_system(f"{self.log}/aborted")
        return system.get_file_info(there).is_file

    def write(self, iterator: Iterator) -> Prepared:
        from pyspark import TaskContext

        done: list[dict] = []
        noted: set[str] = set()
        try:
            for row in iterator:
                path, content, fallback = (None if k is None else row[k] for k in self.at)
                if not path:
                    continue
                edit = {"path": path, "written": path, "writes": content is not None, "why": None}
                done.append(edit)
                if content is not None:
                    edit["why"] = self._put(path, content, noted)
                    if edit["why"] and fallback:
                        edit |= {"written": fallback, "why": self._put(fallback, content, noted)}
                    if self._aborted():
                        raise RuntimeError("the job was aborted")
            if not done:
                return Prepared(None)
            system, log = file_system(self.log)
            system.create_dir(log, recursive=True)
            context = TaskContext.get()
            manifest = f"{self.log}/prepared-{context.partitionId()}-{context.attemptNumber()}"
            with system.open_output_stream(file_system(manifest)[1]) as f:
                f.writelines(f"{json.dumps(x)}\n".encode() for x in done)
            return Prepared(manifest)
        except BaseException:
            self._drop(done)
            raise

    def _drop(self, edits) -> None:
        for edit in edits:
            if edit["writes"]:
                system, there = file_system(edit["written"])
                try:
                    system.delete_file(self._temporary(there))
                except OSError:
                    pass  # it was never there

    @staticmethod
    def _lines(manifest: str | None) -> Iterator[dict]:
        if manifest:
            system, there = file_system(manifest)
            with system.open_input_stream(there) as f:
                yield from map(json.loads, f.read().splitlines())

    def _finish(self, edit: dict) -> dict:
        system, there = file_system(edit["written"])
        why = edit["why"]
        if not why:
            try:
                exists = system.get_file_info(there).is_file
                if edit["writes"] and exists and not is_ours(there, self.markers):
                    why = NOT_OURS
                elif edit["writes"]:
                    system.move(self._temporary(there), there)
                elif exists:
                    system.delete_file(there)
                else:
                    why = GONE
            except OSError as e:
                why = f"{type(e).__name__}: {e.strerror or 'failed'}"
        if why:
            self._drop([edit])
        return {"path": edit["path"], "written": None if why else edit["written"], "action": "write" if edit["writes"] else "delete", "done": why is None, "message": why}

    def commit(self, messages: list[Prepared | None]) -> None:
        """Files are moved one list after the other; each move is whole or not at all. What became of each is a line of ``outcomes``."""
        system, log = file_system(self.log)
        system.create_dir(log, recursive=True)
        with ThreadPoolExecutor(self.LANES) as lanes, system.open_output_stream(f"{log}/outcomes.json") as f:
            for m in messages:
                for told in lanes.map(self._finish, self._lines(m.manifest) if m else ()):
                    f.write(f"{json.dumps(told)}\n".encode())

    def abort(self, messages: list[Prepared | None]) -> None:
        """Removes what tasks have put beside files, of killed ones too; a task that still runs sees that the job is over."""
        from pyarrow import fs

        self._note("aborted", "")
        system, folders = file_system(f"{self.log}/folders")
        for note in system.get_file_info(fs.FileSelector(folders, allow_not_found=True)):
            with system.open_input_stream(note.path) as f:
                where, folder = file_system(f.read().decode())
            for found in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if found.path.endswith(f".{self.token}.tmp"):
                    try:
                        where.delete_file(found.path)
                    except FileNotFoundError:
                        pass  # its task has removed it


class FileEdits(DataSource):
    """Files written and removed by rows (path, content, fallback or none). Options: ``log``, a folder for lists and outcomes; ``markers``, with commas, of names that may be written over."""

    @classmethod
    def name(cls) -> str:
        return "file_edits"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return EditWriter({k.lower(): v for k, v in self.options.items()}, schema.names)


def register(spark: SparkSession) -> None:
    for source in (WholeText, Subrip, FileEdits):
        spark.dataSource.register(source)


def apply_edits(rows, log: str, markers: list[str]):
    """Write and remove files by (path, content, fallback or none), and return (path, written, action, done, message) of each."""
    spark = rows.sparkSession
    register(spark)
    folder = f"{log.rstrip('/')}/{uuid.uuid4().hex}"
    asked = rows.select("path", "content", *[c for c in rows.columns if c == "fallback"])
    asked.write.format("file_edits").mode("append").option("log", folder).option("markers", ",".join(markers)).save()
    return spark.read.schema("path string, written string, action string, done boolean, message string").json(f"{folder}/*/outcomes.json")
