"""A sink for folders of files: a table of names and contents becomes one file a row, all of them or none.

    spark.dataSource.register(FileBundle); df.write.format("file_bundle").mode("append").save("reports/7")

Tasks write into a folder beside the target. Once all have ended, the files are moved to where they belong; if a task fails, a name is unsafe or comes twice, or the folder is in use, nothing of the bundle stays.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tabulon.errors import RefusedInput
from tabulon.sources.store import filesystem, inside


@dataclass
class _Done(WriterCommitMessage):
    files: dict[str, str]  # by name, where a task wrote it


class FileBundle(DataSource):
    """name string, content binary (or string, written as UTF-8). A bundle is a report's: its names go through the driver, its contents don't."""

    @classmethod
    def name(cls) -> str:
        return "file_bundle"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise RefusedInput("a bundle is never written over another")
        if sorted(schema.fieldNames()) != ["content", "name"]:
            raise RefusedInput("a bundle has the columns name and content")
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        from pyarrow.fs import FileSelector

        self.path, self.parts = path.rstrip("/"), f"{path.rstrip('/')}.{uuid.uuid4().hex}.parts"
        fs, inner = filesystem(self.path)
        if fs.get_file_info(FileSelector(inner, allow_not_found=True)):
            raise RefusedInput(f"{path} isn't empty")
        fs.create_dir(filesystem(self.parts)[1], recursive=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Files lie side by side under names of their own, so that a task that outlives the write can't make the folder anew."""
        fs, inner = filesystem(self.parts)
        files: dict[str, str] = {}
        for row in iterator:
            inside(self.path, row.name or "")
            name, target = posixpath.normpath(row.name), f"{inner}/{uuid.uuid4().hex}"
            if name in files:
                raise RefusedInput(f"two files are called {name!r}")
            files[name] = target
            content = row.content if row.content is not None else b""
            with fs.open_output_stream(target) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
        return _Done(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = filesystem(self.path)
        files: dict[str, str] = {}
        try:
            for m in messages:
                if m is not None:
                    if twice := sorted(files.keys() & m.files.keys()):
                        raise RefusedInput(f"two files are called {twice[0]!r}")
                    files |= m.files
            fs.create_dir(inner, recursive=True)
            try:
                for name, source in files.items():
                    fs.create_dir(posixpath.dirname(f"{inner}/{name}"), recursive=True)
                    fs.move(source, f"{inner}/{name}")
            except Exception:
                fs.delete_dir(inner)
                raise
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What tasks have written goes, that of failed and lost ones too; a task that still writes may need a second try."""
        from pyarrow.fs import FileType

        fs, inner = filesystem(self.parts)
        for _ in range(20):
            try:
                if fs.get_file_info(inner).type == FileType.Directory:
                    fs.delete_dir(inner)
                return
            except OSError:
                time.sleep(0.05)
