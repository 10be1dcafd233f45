"""Tables to files: candidates, rendered skills, vectors."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from motif.sources.paths import below, opened

#: Where files wait below the root until all tasks are done. Readers of skills don't look into folders of folders.
WAITING = "_waiting"


@dataclass
class Written(WriterCommitMessage):
    """The folder in which one attempt of a task has put its files, as they are to stand below the root."""

    folder: str


class Files(DataSource):
    """format("motif_files").save(root): each row (path, content) as a file below root, all of them or none."""

    @classmethod
    def name(cls) -> str:
        return "motif_files"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["path"])


class FilesWriter(DataSourceWriter):
    """Tasks write below a folder of this write; when all are done, the driver moves file by file to its place.

    What a failed, repeated or lost attempt has written is in a folder that no message names, and goes with the rest. Two rows
    with one path leave either's whole content. If the driver is lost while it moves, a repeated write mends the tree.
    """

    def __init__(self, root: str):
        self.root, self.mine = root, f"{WAITING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = opened(self.root)
        folder, made = f"{self.mine}/{uuid.uuid4().hex}", set()
        for row in iterator:
            at = posixpath.join(top, folder, below(self.root, row["path"]))
            if posixpath.dirname(at) not in made:
                system.create_dir(posixpath.dirname(at), recursive=True)
                made.add(posixpath.dirname(at))
            with system.open_output_stream(at) as f:
                f.write((row["content"] or "").encode("utf-8"))
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = opened(self.root)
        for m in messages:
            if m is not None:
                self._move(system, posixpath.join(top, m.folder), top)
        self.abort(messages)

    def _move(self, system: fs.FileSystem, folder: str, top: str) -> None:
        left = [folder]
        while left:
            at = left.pop()
            place = posixpath.normpath(posixpath.join(top, posixpath.relpath(at, folder)))
            for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if i.type == fs.FileType.Directory:
                    system.create_dir(posixpath.join(place, i.base_name), recursive=True)
                    left.append(i.path)
                else:
                    system.move(i.path, posixpath.join(place, i.base_name))

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what this write has put to wait, and the place for it if nobody else waits there."""
        system, top = opened(self.root)
        mine, waiting = posixpath.join(top, self.mine), posixpath.join(top, WAITING)
        if system.get_file_info(mine).type == fs.FileType.Directory:
            system.delete_dir(mine)
        if system.get_file_info(waiting).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(waiting)):
            system.delete_dir(waiting)


def write_tree(files: DataFrame, root: str) -> None:
    """Each (path, content) as a file below root, a path or address that executors and driver share: all files, or none if a task fails.

    A file that is there is replaced, the others stay. A path that leaves root is an error; a null content is an empty file.
    """
    spark = files.sparkSession
    spark.dataSource.register(Files)
    files.select("path", "content").write.format("motif_files").mode("append").save(root)


def candidate_files(candidates: DataFrame) -> DataFrame:
    """(path, content): a JSON file for each candidate, named by its hash."""
    return candidates.select(F.concat("structural_hash", F.lit(".json")).alias("path"), F.to_json(F.struct(*candidates.columns)).alias("content"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)
