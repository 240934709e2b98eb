"""Text files that hold the given values and nothing else.

Spark's text writer ends every row with a separator. Here rows are written as they are, so that a file can end without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "sijill_verbatim"


def _source() -> type[DataSource]:
    # Made inside a function, the classes travel to the workers by value: a cluster needs no copy of this package.
    class Written(WriterCommitMessage):
        def __init__(self, number: int, name: str, rows: int):
            self.number, self.name, self.rows = number, name, rows

    class VerbatimWriter(DataSourceWriter):
        """Tasks write to a hidden folder under names of their own; the commit gives their files the names in order."""

        def __init__(self, path: str, run: str):
            self.path, self.run = path, run

        def _folder(self):
            from pyarrow import fs
            system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
            return system, root, f"{root}/_writing-{self.run}"

        def write(self, iterator):
            import uuid

            from pyspark import TaskContext
            system, _, hidden = self._folder()
            system.create_dir(hidden, recursive=True)
            name, rows = f"{hidden}/{uuid.uuid4().hex}", 0
            with system.open_output_stream(name) as out:
                for row in iterator:
                    if row[0] is not None:
                        out.write(row[0].encode("utf-8"))
                        rows += 1
            return Written(TaskContext.get().partitionId(), name, rows)

        def commit(self, messages):
            system, root, hidden = self._folder()
            for m in messages:
                # Attempts that were not the ones to count stay in the hidden folder and go with it.
                if m is not None and m.rows:
                    system.move(m.name, f"{root}/part-{m.number:06d}.txt")
            if messages:
                system.delete_dir(hidden)
            with system.open_output_stream(f"{root}/_SUCCESS"):
                pass

        def abort(self, messages):
            from pyarrow import fs
            system, _, hidden = self._folder()
            if system.get_file_info(hidden).type == fs.FileType.Directory:
                system.delete_dir(hidden)

    class Verbatim(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def writer(self, schema, overwrite):
            return VerbatimWriter(self.options["path"].rstrip("/"), self.options["run"])

    return Verbatim


def write_verbatim(df: DataFrame, path: str) -> None:
    """Write the one string column of ``df`` to part files below ``path``; read in name order they are its rows in order, nulls left out.

    ``path`` is a folder that all executors see, a local one or one of the file systems that Arrow knows (hdfs://, s3://, gs://). It must hold
    no files yet. A run that fails leaves no part files.
    """
    import uuid

    spark = df.sparkSession
    from pyarrow import fs
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if system.get_file_info(root).type != fs.FileType.NotFound and system.get_file_info(fs.FileSelector(root)):
        raise FileExistsError(path)
    system.create_dir(root, recursive=True)
    spark.dataSource.register(_source())
    df.write.format(FORMAT).mode("append").option("path", path).option("run", uuid.uuid4().hex).save()
