"""``spark.read.format("surface-container")``: containers of a folder as a batch data source.

For stores that Arrow's file systems know; ``container.read`` goes through Spark's own reader instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import container
from .surfaces import SURFACES


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ContainerReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]

    def _files(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.root)

    def partitions(self) -> list[File]:
        from pyarrow.fs import FileSelector

        fs, base = self._files()
        return [File(f.path) for f in sorted(fs.get_file_info(FileSelector(base, recursive=True)), key=lambda f: f.path) if f.path.endswith(".x3p")]

    def read(self, partition: File) -> Iterator[tuple]:
        fs, _ = self._files()
        with fs.open_input_file(partition.path) as f:
            found = container.decode(f.read())
        h = found["heights"]
        heights = [None if x != x else x for x in h.ravel().tolist()]
        chain = [tuple(r[k] for k in ("name", "version", "parameters", "outcomes")) for r in found["provenance"]]
        yield (partition.path, h.shape[0], h.shape[1], found["spacing_y"], found["spacing_x"], found["unit"], found["orientation"], heights, chain)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "surface-container"

    def schema(self):
        return SURFACES

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ContainerSource)


