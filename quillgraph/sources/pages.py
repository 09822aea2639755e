"""Works as pages of JSON lines, most cited first, and a source that reads only the pages asked for.

Pages lie in folders by type and year. Filters on those two columns are taken by the source, which
then opens no page of another type or year; what it can't judge stays with Spark. A page is one task,
and several are if there are very many, since a small page takes less time than a task's start.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "work_pages"
SCHEMA = "id string, title string, cited_by_count long, type string, year int, page int"
#: Tasks that pages are read in at most; more pages than that share tasks.
MOST_TASKS = 500
#: Rows of a page, as the interface that such pages come from gives at most.
PER_PAGE = 200


def write_pages(works: DataFrame, folder: str, per_page: int = PER_PAGE) -> None:
    """Write works (id, title, cited_by_count, type, year) in pages by type and year; year -1 and type "" stand for null."""
    line = Window.partitionBy("type", "year").orderBy(F.desc("cited_by_count"), "id")
    known = works.select("id", "title", F.col("cited_by_count").cast("long").alias("cited_by_count"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("year", F.lit(-1)).cast("int").alias("year"))
    paged = known.withColumn("page", F.floor((F.row_number().over(line) - 1) / per_page).cast("int"))
    row = F.to_json(F.struct("id", "title", "cited_by_count"), {"ignoreNullFields": "false"})
    text = paged.groupBy("type", "year", "page").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct((-F.col("cited_by_count")).alias("c"), "id", row.alias("row")))), lambda x: x.row)).alias("value"))
    text.write.partitionBy("type", "year", "page").option("compression", "none").text(folder)


def _holds(f, value) -> bool:
    if isinstance(f, In):
        return value in f.value
    return {EqualTo: lambda: value == f.value, GreaterThan: lambda: value > f.value, GreaterThanOrEqual: lambda: value >= f.value, LessThan: lambda: value < f.value, LessThanOrEqual: lambda: value <= f.value}[type(f)]()


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and f.attribute in (("type",), ("year",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from urllib.parse import unquote

        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        found = []
        for kind in system.get_file_info(fs.FileSelector(path)):
            if "=" not in kind.base_name:
                continue
            name = unquote(kind.base_name.partition("=")[2])
            values = {"type": "" if name == "__HIVE_DEFAULT_PARTITION__" else name}
            if not all(_holds(f, values["type"]) for f in self.filters if f.attribute == ("type",)):
                continue
            for year in system.get_file_info(fs.FileSelector(kind.path)):
                n = int(year.base_name.partition("=")[2])
                if all(_holds(f, n) for f in self.filters if f.attribute == ("year",)):
                    for page in system.get_file_info(fs.FileSelector(year.path)):
                        found.append((values["type"], n, int(page.base_name.partition("=")[2]), page.path))
        each = max(1, -(-len(found) // MOST_TASKS))
        return [InputPartition(found[i : i + each]) for i in range(0, len(found), each)] or [InputPartition([])]

    def read(self, partition):
        from pyarrow import fs

        for kind, year, page, path in partition.value:
            system, _ = fs.FileSystem.from_uri(self.folder)
            for file in system.get_file_info(fs.FileSelector(path)):
                if file.extension == "txt":
                    with system.open_input_stream(file.path) as stream:
                        for line in stream.read().decode().split("\n"):
                            if line:
                                row = json.loads(line)
                                yield row["id"], row["title"], row["cited_by_count"], kind, year, page


class WorkPages(DataSource):
    """``spark.read.format("work_pages").load(folder)``; the folder as a URI that all machines see."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """SCHEMA of the pages of a folder; filters on type and year decide which are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkPages)
    return spark.read.format(NAME).load(re.sub("^file:/(?!/)", "file:///", folder))
