"""HTML page snapshots: {slug}/{language}.html beside {slug}/{language}.meta.json."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from provenant.functions.hashing import stable_id

_KEY = r"([^/]+)/([^/]+?)\.(?:html|meta\.json)$"
#: Tasks that list the folders of pages and read them.
LISTING_TASKS_PER_CORE = 4
#: Bytes of pages that a worker holds as it reads them, about.
READ_BYTES = 8 << 20
PAGE_COLUMNS = ["page_id", "slug", "language", "url", "html", "fetched_at", "not_modified"]


def _keyed(files: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return files.withColumns({"slug": F.regexp_extract(path, _KEY, 1),
                              "language": F.regexp_extract(path, _KEY, 2)})


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    def whole(names: str) -> DataFrame:
        return _keyed(spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names))

    html = whole("*.html").withColumnRenamed("value", "html")
    meta = whole("*.meta.json").select(
        "slug", "language", F.from_json("value", "url string, fetched_at timestamp").alias("m"))
    return html.join(meta, ["slug", "language"]).select(
        stable_id(F.col("slug"), F.col("language")).alias("page_id"), "slug", "language",
        F.col("m.url").alias("url"), "html", F.col("m.fetched_at").alias("fetched_at"),
        F.lit(False).alias("not_modified"))


def new_snapshots(pages: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Pages to write: all when forced, else those whose (slug, language) is not there yet."""
    if force:
        return pages
    return pages.join(existing.select("slug", "language"), ["slug", "language"], "left_anti")


def write_snapshots(pages: DataFrame, root: str, force: bool = False) -> None:
    """Columnar snapshot store, partitioned by act and language.

    Forcing replaces only the partitions present in ``pages``.
    """
    spark = pages.sparkSession
    if not force:
        reader = spark.read.schema(pages.schema)
        try:
            existing = reader.parquet(root)
        except Exception as error:  # the first write has nothing to read
            if "PATH_NOT_FOUND" not in str(error):
                raise
            existing = spark.createDataFrame([], pages.schema)
        pages = new_snapshots(pages, existing)
    (pages.select(*PAGE_COLUMNS).write.option("partitionOverwriteMode", "dynamic")
     .mode("overwrite" if force else "append").partitionBy("slug", "language").parquet(root))


def read_snapshot_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select(*PAGE_COLUMNS)


def _address(spark: SparkSession, root: str) -> str | None:
    """The folder as workers can open it themselves, or nothing where only Spark knows its scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    # Without a scheme a path is in Spark's default file system, which need not be the local one.
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toUri().toString().replace("s3a://", "s3://", 1)
    try:
        fs.FileSystem.from_uri(whole)
    except (pa.ArrowException, NotImplementedError, OSError):
        return None
    return whole


def _place(top: str, slug: str | None, language: str | None) -> tuple[str, str]:
    """The folder of a page's act and how the names of the page's files begin."""
    slug, language = ("__HIVE_DEFAULT_PARTITION__" if x is None else quote(x, safe="") for x in (slug, language))
    return f"{top}/slug={slug}", f"language={language}="


def _written(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Write the pages and pass on their addresses. A file is named by its task and its place among those of its page there, so a retry replaces it."""
    (files, top), task, seen = fs.FileSystem.from_uri(root), TaskContext.get().partitionId(), Counter()
    for batch in batches:
        for slug, language, html in zip(*(batch.column(c) for c in ("slug", "language", "html"))):
            folder, page = _place(top, slug.as_py(), language.as_py())
            name = f"{page}{task:05}-{seen[folder, page]}.txt"
            seen[folder, page] += 1
            files.create_dir(folder)
            with files.open_output_stream(f"{folder}/.{name}") as out:
                out.write(html.as_buffer())
            files.move(f"{folder}/.{name}", f"{folder}/{name}")
        yield batch.select([c for c in batch.schema.names if c != "html"])


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """The rows of pages, once for each file of theirs."""
    files, top = fs.FileSystem.from_uri(root)
    for batch in batches:
        places, texts, size = [], [], 0

        def taken():
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(places, pa.int32())).columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "html"])
        for place, (slug, language) in enumerate(zip(batch.column("slug").to_pylist(), batch.column("language").to_pylist())):
            folder, page = _place(top, slug, language)
            for file in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if file.base_name.startswith(page):
                    with files.open_input_stream(file.path) as text:
                        texts.append(text.read())
                    places.append(place)
                    size += len(texts[-1])
            if size > READ_BYTES:
                yield taken()
                places, texts, size = [], [], 0
        if places:
            yield taken()


def write_snapshot_files(pages: DataFrame, root: str) -> None:
    """One text file per page in the folder of its act, html/slug=/, and the pages' addresses beside them as a table.

    Workers write the files themselves: Spark's own writer takes some 30 ms a file on a local disk, for two folders, checksums and modes.
    It serves where only Spark knows the scheme of ``root``, with a folder per page.
    """
    html = F.coalesce("html", F.lit(""))
    about, address = pages.select("slug", "language", "url", "fetched_at"), _address(pages.sparkSession, root)
    if address is None:
        texts = pages.select("slug", "language", html.alias("value"))
        texts.write.partitionBy("slug", "language").option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(f"{root}/html")
    else:
        about = pages.select(*about.columns, html.cast("binary").alias("html")).mapInArrow(lambda batches: _written(batches, f"{address}/html"), about.schema)
    about.write.parquet(f"{root}/meta")


def _listed_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """Spark lists folders in a job of one task per folder, up to 10 000 of them. Here a folder is a page, so a few tasks per core list them."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    try:
        texts = spark.read.schema("value string, slug string, language string").text(f"{root}/html", wholetext=True)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    html = texts.select("slug", "language", F.rtrim(F.col("value"), F.lit("\x00")).alias("html"))
    return html.join(spark.read.parquet(f"{root}/meta"), ["slug", "language"])


def read_snapshot_files(spark: SparkSession, root: str) -> DataFrame:
    """Pages as written by ``write_snapshot_files``, each file whole.

    The table of addresses names the pages, and each task lists and reads those of its rows: the driver holds no list of files,
    and pages are not shuffled to meet their addresses.
    """
    address = _address(spark, root)
    if address is None:
        rows = _listed_by_spark(spark, root)
    else:
        tasks = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        meta = spark.read.parquet(f"{root}/meta").filter("slug is not null and language is not null")
        named = meta.repartition(tasks, "slug", "language").groupBy("slug", "language").agg(F.collect_list(F.struct("url", "fetched_at")).alias("about"))
        schema = T.StructType([*named.schema.fields, T.StructField("html", T.BinaryType())])
        files = named.mapInArrow(lambda batches: _read(batches, f"{address}/html"), schema)
        rows = files.select("slug", "language", F.col("html").cast("string").alias("html"), F.inline("about"))
    return rows.select(
        stable_id(F.col("slug"), F.col("language")).alias("page_id"), "slug", "language", "url", "html", "fetched_at", F.lit(False).alias("not_modified"))
