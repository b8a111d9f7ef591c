"""Text, framed record, image, generated and append-log sources and sinks."""

from __future__ import annotations

import itertools
import struct
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, paths: str | list[str], whole: bool = False) -> DataFrame:
    """(value, file, size): lines of the files that match, whole lines however files are split."""
    return spark.read.text(paths, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def lines_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.split(text, "\n")).alias("line"))


#: A table of more bytes than this is left as its files are.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is small and its scan has fewer parts with rows than there are cores:
    a table whose file is one row group is else read by one task."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("part")).distinct().count()
    return df.repartition(cores) if filled < cores else df


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records as Parquet, columns pruned and filters pushed to the scan."""
    return spark.read.parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", *partition: str) -> None:
    out = df.write.mode(mode).option("compression", codec)
    (out.partitionBy(*partition) if partition else out).parquet(path)


#: Records of a framed file in one batch, and bytes.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def framed(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, payload) of files of length-prefixed records: a 4-byte little-endian length, then so many bytes.

    A task reads its files as streams, a batch of records at a time; only names come from the listing.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            for url in part["path"]:
                store, name = fs.FileSystem.from_uri(url)
                rows, size, at = [], 0, 0
                with store.open_input_stream(name) as f:
                    while head := f.read(4):
                        n = struct.unpack("<i", head)[0] if len(head) == 4 else -1
                        payload = f.read(n) if n >= 0 else b""
                        if len(payload) != n:
                            raise ValueError(f"{url}: record at {at} is cut off")
                        rows.append((url, at, payload))
                        at, size = at + 4 + n, size + n
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=["file", "at", "payload"])
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=["file", "at", "payload"])

    return files.mapInPandas(run, "file string, at long, payload binary")


def write_framed(df: DataFrame, path: str) -> int:
    """Write the payload column as length-prefixed records, a new file for each task that has rows; returns their number."""

    def run(batches):
        import uuid

        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        out, n = None, 0
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                if payload is not None:
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        name = f"{folder}/{uuid.uuid4().hex}"
                        out = store.open_output_stream(f"{name}.part")
                    out.write(struct.pack("<i", len(payload)) + payload)
                    n += 1
        if out is not None:
            out.close()
            store.move(f"{name}.part", f"{name}.bin")  # whole files only
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([f"{name}.bin"])], names=["n", "file"])

    return int(df.select("payload").mapInArrow(run, "n long, file string").agg(F.sum("n")).first()[0] or 0)


def frame(payloads: list[bytes]) -> bytes:
    return b"".join(struct.pack("<i", len(p)) + p for p in payloads)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, cols, data) of 8-bit portable greymaps, binary (P5) or plain (P2)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *parse_greymap(bytes(d))) for p, d in zip(part["path"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "rows", "cols", "data"])

    return files.mapInPandas(run, "name string, rows int, cols int, data array<int>")


def parse_greymap(data: bytes) -> tuple[int, int, list[int]]:
    kind, values, at = data[:2], [], 2
    while len(values) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        values.append(int(data[at:end]))
        at = end
    cols, rows, top = values
    if kind not in (b"P5", b"P2") or top > 255:
        raise ValueError("an 8-bit greymap is wanted")
    pixels = list(data[at + 1 : at + 1 + rows * cols]) if kind == b"P5" else [int(x) for x in data[at:].split()]
    if len(pixels) != rows * cols:
        raise ValueError("the image is cut off")
    return rows, cols, pixels


def plain_greymap(rows: Column, cols: Column, data: Column) -> Column:
    """Text of a plain greymap; values outside 0 to 255 become 0."""
    inside = F.transform(data, lambda v: F.when(v.between(0, 255), v).otherwise(0).cast("string"))
    return F.concat(F.lit("P2\n"), cols.cast("string"), F.lit(" "), rows.cast("string"), F.lit("\n255\n"), F.array_join(inside, " "), F.lit("\n"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def scramble(x: Column, seed: int = 1) -> Column:
    """A number below 2^31 that depends on all bits of a whole number below 2^31, by plain arithmetic that other engines repeat."""
    y = (x % (1 << 31) + seed * 40503) * 1103515245 % (1 << 31)
    y = y.bitwiseXOR(F.shiftright(y, 15)) * 747796405 % (1 << 31)
    return y.bitwiseXOR(F.shiftright(y, 13))


def unit(x: Column, seed: int = 1) -> Column:
    return scramble(x, seed) / F.lit(float(1 << 31))


def site_graph(spark: SparkSession, pages: int, links: int = 15, same_site: float = 0.9, sites: int | None = None, seed: int = 1) -> DataFrame:
    """(site, page, target_site, target): links of generated pages, most of them inside the site.

    Every value comes from the page and link number, so a lost task makes the same rows again. Site
    sizes fall off as a power of the site number.
    """
    sites = sites or max(1, pages // 100)
    site = lambda u: F.floor(u * u * u * sites).cast("long")
    rows = spark.range(pages).select(F.col("id").alias("page"), site(unit(F.col("id"), seed)).alias("site"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(links - 1))).alias("n"))
    link = F.col("page") * links + F.col("n")
    inside, other = unit(link, seed + 1) < same_site, site(unit(link, seed + 2))
    target = F.floor(unit(link, seed + 3) * pages).cast("long")
    return rows.select("site", "page", F.when(inside, F.col("site")).otherwise(other).alias("target_site"), target.alias("target"))


def random_digraph(spark: SparkSession, nodes: int, density: int = 4, seed: int = 1) -> DataFrame:
    """(source, target): density targets of each node, by the node and the link number."""
    rows = spark.range(nodes).select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(density - 1))).alias("n"))
    return rows.select("source", (scramble(F.col("source") * density + F.col("n"), seed) % nodes).alias("target"))


def strided(spark: SparkSession, n: int, shards: int) -> DataFrame:
    """(shard, id): 0 to n - 1, dealt by stride."""
    return spark.range(n).select(F.pmod(F.col("id"), F.lit(shards)).cast("int").alias("shard"), "id")


def through_process(df: DataFrame, column: str, command: list[str]) -> DataFrame:
    """(line): output lines of a command that reads the column's values as lines, one process for each task.

    Lines are written by a thread while the output is read, so neither is held whole.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True) as process:
            failed = []

            def feed():
                try:
                    with process.stdin as pipe:
                        for part in parts:
                            pipe.writelines(f"{v}\n" for v in part[column] if v is not None)
                except Exception as e:  # raised below, in the task's own thread
                    failed.append(e)

            writer = threading.Thread(target=feed, daemon=True)
            writer.start()
            while lines := list(itertools.islice(process.stdout, BATCH_ROWS)):
                yield pd.DataFrame({"line": [x.rstrip("\n") for x in lines]})
            writer.join()
        if process.returncode or failed:
            raise RuntimeError(f"{command[0]} ended with {process.returncode}") from (failed or [None])[0]

    return df.select(column).mapInPandas(run, "line string")


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(_fs(spark, path)[0].exists(_fs(spark, path)[1]))


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder in its own file system."""
    fs, path = _fs(spark, source)
    return bool(fs.rename(path, _fs(spark, target)[1]))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def slurp(spark: SparkSession, path: str) -> str:
    """A small file as one text."""
    return text_lines(spark, path, whole=True).first()["value"]
