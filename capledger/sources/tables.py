"""Readers: the driver's tables, bundle directories, and small configuration files."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import tomllib
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_FILE = 5 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a temporary one on one machine, and an error on a cluster, whose machines share none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="capledger-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_OWNED: list = []


def _clean(jvm, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may have gone at interpreter exit
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _OWNED:
        atexit.register(lambda: [_clean(jvm, p) for jvm, p in _OWNED])
    _OWNED.append((spark.sparkContext._jvm, path))
    return path


def kept(rows: DataFrame, path: str) -> DataFrame:
    """rows, written and read again: what builds on them doesn't compute them again, and executors may be lost."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(rows: DataFrame, by: str) -> DataFrame:
    """rows over all cores, by a column with many values, whatever files they come from: a table of few and small files is few tasks, and a pass over it in Python as many cores."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), by)


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(root, path, content)`` of all files under a folder of bundles, a bundle being each directory right below it. By Spark's own file listing, for any file system; links are followed or not as that does."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = os.path.abspath(folder).rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    return raw.select(F.regexp_extract(rel, "^([^/]+)/", 1).alias("root"), F.regexp_extract(rel, "^[^/]+/(.*)$", 1).alias("path"), "content").where("root <> '' and path not like '.git/%'")


def walk(root: str) -> Iterator[tuple[str, bytes | None, str | None, str | None]]:
    """(path, content, reason, note) of all that lies in a bundle's folder on a mounted file system.

    Files and folders are taken in order of name, without recursion, so that no depth is too deep. A link that leads out of the bundle or nowhere, and a folder met by a
    second way, are told as ``symlink_escape`` and not entered; what can't be read as ``parse_error``; neither is passed over in silence.
    """
    top = os.path.realpath(root)
    if not os.path.isdir(top):
        raise NotADirectoryError(root)
    seen, todo = {top}, [root]
    while todo:
        folder = todo.pop()
        below = []
        for name in sorted(os.listdir(folder)):
            at = os.path.join(folder, name)
            path = os.path.relpath(at, root).replace(os.sep, "/")
            try:
                path.encode()
            except UnicodeEncodeError:
                yield path.encode("utf-8", "replace").decode(), None, "symlink_escape", "the name is no UTF-8 and can't be told"
                continue
            real = os.path.realpath(at)
            if os.path.islink(at) and (not os.path.exists(real) or os.path.commonpath((top, real)) != top):
                yield path, None, "symlink_escape", "a link that leads out of the bundle, or nowhere"
            elif os.path.isdir(at):
                if real in seen:
                    yield path, None, "symlink_escape", "a folder that was entered by another way"
                else:
                    seen.add(real)
                    below.append(at)
            elif not os.path.isfile(at):
                yield path, None, "parse_error", "no regular file"
            else:
                try:
                    with open(at, "rb") as f:
                        content = f.read()
                except OSError as e:
                    # Nothing was read, so it counts as empty; the reason tells that it isn't.
                    yield path, b"", "parse_error", f"can't be read: {e.strerror}"
                else:
                    yield path, content, None, None
        todo += reversed(below)


class BundleSource(DataSource):
    """``spark.read.format("bundles").load(folder)``: ``(root, path, content, reason, note)`` by ``walk``, a partition for each bundle below the folder; with the option ``direct``, the folder is one bundle itself."""

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return "root string, path string, content binary, reason string, note string"

    def reader(self, schema) -> DataSourceReader:
        return _BundleReader(self.options)


class _BundleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.direct = options["path"].removeprefix("file://"), options.get("direct", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        if self.direct:
            return [InputPartition(self.folder)]
        return [InputPartition(os.path.join(self.folder, n)) for n in sorted(os.listdir(self.folder)) if n != ".git" and os.path.isdir(os.path.join(self.folder, n))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root = os.path.basename(os.path.realpath(partition.value) if self.direct else partition.value)
        for row in walk(partition.value):
            if not row[0].startswith(".git/"):
                yield (root, *row)


def walked(spark: SparkSession, folder: str, direct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files: root, path, content; problems: root, reason, file, note) of a folder of bundles, or of one bundle's own folder."""
    folder = os.path.abspath(folder.removeprefix("file://"))
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    spark.dataSource.register(BundleSource)
    x = spark.read.format("bundles").option("direct", str(direct).lower()).load(folder)
    return x.where("content is not null").select("root", "path", "content"), x.where("reason is not null").select("root", "reason", F.col("path").alias("file"), "note")


def find_roots(files: DataFrame) -> DataFrame:
    """(root): directories that hold exactly ``SKILL.md`` and lie in no other such; of a checkout's (path) rows."""
    dirs = files.where(F.regexp_extract("path", r"([^/]*)\z", 1) == "SKILL.md").select(F.regexp_extract("path", r"^(.*?)/?[^/]*\z", 1).alias("root")).distinct()
    outer = dirs.select(F.col("root").alias("outer"))
    # Ancestors of a root are few: each root's own prefixes are joined by equality, never root by root.
    up = dirs.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("root", "/")) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(F.split("root", "/"), F.lit(1), n), "/")))).alias("outer")).where("outer <> root")
    return dirs.join(up.join(outer, "outer", "left_semi").select("root"), "root", "left_anti")


def inventory(files: DataFrame) -> DataFrame:
    """``(root, path, size, sha256, parsed_as, parse_status, reason, text)``. The reason why a file has no text is ``size_limit``, ``binary_file`` or ``parse_error`` (no UTF-8).

    Hash and size are those of the bytes with newlines made one kind, so that a checkout with other line ends is the same; too large files are hashed so, too, byte by byte.
    Binary files and those that aren't UTF-8 are hashed as they are.
    """
    from capledger.functions import text as T

    c = F.col("content")
    large = F.length(c) > MAX_FILE
    reason = F.when(large, "size_limit").when(T.is_binary(c), "binary_file").when(~F.is_valid_utf8(c.cast("string")), "parse_error")
    x = files.select("root", "path", "content", reason.alias("reason"), T.is_binary(c).alias("binary"))
    text = F.when(F.col("reason").isNull(), T.normalize_newlines(c.cast("string")))
    # One byte a letter, so that bytes of any sort come back as they were.
    plain = F.encode(T.normalize_newlines(F.decode(c, "ISO-8859-1")), "ISO-8859-1")
    body = F.coalesce(F.col("text").cast("binary"), F.when((F.col("reason") == "size_limit") & ~F.col("binary"), plain), c)
    x = x.withColumn("text", text)
    status = F.when(F.col("reason").isNull(), "ok").when(F.col("reason") == "parse_error", "error").otherwise("unsupported")
    parsed = F.when(F.col("reason").isNull(), T.language_of(F.col("path"))).when(F.col("reason") == "binary_file", "binary").otherwise("unknown")
    return x.select("root", "path", F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"), parsed.alias("parsed_as"), status.alias("parse_status"), "reason", "text")


def read_toml(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)
