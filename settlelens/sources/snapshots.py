"""Snapshot files and manifests: listing, hashing, reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


def _open_fs(uri: str):
    """(filesystem, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:"):])
    return fs.LocalFileSystem(), uri


def require_shared(spark: SparkSession, uri: str) -> None:
    """A plain path means the disk of whichever machine runs a task; it is accepted on one machine only."""
    plain = "://" not in uri and not uri.startswith("file:")
    master = spark.sparkContext.master
    if plain and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError(f"give a URI that every executor can reach instead of {uri}")


def scan_snapshot_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """(path, sha256, bytes) of every file under ``root``; paths are relative to it.

    Built-in file sources skip empty files and names starting with '.' or '_', and hold a whole file
    in one row. Here the driver only checks the top folder. Folders are listed level by level: those of a
    level are spread over the tasks and their entries written, so wide and deep trees are both split.
    The files found are spread anew and hashed in chunks.
    """
    from pyarrow import fs as pafs

    from settlelens.session import materialize

    require_shared(spark, root)
    system, top = _open_fs(root)
    info = system.get_file_info(top)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"snapshot folder does not exist: {root}")
    if info.type != pafs.FileType.Directory:
        raise ValueError(f"snapshot folder is not a directory: {root}")

    def children(batches):
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            system, _ = _open_fs(root)
            for path in pdf["path"]:
                found = system.get_file_info(fs.FileSelector(path, recursive=False))
                rows = [(e.path, e.type == fs.FileType.Directory) for e in found]
                yield pd.DataFrame(rows, columns=["path", "is_dir"])

    def digest(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            system, base = _open_fs(root)
            out = []
            for path in pdf["path"]:
                h, size = hashlib.sha256(), 0
                with system.open_input_stream(path) as stream:
                    while chunk := stream.read(CHUNK):
                        h.update(chunk)
                        size += len(chunk)
                out.append((path[len(base.rstrip("/")) + 1 :], h.hexdigest(), size))
            yield pd.DataFrame(out, columns=["path", "sha256", "bytes"])

    n = partitions or spark.sparkContext.defaultParallelism * 4
    level, files = spark.createDataFrame([(top,)], "path string"), None
    while not level.isEmpty():
        listed = materialize(level.repartition(n).mapInPandas(children, "path string, is_dir boolean"), "listing")
        found = listed.filter("NOT is_dir").select("path")
        files = found if files is None else files.unionByName(found)
        level = listed.filter("is_dir").select("path")
    return files.repartition(n).mapInPandas(digest, "path string, sha256 string, bytes bigint")


def path_order(path: str = "path"):
    """Sort keys that order paths part by part, so that a/b comes before a-b/c."""
    return (F.split(path, "/"),)


def by_path(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(*path_order(path))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) per manifest; broken JSON stays a row."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def manifest_entries(manifests: DataFrame, field: str = "files") -> DataFrame:
    """(manifest, path, sha256, bytes) of valid manifests; processed ones list them under ``outputs``."""
    doc = F.from_json("content", f"{field} ARRAY<STRUCT<path: STRING, sha256: STRING, bytes: BIGINT>>")
    return manifests.select(F.col("path").alias("manifest"), F.inline(doc[field]))
