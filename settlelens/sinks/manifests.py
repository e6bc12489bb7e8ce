"""Provenance documents, one JSON text per row."""

from __future__ import annotations

import platform
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most entries in one document; a longer list goes on in numbered parts, so that no row grows without bound.
MAX_ENTRIES = 10_000
_SORTED = {"pretty": "true"}


def _environment():
    return F.struct(
        F.lit(platform.platform()).alias("platform"),
        F.lit(platform.python_implementation()).alias("python_implementation"),
        F.lit(sys.version.split()[0]).alias("python_version"),
    )


def _numbered_parts(files: DataFrame, keys: list[str], max_entries: int) -> DataFrame:
    """Entries split by hash so that no document holds more than about ``max_entries`` of them."""
    size = files.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / max_entries).cast("int").alias("n_parts"))
    return files.join(size, keys).withColumn("part", F.pmod(F.xxhash64("path"), F.col("n_parts")).cast("int"))


def _entries():
    """Entries in path order, compared part by part."""
    rows = F.sort_array(
        F.collect_list(F.struct(F.split("path", "/").alias("parts"), "bytes", "path", "sha256"))
    )
    return F.transform(rows, lambda r: F.struct(r.bytes.alias("bytes"), r.path.alias("path"), r.sha256.alias("sha256")))


def raw_manifests(files: DataFrame, command: str, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(name, document) per snapshot from files (source, as_of_utc_date, path, sha256, bytes).

    The usual snapshot gives one document. A larger one gives numbered parts, so that the list in
    one row stays bounded. Keys are in sorted order.
    """
    keys = ["source", "as_of_utc_date"]
    docs = (
        _numbered_parts(files, keys, max_entries)
        .groupBy(*keys, "part", "n_parts")
        .agg(_entries().alias("files"))
        .select(
            F.concat(
                "source",
                F.lit("_"),
                F.col("as_of_utc_date").cast("string"),
                F.when(F.col("n_parts") > 1, F.concat(F.lit(".part"), F.col("part").cast("string"))).otherwise(""),
                F.lit(".json"),
            ).alias("name"),
            F.struct(
                F.col("as_of_utc_date").cast("string").alias("as_of_utc_date"),
                F.lit(command).alias("command"),
                _environment().alias("environment"),
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("fetched_at_utc"),
                "files",
                "source",
            ).alias("doc"),
        )
    )
    return docs.select("name", F.to_json("doc", _SORTED).alias("document"))


def processed_manifest(
    outputs: DataFrame, inputs: list[str], as_of: str, script_path: str, git_sha: str, command: str,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """(name, document) of processed artifacts from outputs (name, path, sha256, bytes)."""
    docs = (
        _numbered_parts(outputs, ["name"], max_entries)
        .groupBy("name", "part", "n_parts")
        .agg(_entries().alias("outputs"))
        .select(
            F.concat(
                "name",
                F.lit(f"_{as_of}"),
                F.when(F.col("n_parts") > 1, F.concat(F.lit(".part"), F.col("part").cast("string"))).otherwise(""),
                F.lit(".json"),
            ).alias("file_name"),
            F.struct(
                F.lit(as_of).alias("as_of_utc_date"),
                F.array(*[F.lit(i) for i in inputs]).alias("inputs"),
                "outputs",
                F.struct(
                    F.lit(command).alias("command"),
                    F.lit(git_sha).alias("git_sha"),
                    F.lit(script_path).alias("script_path"),
                ).alias("transform"),
            ).alias("doc"),
        )
    )
    return docs.select(F.col("file_name").alias("name"), F.to_json("doc", _SORTED).alias("document"))


def run_manifest(
    run_id: str, run_date: str, commit: str, snapshots: DataFrame, coverage: DataFrame, reconciliation: DataFrame
) -> DataFrame:
    """Rows of one run's manifest as (section, document) JSON lines: no list grows with the run."""

    def section(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("document"))

    head = snapshots.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(run_date).alias("run_date"), F.lit(commit).alias("git_commit_hash")
    )
    return (
        section(head, "run")
        .unionByName(section(snapshots, "source_snapshots"))
        .unionByName(section(coverage, "coverage_metrics"))
        .unionByName(section(reconciliation, "reconciliation_metrics"))
    )


def write_documents(docs: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Each document as <folder>/<name>, written by the task that holds it.

    Without ``overwrite`` an existing document is an error: processed manifests are append-only.
    """
    from settlelens.sources.snapshots import require_shared

    require_shared(docs.sparkSession, folder)

    def write(batches):
        import pandas as pd

        from pyarrow import fs

        from settlelens.sources.snapshots import _open_fs

        system, base = _open_fs(folder)
        for pdf in batches:
            for folder_of in {f"{base.rstrip('/')}/{n}".rpartition("/")[0] for n in pdf["name"]}:
                system.create_dir(folder_of, recursive=True)
            for name, text in zip(pdf["name"], pdf["document"]):
                target, body = f"{base.rstrip('/')}/{name}", (text + "\n").encode()
                if system.get_file_info(target).type != fs.FileType.NotFound and not overwrite:
                    with system.open_input_stream(target) as existing:
                        if existing.read() == body:  # a retried task meets its own file
                            continue
                    raise FileExistsError(target)
                with system.open_output_stream(target) as out:
                    out.write(body)
            yield pd.DataFrame({"name": pdf["name"]})

    docs.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
