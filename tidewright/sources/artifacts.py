"""Artifacts: checksums, manifests, reports and array files."""

from __future__ import annotations

import hashlib
import io
import json
import os
from collections.abc import Iterator, Sequence
from pathlib import PurePath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import ship_package


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below a folder, computed where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def local_checksums(paths: Sequence[str], chunk: int = 1 << 20) -> dict[str, str]:
    """SHA-256 of files that the driver can read, in chunks, so of any size."""
    out = {}
    for path in paths:
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(chunk):
                digest.update(block)
        out[path] = digest.hexdigest()
    return out


def write_sums(path: str, sums: dict[str, str], root: str) -> None:
    """A SHA256SUMS file: a line for each file, its path relative to the root, in their order."""
    write_text_atomic(path, "".join(f"{sums[p]}  {portable_path(p, root)}\n" for p in sorted(sums)))


def table_checksum(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive checksum of a table's content, columns in name order."""
    columns = sorted(df.columns)
    digest = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).cast("string").alias("checksum"))


def portable_path(path: str, root: str) -> str:
    """A path relative to the root if it lies below, with forward slashes."""
    try:
        return PurePath(os.path.abspath(path)).relative_to(os.path.abspath(root)).as_posix()
    except ValueError:
        return PurePath(path).as_posix()


def write_text_atomic(path: str, text: str) -> None:
    """Writes beside the target, then renames."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def write_manifest(path: str, inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], policy: dict, audit: dict | None = None) -> dict:
    """A JSON manifest: checksum and columns of every input and output, the policy and the audit that belong to them."""
    entry = lambda df: table_checksum(df).first().asDict() | {"columns": dict(df.dtypes)}
    manifest = {"inputs": {k: entry(v) for k, v in inputs.items()}, "outputs": {k: entry(v) for k, v in outputs.items()}, "policy": policy, "audit": audit or {}}
    write_text_atomic(path, json.dumps(manifest, indent=1, sort_keys=True, allow_nan=False, default=str))
    return manifest


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """Reports with different columns as one table."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines under ``json`` and delimited files under ``csv``; nested values are JSON texts in the latter, NaN is refused."""
    numbers = [c for c, t in report.dtypes if t in ("double", "float")]
    if numbers:
        bad = report.agg(F.count_if(F.greatest(*[F.coalesce(F.isnan(f"`{c}`"), F.lit(False)) for c in numbers]) if len(numbers) > 1 else F.isnan(f"`{numbers[0]}`")).alias("n")).first().n
        if bad:
            raise ValueError(f"{bad} rows of the report hold NaN")
    report.write.mode(mode).json(f"{path}/json")
    nested = {c: F.to_json(f"`{c}`") for c, t in report.dtypes if t.startswith(("map", "array", "struct"))}
    report.withColumns(nested).write.mode(mode).option("header", True).csv(f"{path}/csv")


def read_npz(spark: SparkSession, path: str, arrays: Sequence[str], pattern: str = "*.npz") -> DataFrame:
    """Rows of array files: the named arrays share their first axis; each row has its number and one flat array each.

    Pickled content is refused.
    """
    names = list(arrays)
    schema = "path string, row_no bigint, " + ", ".join(f"`{n}` array<double>" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    missing = [n for n in names if n not in data]
                    if missing:
                        raise ValueError(f"{where} lacks the arrays {', '.join(missing)}")
                    values = {n: np.asarray(data[n], dtype=float) for n in names}
                sizes = {len(v) for v in values.values()}
                if len(sizes) != 1:
                    raise ValueError(f"the arrays of {where} differ in length")
                n = sizes.pop()
                yield pd.DataFrame({"path": [where] * n, "row_no": range(n), **{k: list(v.reshape(n, -1)) for k, v in values.items()}})

    files = ship_package(spark).read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, schema)
