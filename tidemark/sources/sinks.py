"""Writing results: feature tables, and small artefacts with a manifest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def write_features(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Features as a table of files; arrays become joined text where the format has none."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "csv":
        df = df.select(*[F.array_join(c, ";").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer = writer.option("header", "true") if fmt == "csv" else writer
    writer.format(fmt).save(path)


def artefact(path: str, document: Any) -> dict[str, Any]:
    """Write a document (JSON with sorted keys, or text) and give its name, sha256 and size."""
    data = (document if isinstance(document, str) else json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(data)
    return {"path": Path(path).name, "sha256": hashlib.sha256(data).hexdigest(), "size_bytes": len(data)}


def manifest(root: str, artefacts: Mapping[str, Any], parameters: Mapping[str, Any]) -> dict[str, Any]:
    """Write all artefacts of a run and ``manifest.json`` beside them."""
    refs = [artefact(f"{root}/{name}", doc) for name, doc in sorted(artefacts.items())]
    artefact(f"{root}/manifest.json", {"artifacts": refs, "parameters": dict(parameters)})
    return {"artifacts": refs, "parameters": dict(parameters)}
