"""Tables from and to files, by extension."""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTRIBUTED = {"csv", "tsv", "txt", "parquet", "json", "jsonl", "orc"}
FOREIGN = {"rds", "qs2", "rdata", "rda"}


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def _needs(module: str, what: str) -> None:
    try:
        importlib.import_module(module)
    except ImportError:
        raise ImportError(f"{what} files need the package {module}") from None


def _csvy(path: str, **options) -> pd.DataFrame:
    """A CSV after a YAML head between two lines of dashes."""
    with open(path) as f:
        lines = f.read().split("\n")
    marks = [i for i, line in enumerate(lines) if line.strip().strip("#").strip() == "---"]
    start = marks[1] + 1 if len(marks) > 1 else 0
    import io

    return pd.read_csv(io.StringIO("\n".join(lines[start:])), **options)


def _geojson(path: str, **_) -> pd.DataFrame:
    """One row per feature: its properties, and the geometry as JSON text."""
    with open(path) as f:
        doc = json.load(f)
    return pd.DataFrame([{**(x.get("properties") or {}), "geometry": json.dumps(x.get("geometry"))} for x in doc["features"]])


def _yaml(path: str, **_) -> pd.DataFrame:
    _needs("yaml", "YAML")
    import yaml

    with open(path) as f:
        got = yaml.safe_load(f)
    return pd.json_normalize(got if isinstance(got, list) else [got])


def _excel(path: str, **options) -> pd.DataFrame:
    _needs("openpyxl", "Excel")
    return pd.read_excel(path, **options)


def _spss(path: str, **options) -> pd.DataFrame:
    _needs("pyreadstat", "SPSS")
    return pd.read_spss(path, **options)


LOADERS: dict[str, Callable[..., pd.DataFrame]] = {
    "feather": pd.read_feather,
    "dta": pd.read_stata,
    "sas7bdat": pd.read_sas,
    "xpt": pd.read_sas,
    "sav": _spss,
    "xls": _excel,
    "xlsx": _excel,
    "yml": _yaml,
    "yaml": _yaml,
    "csvy": _csvy,
    "geojson": _geojson,
}


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Reads by extension. Splittable formats are scanned by Spark; the others are small by nature and loaded on the driver."""
    ext = extension(path)
    if ext in FOREIGN:
        raise ValueError(f".{ext} files hold objects of another language; export them as parquet or csv")
    if ext in LOADERS:
        return spark.createDataFrame(LOADERS[ext](path, **options))
    if ext not in DISTRIBUTED and ext:
        raise ValueError(f"unknown file format: .{ext}")
    reader = spark.read.schema(schema) if schema else spark.read
    if ext in ("csv", "tsv", "txt"):
        return reader.options(**{"header": True, "sep": "," if ext == "csv" else "\t", **options}).csv(path)
    if ext in ("json", "jsonl"):
        return reader.options(**{"multiLine": ext == "json", **options}).json(path)
    return (reader.options(**options).orc if ext == "orc" else reader.options(**options).parquet)(path)


def write(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Writes by extension. A geometry column is dropped where the format has no place for it."""
    ext = extension(path)
    if ext in FOREIGN:
        raise ValueError(f".{ext} files hold objects of another language")
    if ext in ("parquet", "feather") and "geometry" in df.columns:
        df = df.drop("geometry")
    out = df.write.mode(mode)
    if ext in ("csv", "tsv", "txt"):
        out.options(**{"header": True, "sep": "," if ext == "csv" else "\t", **options}).csv(path)
    elif ext == "parquet":
        out.options(**options).parquet(path)
    elif ext in ("json", "jsonl"):
        out.options(**options).json(path)
    elif ext == "orc":
        out.options(**options).orc(path)
    elif ext == "feather":
        import pyarrow.feather

        pyarrow.feather.write_feather(df.toArrow(), path)
    elif ext == "dta":
        df.toPandas().to_stata(path, write_index=False)
    elif ext == "xlsx":
        _needs("openpyxl", "Excel")
        df.toPandas().to_excel(path, index=False)
    elif ext == "geojson":
        rows = df.toPandas().to_dict("records")
        features = [{"type": "Feature", "properties": {k: v for k, v in r.items() if k != "geometry"}, "geometry": json.loads(r["geometry"]) if r.get("geometry") else None} for r in rows]
        with open(path, "w") as f:
            json.dump({"type": "FeatureCollection", "features": features}, f, default=str)
    else:
        raise ValueError(f"unknown file format: .{ext}")


def array_rows(df: DataFrame, values: str, dims: list[str]) -> DataFrame:
    """Nested arrays to long rows: one index column per dimension, from 1; nulls stay."""
    out = df
    for i, dim in enumerate(dims):
        last = i == len(dims) - 1
        rest = [c for c in out.columns if c != values]
        out = out.select(*rest, F.posexplode_outer(values).alias(dim, values if last else "_inner"))
        out = out.withColumn(dim, F.col(dim) + 1)
        if not last:
            out = out.withColumnRenamed("_inner", values)
    return out
