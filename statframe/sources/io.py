"""Reading and writing tables, the data-set catalogue, coordinates, generated noise."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.operators import core
from statframe.operators.quality import normality

# File endings read as paths; anything else is a catalogue key.
PATH_ENDINGS = (".csv", ".parquet")


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by the file ending."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if ending == ".parquet":
        return spark.read.parquet(path)
    if ending == ".json":
        return spark.read.json(path)
    raise ValueError(f"unknown file type: {path}")


def list_datasets(spark: SparkSession, catalog: str, search: str | None = None) -> DataFrame:
    """``name, desc, url`` of a catalogue file {key: {url, desc, …}}, filtered by part of the name."""
    raw = spark.read.text(catalog, wholetext=True)
    entry = "map<string, struct<url: string, desc: string, index: string, metadata: map<string, string>>>"
    out = raw.select(F.explode(F.from_json("value", entry)).alias("name", "e")).select(
        F.lower("name").alias("name"), F.col("e.desc").alias("desc"), F.col("e.url").alias("url"),
        F.col("e.index").alias("index"), F.col("e.metadata").alias("metadata"))
    return out.where(F.contains(F.col("name"), F.lit(search.lower()))) if search else out


def load(spark: SparkSession, key: str, catalog: str | None = None) -> DataFrame:
    """Read a path, or look the key up in the catalogue; field meanings become column comments."""
    if key.lower().endswith(PATH_ENDINGS):
        return read_path(spark, key)
    if catalog is None:
        raise ValueError(f"{key} is no known path; give a catalog")
    found = list_datasets(spark, catalog).where(F.col("name") == key.lower()).first()
    if found is None:
        raise KeyError(f"no data set named {key}")
    url = found["url"]
    if "://" not in url and not url.startswith("/"):
        url = os.path.join(os.path.dirname(catalog), url)
    df = read_path(spark, url)
    for c, text in (found["metadata"] or {}).items():
        if c in df.columns:
            df = df.withMetadata(c, {"comment": text})
    return df


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending == ".csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif ending == ".parquet":
        df.write.mode(mode).parquet(path)
    elif ending == ".json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown file type: {path}")


def valid_points(df: DataFrame, lat: str, lon: str, check: bool = False) -> DataFrame:
    """Rows whose coordinates parse and lie on the globe, with a WKT ``point``."""
    core.require(df, [lat, lon])
    out = df.withColumns({c: core.not_nan(F.col(c).try_cast("double")) for c in (lat, lon)}).where(
        F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    out = out.withColumn("point", F.format_string("POINT (%.6f %.6f)", F.col(lon), F.col(lat)))
    if check and out.isEmpty():
        raise ValueError("no row has usable coordinates")
    return out


def normal_values(spark: SparkSession, mean: float, std: float, size: int = 100, digits: int = 2,
                  seed: int = 3217, name: str = "X1") -> DataFrame:
    """Rounded normal noise that passes the K² test; reseeded up to 100 times."""
    for attempt in range(100):
        df = spark.range(size).select("id", F.round(F.randn(seed + attempt) * std + mean, digits).alias(name))
        if size < 8 or normality(df, [name]).first()["normal"]:
            return df
    return df


def normal_frame(spark: SparkSession, means, stds, sizes, digits=2, seed: int = 3217) -> DataFrame:
    """Columns X1..Xn of ``normal_values`` side by side (shorter ones end in NULL)."""
    n = len(means)
    digits = [digits] * n if isinstance(digits, int) else list(digits)
    if not len(stds) == len(sizes) == len(digits) == n:
        raise ValueError("means, stds, sizes and digits must have the same length")
    out = None
    for i, (m, s, k, d) in enumerate(zip(means, stds, sizes, digits)):
        one = normal_values(spark, m, s, k, d, seed + 1000 * i, f"X{i + 1}")
        out = one if out is None else out.join(one, "id", "full")
    return out
