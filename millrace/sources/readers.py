"""Sources: text, JSON, GeoJSON, CSV, layered Parquet, content-addressed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = """type string, features array<struct<
  properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"""


def jdbc_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A query that the source runs itself, so that it sends only what is asked for."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def layers(spark: SparkSession, pattern: str, name: str = "layer") -> DataFrame:
    """Files ``<name>_<number>.parquet`` as one table with their number; order by it, not by name."""
    number = F.regexp_extract(F.input_file_name(), name + r"_(\d+)\.parquet", 1).cast("int")
    return spark.read.parquet(pattern).withColumn(name, number)


def ids(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Trimmed distinct lines with a prefix."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.startswith("id", F.lit(prefix))).distinct()


def json_documents(spark: SparkSession, path: str, schema: str, by_line: bool = False) -> DataFrame:
    """A document (or a list of them) a file, or one a line."""
    return spark.read.schema(schema).json(path, multiLine=not by_line)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a ring: properties, feature, polygon and ring numbers, and the ring as array<struct<x, y>>; ring 0 is the outer one, the others are holes.

    Rings are closed in files and open in the library. A feature that is no polygon has no rows.
    """
    rows = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    kind = F.col("f.geometry.type")
    polygons = rows.select("feature", F.col("f.properties").alias("properties"), F.posexplode(F.when(kind == "MultiPolygon", many).when(kind == "Polygon", F.array(one))).alias("polygon", "rings"))
    rings = polygons.select("properties", "feature", "polygon", F.posexplode("rings").alias("ring_no", "r"))
    xy = F.transform("r", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rings.select("properties", "feature", "polygon", "ring_no", F.slice(xy, F.lit(1), F.size(xy) - 1).alias("ring"))


def described(df: DataFrame, table: str) -> DataFrame:
    """table, place, name, kind of the columns."""
    rows = [(table, n, f.name, f.dataType.simpleString()) for n, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table string, place int, name string, kind string")


def jdbc_tables(spark: SparkSession, url: str, names: list[str], **options: str) -> dict[str, DataFrame]:
    """Tables of a database, each scanned by what a query asks of it: filters and columns go to the source."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """file, field, row, col, value of the two-dimensional arrays in NumPy archives; a file is read by one task."""

    def go(parts):
        import io

        import numpy as np
        import pandas as pd

        for rows in parts:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for field in sorted(z.files):
                        if z[field].ndim == 2:
                            r, c = np.indices(z[field].shape)
                            yield pd.DataFrame({"file": name, "field": field, "row": r.ravel(), "col": c.ravel(), "value": z[field].astype(float).ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(go, "file string, field string, row long, col long, value double")


def blobs(spark: SparkSession, root: str, digests: DataFrame) -> DataFrame:
    """Content of the files ``aa/bb/<digest>.png`` that are asked for; missing ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.withColumn("digest", F.regexp_extract("path", r"([0-9a-f]{64})\.png$", 1))
    return found.join(digests, "digest", "left_semi").select("digest", "length", "content")


def optional_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns that are wanted, as nulls of the given type where the table lacks them."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in wanted.items()])


def levels(df: DataFrame) -> list[int]:
    """Numbers of the columns l<number>_sid."""
    import re

    return sorted(int(m[1]) for c in df.columns if (m := re.fullmatch(r"l(\d+)_sid", c)))
