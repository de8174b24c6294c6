"""Localisation tables on disk: Parquet, CSV, JSON and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import exprs
from lumenframe.operators.filters import complete_rows


def read_locs(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, first_frame: int | None = None, pattern: str | None = None) -> DataFrame:
    """Tables as one, with ``fov_name`` of their files; rows before ``first_frame`` are cut at the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = reader.parquet(*paths)
    if first_frame is not None:
        out = out.where(F.col("frame") >= first_frame)
    if "fov_name" in out.columns:
        return out
    return out.withColumn("fov_name", exprs.fov_name(F.regexp_replace(F.input_file_name(), r"\.parquet$", "")))


def prepared(df: DataFrame, normalise: bool = True) -> DataFrame:
    """Rows to be stored: without empty ones, whole frames, photon columns."""
    out = complete_rows(df)
    if "frame" in out.columns:
        out = out.withColumn("frame", F.col("frame").cast("int"))
    return out if "photons" in out.columns else exprs.photon_columns(out, normalise)


def write_locs(df: DataFrame, path: str, append: bool = False, normalise: bool = True, follow: bool = False) -> None:
    """Store a table; appended rows get the stored types, and frames after the stored ones if they ``follow``."""
    spark, out = df.sparkSession, prepared(df, normalise)
    if append:
        try:
            stored = spark.read.parquet(path)
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        if stored is not None:
            out = conform(out, stored.schema)
            if follow:
                top = stored.agg(F.max("frame")).first()[0]
                out = out.withColumn("frame", (F.col("frame") + (0 if top is None else int(top) + 1)).cast("int"))
    out.write.mode("append" if append else "overwrite").parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast shared columns to stored types, but a whole-number column stays fractional if a cast would lose decimals."""
    casts = {}
    for f in schema.fields:
        if f.name in df.columns:
            own = df.schema[f.name].dataType
            whole = isinstance(f.dataType, (T.IntegerType, T.LongType)) and isinstance(own, (T.DoubleType, T.FloatType))
            casts[f.name] = F.when(F.col(f.name) == F.floor(f.name), F.col(f.name)).otherwise(F.raise_error(F.lit(f"{f.name} would lose decimals"))).cast(f.dataType) if whole else F.col(f.name).cast(f.dataType)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(casts | missing)


def in_frame_order(df: DataFrame, id_col: str = "loc_id") -> DataFrame:
    return df.orderBy("frame", id_col) if id_col in df.columns else df.orderBy("frame")


def rewrite_sorted(spark: SparkSession, path: str, to: str) -> None:
    """Store a table again in frame order, files as ranges of frames; the old one stays."""
    in_frame_order(spark.read.parquet(path)).write.parquet(to)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Benchmark summaries."""
    df.write.mode("overwrite").parquet(path)


def find_files(spark: SparkSession, folder: str, *parts: str) -> DataFrame:
    """Paths below a folder whose names hold all the given parts."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    for p in parts:
        out = out.where(F.element_at(F.split("path", "/"), -1).contains(p))
    return out


def as_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every column but the last as double."""
    chosen = list(columns or df.columns[:-1])
    return df.withColumns({c: F.col(c).cast("double") for c in chosen})


def first_frame_key(text: Column) -> Column:
    """The first ``FrameKey`` object of movie metadata; the rest of a long text isn't parsed."""
    return F.regexp_extract(text, r'"FrameKey-[^"]*"\s*:\s*(\{(?:[^{}]|\{[^{}]*\})*\})', 1)


def imaging_metadata(text: Column) -> Column:
    """ROI (x, y, width, height) and exposure from the first frame's metadata; nulls if absent."""
    key = first_frame_key(text)
    roi = F.split(F.get_json_object(key, "$.ROI"), "-")
    at = lambda i: F.try_element_at(roi, F.lit(i)).cast("int")
    return F.struct(at(1).alias("x"), at(2).alias("y"), at(3).alias("width"), at(4).alias("height"), F.get_json_object(key, "$['Exposure-ms']").cast("double").alias("exposure_ms"))


def frame_count(text: Column) -> Column:
    """Number of frames that metadata names."""
    return F.size(F.regexp_extract_all(text, F.lit(r'"FrameKey-'), F.lit(0)))


def vendor_roi(text: Column) -> Column:
    """ROI of vendor metadata with named fields."""
    get = lambda k: F.get_json_object(text, f"$.ROI.{k}").cast("int")
    return F.struct(*[get(k).alias(k) for k in ("x", "y", "width", "height")])


def metadata_of(spark: SparkSession, folder: str, fallback: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Metadata of all ``*_metadata.txt`` files below a folder, a row each."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_metadata.txt").text(folder, wholetext=True)
    m = imaging_metadata(F.col("value"))
    out = files.select(exprs.fov_name(F.input_file_name()).alias("fov_name"), m.alias("m"), frame_count(F.col("value")).alias("n_frames"))
    cols = [F.coalesce(F.col(f"m.{k}"), F.lit(fallback[i] if fallback else None)).alias(k) for i, k in enumerate(("x", "y", "width", "height"))]
    return out.select("fov_name", *cols, "m.exposure_ms", "n_frames")


def required(info: DataFrame, *names: str) -> DataFrame:
    """Required values of metadata maps (column ``info``: array of maps, later ones win)."""
    whole = F.aggregate("info", F.expr("CAST(map() AS MAP<STRING, STRING>)"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(m), k)), m))
    out = info.withColumn("all__", whole)
    return out.select("*", *[F.coalesce(F.col("all__")[n], F.raise_error(F.lit(f"metadata lacks {n}")).cast("string")).alias(n) for n in names]).drop("all__")


#: Camera name, pixel size in micrometres at the sample, mosaic tile by rows, file of its efficiencies.
CAMERAS = (
    ("ximea", 0.069, "BGGR", "CS505CU_QE.csv"),
    ("zwo", 0.0715, "RGGB", "ASI585MC_QE.csv"),
)


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, "camera string, pixel_um double, mosaic string, efficiency_file string")


def camera(name: str) -> tuple[float, list[list[str]], str]:
    """Pixel size, mosaic tile and efficiency file of a camera, whatever the name's case."""
    for own, pixel, tile, file in CAMERAS:
        if own == name.lower():
            return pixel, [list(tile[:2]), list(tile[2:])], file
    raise ValueError(f"unknown camera {name}; known: {', '.join(c[0] for c in CAMERAS)}")
