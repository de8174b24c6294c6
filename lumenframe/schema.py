"""Column sets of localisation tables.  Positions and widths are in camera pixels, x is the column, y the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.runtime import checkpointed

COLOURS = ("R", "G", "B")
AMPLITUDES = ("A_B", "A_G", "A_R")
BACKGROUNDS = ("bg_B", "bg_G", "bg_R")
#: The columns of a fitted localisation.
FITTED = ("xc", "yc", "s_x", "s_y", *BACKGROUNDS, *AMPLITUDES)
ERRORS = tuple(f"{c}_err" for c in FITTED)


def localisation_columns(elliptical: bool = False) -> list[str]:
    """Names of a single-frame table's columns, in order."""
    extra = ["theta", "theta_err"] if elliptical else []
    return [*FITTED, "chi_sqr", "frame", *ERRORS, *extra]


def localisation_schema(elliptical: bool = False) -> T.StructType:
    kinds = {"frame": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in localisation_columns(elliptical)])


def ensure_loc_id(df: DataFrame) -> DataFrame:
    """Give rows a ``loc_id`` if they have none: the order of the file, which several operators read.

    New ids are made once and kept, so a task that runs again sees the same.
    """
    return df if "loc_id" in df.columns else checkpointed(df.withColumn("loc_id", F.monotonically_increasing_id()))


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return df
