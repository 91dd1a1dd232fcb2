"""Layers: tables of geometries read from text.

A layer has ``id`` (long), ``geom`` (WKB), ``geom_type``, its number of ``points``, and its envelope ``xmin, ymin, xmax, ymax``, computed once here; a partitioned layer
also ``pid``. Lines of at most ``SHORTEST`` bytes and lines that don't parse are skipped. Collections are flattened by one level, multipoints
aren't; an empty geometry stays, with a null envelope, and is never a candidate of a join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Literal
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import call, register
from tessera.operators.fetch import numbered

# What must equal the behaviour to be matched.
SHORTEST = 5
AUTO_LINES = 200

Validate = Literal["always", "never", "auto"]


READERS = {"st_geomfromtext": "st_layerfromtext", "st_geomfromwkbhex": "st_layerfromwkbhex"}
COLUMNS = ("part", "geom", "geom_type", "points", "xmin", "ymin", "xmax", "ymax")


def with_envelope(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Adds geom_type, points and the envelope's four columns to a table of geometries."""
    bounds = df.withColumn("__bounds", call("st_envelope", geom)).withColumn("geom_type", call("st_geometrytype", geom)).withColumn("points", call("st_npoints", geom))
    return bounds.select("*", *[F.col("__bounds")[i].alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))]).drop("__bounds")


def parse_lines(lines: DataFrame, value: str = "value", parser: str = "st_geomfromtext", validate: Validate = "always") -> DataFrame:
    """A layer of the geometries in a text column; other columns are kept, but for those named as the layer's own.

    ``validate``: drop lines whose whole geometry is invalid, always, never, or only where there are ``AUTO_LINES`` lines or more.
    ``part`` numbers the geometries of a line from 0. An ``id`` is added unless the lines have one. A line is parsed once: one
    function gives its geometries with their types and envelopes.
    """
    register(lines.sparkSession)
    kept = lines.where(F.octet_length(F.col(value)) > SHORTEST)
    if validate == "auto":
        validate = "always" if kept.limit(AUTO_LINES).count() >= AUTO_LINES else "never"
    if "id" not in lines.columns:
        kept = kept.withColumn("id", F.monotonically_increasing_id())
    others = [F.col(f"`{c}`") for c in kept.columns if c != value and c not in COLUMNS]
    return kept.select(*others, F.inline(call(READERS[parser], value, F.lit(validate == "always"))))


def stored(layer: DataFrame) -> DataFrame:
    """The layer, its rows numbered, written to the shared folder and read again: whatever reads it afterwards parses nothing."""
    return numbered(layer)


def read_wkt(spark: SparkSession, path: str, validate: Validate = "always") -> DataFrame:
    """A layer of WKT lines."""
    return parse_lines(spark.read.text(path), validate=validate)


def read_wkb_hex(spark: SparkSession, path: str, validate: Validate = "never") -> DataFrame:
    """A layer of hexadecimal WKB lines."""
    return parse_lines(spark.read.text(path), parser="st_geomfromwkbhex", validate=validate)


def read_partitioned(spark: SparkSession, path: str, parser: str = "st_geomfromtext", validate: Validate = "always", pids: Sequence[int] | None = None) -> DataFrame:
    """A layer of files whose names end in their partition number, before any extensions; it becomes ``pid``.

    A file without a number fails the read: leaving it out would lose its geometries. ``pids``, if given, are the partitions wanted; files of
    others are left out by name, before any is opened, and so are they where the numbers wanted are those of regions, see ``Regions.meeting``.
    """
    lines = spark.read.text(path)
    if pids is not None:
        files = [unquote(f) for f in lines.inputFiles()]  # of the listing; none is opened for it
        found = [re.search(r"(\d+)(?:\.[A-Za-z]\w*)*$", f.rsplit("/", 1)[-1]) for f in files]
        wanted = set(pids)
        lines = spark.read.text([f for f, number in zip(files, found, strict=True) if number is None or int(number[1]) in wanted] or path)
        lines = lines if any(number is None or int(number[1]) in wanted for number in found) else lines.limit(0)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    number = F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z]\w*)*$", 1)
    pid = F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no partition number in the name of "), name)).cast("int"))
    return parse_lines(lines.withColumn("pid", pid), parser=parser, validate=validate)


def _numbers(value: Column) -> Column:
    return F.split(F.trim(value), " +")


def parse_envelopes(lines: DataFrame, value: str = "value", weighted: bool = False) -> DataFrame:
    """Envelopes of lines ``x1 x2 y1 y2``, in either order of each two, and, ``weighted``, a whole number; other columns are kept, other lines skipped."""
    given = ["x1", "x2", "y1", "y2", *(["weight"] if weighted else [])]
    others = [F.col(f"`{c}`") for c in lines.columns if c not in (value, *given)]
    split = lines.withColumn("__n", _numbers(F.col(value))).where(F.size("__n") == len(given))
    read = split.select(*others, *[F.expr(f"try_cast(__n[{i}] as {'int' if c == 'weight' else 'double'})").alias(f"__{c}") for i, c in enumerate(given)])
    bounds = [f(f"__{a}1", f"__{a}2").alias(f"{a}{end}") for a in "xy" for f, end in ((F.least, "min"), (F.greatest, "max"))]
    return read.dropna(subset=[f"__{c}" for c in given]).select(*others, *bounds, *([F.col("__weight").alias("weight")] if weighted else []))


def read_envelopes(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return parse_envelopes(spark.read.text(path), weighted=weighted)
