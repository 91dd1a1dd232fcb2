"""Geometry functions, ``st_*``, over WKB in BINARY columns: thin JVM functions around the JTS library that Spark ships.

``register`` compiles the Java source once per machine and session user (a JDK's ``javac`` is needed on the driver only), adds the jar to
the session, so that executors fetch it, and registers the functions for SQL. A null argument or a failed computation is null.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import Path

import pyspark
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = Path(__file__).parent / "java" / "Functions.java"

#: What a line holds: its geometries by number, with their type and envelope.
PARTS = "array<struct<part:int,geom:binary,geom_type:string,points:int,xmin:double,ymin:double,xmax:double,ymax:double>>"

#: What two geometries share.
SHARED = "array<struct<geom:binary,geom_type:string,n_points:int,xmin:double,ymin:double,xmax:double,ymax:double>>"

#: SQL name, class, type of the result
FUNCTIONS: list[tuple[str, str, T.DataType | str]] = [
    ("st_geomfromtext", "FromText", T.BinaryType()),
    ("st_geomfromwkbhex", "FromHex", T.BinaryType()),
    ("st_astext", "AsText", T.StringType()),
    ("st_geometrytype", "TypeName", T.StringType()),
    ("st_isvalid", "IsValid", T.BooleanType()),
    ("st_npoints", "CountPoints", T.IntegerType()),
    ("st_numgeometries", "CountParts", T.IntegerType()),
    ("st_dump", "Dump", T.ArrayType(T.BinaryType())),
    ("st_envelope", "Bounds", T.ArrayType(T.DoubleType())),
    ("st_intersects", "Intersects", T.BooleanType()),
    ("st_intersection", "Intersection", T.BinaryType()),
    ("st_union", "Union", T.BinaryType()),
    ("st_intersection_npoints", "IntersectionPoints", T.IntegerType()),
    ("st_union_npoints", "UnionPoints", T.IntegerType()),
    ("st_layerfromtext", "LayerFromText", PARTS),
    ("st_layerfromwkbhex", "LayerFromHex", PARTS),
    # of a run: an array of geometries with one other
    ("st_intersects_each", "IntersectsEach", "array<boolean>"),
    ("st_intersection_each", "IntersectionEach", SHARED),
    ("st_intersection_npoints_each", "IntersectionPointsEach", "array<int>"),
    ("st_union_npoints_each", "UnionPointsEach", "array<int>"),
    ("st_tiles", "Tiles", "array<struct<xmin:double,ymin:double,xmax:double,ymax:double,full:boolean>>"),
    ("st_tile_codes", "TileCodes", T.BinaryType()),
    ("st_intersects_each_by_tiles", "IntersectsEachByTiles", "array<boolean>"),
    ("st_preparations", "Preparations", T.LongType()),
]

_registered: set[int] = set()


def _javac(spark: SparkSession) -> str:
    inside = Path(spark._jvm.java.lang.System.getProperty("java.home")) / "bin" / "javac"
    found = str(inside) if inside.exists() else shutil.which("javac")
    if not found:
        raise RuntimeError("geometry functions need a JDK (javac) on the driver")
    return found


def _class_path(spark: SparkSession) -> str:
    """Where the running JVM has its classes; this Python's PySpark may lie in an archive apart from them."""
    jvm = spark._jvm
    places = [jvm.java.lang.System.getProperty("java.class.path")]
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    for name in ("org.locationtech.jts.geom.Geometry", "org.apache.spark.sql.api.java.UDF1", "org.apache.spark.sql.Row"):
        try:
            source = loader.loadClass(name).getProtectionDomain().getCodeSource()
        except Py4JJavaError as e:
            raise RuntimeError(f"geometry functions need {name} on Spark's class path") from e
        if source is not None:
            places.append(jvm.java.nio.file.Paths.get(source.getLocation().toURI()).toString())
    return os.pathsep.join(dict.fromkeys(places))


def _compile(spark: SparkSession, work: str) -> None:
    asked = [_javac(spark), "-nowarn", "-d", work, "-cp", _class_path(spark), str(SOURCE)]
    done = subprocess.run(asked, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"javac failed on {SOURCE}:\n{done.stderr}")


def _jar(spark: SparkSession) -> Path:
    source = SOURCE.read_text()
    version = hashlib.sha256((source + pyspark.__version__).encode()).hexdigest()[:16]
    target = Path(tempfile.gettempdir()) / f"tessera-geometry-{version}.jar"
    if not target.exists():
        with tempfile.TemporaryDirectory() as work:
            _compile(spark, work)
            made = Path(work) / "made.jar"
            with zipfile.ZipFile(made, "w") as z:
                for path in sorted(Path(work).rglob("*.class")):
                    z.write(path, path.relative_to(work))
            part = target.with_name(f"{target.name}.{hashlib.sha256(work.encode()).hexdigest()[:8]}")
            shutil.copy(made, part)
            part.replace(target)
    return target


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions callable in the session, once."""
    key = spark._jsparkSession.hashCode()
    if key not in _registered or not spark.catalog.functionExists("st_intersects"):
        spark.sql(f"ADD JAR '{_jar(spark)}'")
        for name, cls, kind in FUNCTIONS:
            spark.udf.registerJavaFunction(name, f"tessera.geometry.Functions${cls}", kind)
        _registered.add(key)
    return spark


def call(name: str, *columns: Column | str) -> Column:
    return F.call_udf(name, *[F.col(c) if isinstance(c, str) else c for c in columns])
