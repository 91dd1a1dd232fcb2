"""Sessions as a launcher starts them: PySpark from its archive, and no shared folder set."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parents[1]

FROM_ARCHIVE = """
import pyspark
from pyspark.sql import SparkSession
from tessera.functions.geometry import register
assert ".zip" in pyspark.__file__, pyspark.__file__
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
register(spark)
assert spark.sql("select st_npoints(st_geomfromtext('POINT(1 1)'))").first()[0] == 1
"""

WITHOUT_FOLDER = """
from pyspark.sql import SparkSession
from tessera.scratch import Owner, Scratch, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
with Owner() as owner:
    df = Scratch(spark).table(spark.range(3), keep=True)
assert df.count() == 3 and shared_dir(spark) == shared_dir(spark)
files = df.inputFiles()
owner.close()
import os
assert files and not any(os.path.exists(x.removeprefix("file://")) for x in files)
"""


def run(code, tmp_path, **env):
    (tmp_path / "conf").mkdir()
    clean = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))}
    done = subprocess.run([sys.executable, "-c", code], env=clean | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path)} | env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-3000:]


def test_pyspark_from_its_archive(tmp_path):
    home = Path(pyspark.__file__).parent
    archives = sorted(str(p) for p in (home / "python" / "lib").glob("*.zip"))
    run(FROM_ARCHIVE, tmp_path, PYTHONPATH=os.pathsep.join([*archives, str(ROOT)]), SPARK_HOME=str(home))


def test_without_a_shared_folder(tmp_path):
    run(WITHOUT_FOLDER, tmp_path, PYTHONPATH=str(ROOT))
