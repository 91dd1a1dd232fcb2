"""Every query in a session that names no shared folder, PySpark coming from its archive, against its oracle where it has one."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark
import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")

CODE = """
import sys
from pathlib import Path
import duckdb
from pyspark.sql import SparkSession
import __spark_entry__ as entry

data = sys.argv[1]
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
con = duckdb.connect()
for path in Path(data).glob("*.parquet"):
    con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
plain = lambda v: round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
rows = lambda df: sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
oracles = entry.oracle_sql()
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        got = query(spark, data).toPandas()
        same = rows(got) == rows(con.sql(oracles[name]).fetchdf()) if name in oracles else None
        print(name, len(got), same, flush=True)
        assert same is not False, name
"""


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_every_query(tmp_path):
    home = Path(pyspark.__file__).parent
    archives = sorted(str(p) for p in (home / "python" / "lib").glob("*.zip"))
    clean = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))}
    env = clean | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path), "SPARK_HOME": str(home), "PYTHONPATH": os.pathsep.join([*archives, str(ROOT), str(Path(duckdb.__file__).parents[1])])}
    done = subprocess.run([sys.executable, "-c", CODE, str(DATA)], env=env, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert len(done.stdout.splitlines()) == 14
