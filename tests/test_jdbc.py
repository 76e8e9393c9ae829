import os
import subprocess
import sys
from pathlib import Path

import pyspark

from plumbline.sources import jdbc

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: On two executors of their own processes: a key may be null, rows come in several partitions, pieces are small.
SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
from plumbline.plans.model import Target, Version
from plumbline.sources import jdbc

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
jdbc.PIECE = 30
server = jdbc.ServerStore(spark, f"jdbc:derby:{sys.argv[1]}/server;create=true", Target("postgres", Version(17)), {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
key = F.when(F.col("id") % 7 > 0, F.col("id") - 50)
rows = spark.range(0, 200, 1, 3).select(key.alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"), (F.col("id") / 3).alias("x"))
server.append("T", rows)
server.append("T", rows.limit(0))
for parts in (None, jdbc.Parts("k", 0, 100, 4)):
    found = server.table("T", parts)
    assert [c.lower() for c in found.columns] == ["k", "v", "x"], found.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
server.append("T", rows)
assert server.count("T") == 400
"""


def test_an_embedded_server_on_several_executors(tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]


def test_parts_hold_every_row_once():
    quote = "\"{}\"".format
    assert jdbc._conditions(None, ["K"], quote) == jdbc._conditions(jdbc.Parts("k", 5, 5, 3), ["K"], quote) == ["1 = 1"]
    assert jdbc._conditions(jdbc.Parts("k", 0, 9, 3), ["K"], quote) == ['"K" < 3 OR "K" IS NULL', '"K" >= 3 AND "K" < 6', '"K" >= 6']
    assert jdbc._conditions(jdbc.Parts("k", 0, 2, 9), ["K"], quote) == ['"K" < 0 OR "K" IS NULL', '"K" >= 0 AND "K" < 1', '"K" >= 1']
