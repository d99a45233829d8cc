import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
RUN = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
def lacks(parts):
    import importlib.util
    yield from [importlib.util.find_spec("featspark") is None for _ in parts]
assert all(spark.sparkContext.parallelize(range(4), 4).mapPartitions(lacks).collect())
from featspark.llm.queries import queries
for name, query in queries().items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != ROOT]
    done = subprocess.run([sys.executable, "-c", RUN, f"file://{tmp_path}/shared"], cwd=tmp_path, env={**env, "PYTHONPATH": ":".join(paths)},
                          capture_output=True, text=True, timeout=900)
    assert done.stdout.count("ran ") == 11, done.stdout + done.stderr[-3000:]
