import os
import subprocess
import sys
import tempfile
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import tempfile
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
def seen(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("quantfeed") is not None] * b.num_rows)], ["s"])
assert not any(r.s for r in spark.range(2).mapInArrow(seen, "s boolean").collect())
from quantfeed.llm import langid, queries
for name in ("op1_nearest", "op3_main_text", "op5_languages", "op6_vector_groups", "op10_packed"):
    assert queries.QUERIES[name](spark, {sf!r}).count() > 0, name
assert langid.accepted_documents(spark.read.parquet({sf!r} + "/documents.parquet")).count() > 0
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(sf):
    """Only the driver can import the package; workers start elsewhere, without it on their path."""
    root = str(Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=sf)], cwd=tempfile.mkdtemp(prefix="spark-"), env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
