import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})          # the driver's only: workers inherit neither this nor its folder
import __spark_entry__ as E
import corpus_pipeline
from pyspark.sql import functions as F
from shelfmark.llm.common import table
from shelfmark.session import local_session

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"there": [importlib.util.find_spec("shelfmark") is not None]}})

spark = local_session(4, 4)
assert not any(r["there"] for r in spark.range(4).mapInArrow(importable, "there boolean").collect())
for name in {names!r}:
    print(name, E.queries()[name](spark, {sf!r}).count(), flush=True)
docs = table(spark, {sf!r}, "documents")
print("stage", corpus_pipeline.language_id(spark, docs, {sf!r}).count(), corpus_pipeline.decontaminate(spark, docs, {sf!r}).count())
print("all done")
"""


def test_workers_without_the_package(tmp_path):
    """Executors have no copy of this package: what tasks need comes with them."""
    names = ["op2_language_id", "op3_lm_scoring", "op4_benchmark_decontamination", "op6_toxicity", "op7_token_ids",
             "op9_minhash_near_dedup", "op10_bpe", "op12_filter_audit", "op13_spelling_variants"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(root=ROOT, names=names, sf="/root/testdata/sf0.001"))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0 and "all done" in done.stdout, done.stdout[-2000:] + done.stderr[-4000:]
