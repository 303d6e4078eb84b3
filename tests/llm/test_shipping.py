"""Executors that have no copy of the package: helpers and models travel with the jobs."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline
from corpusframe.llm import queries
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2] + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
rows = [(i, " ".join(f"w{(i * 7 + k * k) % 40}" for k in range(30)), "en", f"s{i % 3}", 0) for i in range(40)]
spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(sys.argv[2] + "/documents.parquet")
spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(sys.argv[2] + "/labels.parquet")
spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(sys.argv[2] + "/benchmark.parquet")
spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").write.parquet(sys.argv[2] + "/pages.parquet")
spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0 + i % 7]) for i in range(40)], "vec_id long, embedding array<float>").write.parquet(sys.argv[2] + "/embeddings.parquet")
for name in ("op2_fingerprints", "op11_suffix_dedup", "op12_periodic_runs", "op13_whitening", "op4_jaccard_join", "op6_toxicity", "op7_decontamination", "op9_lm_scoring", "op10_url_filters"):
    print(name, len(queries.QUERIES[name](spark, sys.argv[2]).collect()))
print("pipeline", corpus_pipeline.run(spark, sys.argv[2]).count() > 0)
"""


def test_jobs_run_where_workers_cannot_import_the_package(tmp_path):
    repo = Path(__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(repo), str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    said = dict(x.split() for x in run.stdout.splitlines() if x.startswith(("op", "pipeline")))
    assert said == {"op2_fingerprints": "40", "op11_suffix_dedup": "40", "op12_periodic_runs": "40", "op13_whitening": "120", "op4_jaccard_join": "40", "op6_toxicity": "40", "op7_decontamination": "40", "op9_lm_scoring": "40", "op10_url_filters": "1", "pipeline": "True"}
