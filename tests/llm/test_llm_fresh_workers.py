import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r} + "/scratch").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
docs = spark.createDataFrame([(i, None if i % 2 else "", "en", "s", 0) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
docs.repartition(2).write.parquet({folder!r} + "/documents.parquet")
labels.write.parquet({folder!r} + "/labels.parquet")
import __spark_entry__ as entry
queries = entry.queries()
n = len(queries[{name!r}](spark, {folder!r}).collect())
print("rows", n)
"""


def run(name, folder):
    """A query in a process of its own, so that its workers have seen no text before."""
    script = SCRIPT.format(root=ROOT, tests=os.path.join(ROOT, "tests", "llm"), folder=str(folder), name=name)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600)
    assert "rows" in done.stdout, done.stderr[-3000:]
    return int(done.stdout.split()[-1])


def test_only_empty_texts_line_dedup(tmp_path):
    assert run("op2_line_dedup", tmp_path) == 20


def test_only_empty_texts_quality_rules(tmp_path):
    assert run("op1_quality_rules", tmp_path) == 20


def test_only_empty_texts_quality_classifier(tmp_path):
    assert run("op3_quality_classifier", tmp_path) == 20


def test_only_empty_texts_jaccard_join(tmp_path):
    assert run("op4_jaccard_join", tmp_path) == 20


def test_only_empty_texts_toxicity(tmp_path):
    assert run("op13_toxicity", tmp_path) == 20


def test_only_empty_texts_pipeline(tmp_path):
    # rejected or packed: no stage may fail
    assert run("pipeline", tmp_path) >= 0
