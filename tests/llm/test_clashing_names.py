"""Columns of the input that have the names of inner ones, and workers without the package."""

import subprocess
import sys

from tallywatch.llm import jaccard, lines, packing, toxicity
from tallywatch.llm.queries import vocabulary

CLASHES = ["score", "best", "top", "gone", "line", "text_hash", "_queue", "_name", "queue", "part", "_kept", "component_id", "n", "node", "label", "_0", "_n"]


def test_extra_columns_with_inner_names(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta\nalpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(i, text + f"\nown line number {i} of text {i * 7}", "s", i % 2, *["x"] * len(CLASHES)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, toxic int, " + ", ".join(f"{c} string" for c in CLASHES)).drop("toxic")
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(8)], "doc_id bigint, toxic int")
    assert toxicity.clean_documents(docs, labels).columns == docs.columns
    cut = lines.remove_lines(docs)
    assert cut.columns == docs.columns and cut.where("gone <> 'x'").count() == 0 and cut.count() == 8
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns and kept.where("_kept <> 'x'").count() == 0 and kept.count() >= 1
    assert packing.pack(docs, vocabulary("word_bpe_49k.json")).select("doc_id").distinct().count() == 8


def test_broadcast_model_needs_no_package(spark, tmp_path):
    from pyspark import cloudpickle

    model = toxicity.Model(*[__import__("numpy").zeros(1)] * 2, 0.1, 0.0, __import__("numpy").zeros(3))
    (tmp_path / "m").write_bytes(cloudpickle.dumps((model.parts(), toxicity._score_rows)))
    done = subprocess.run(
        [sys.executable, "-c", "import pickle, sys; sys.path = [p for p in sys.path if p]; x = pickle.load(open('m', 'rb')); print(len(x[0]))"],
        cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": ":".join(p for p in sys.path if "repo" not in p and p), "PATH": "/usr/bin:/bin"},
    )
    assert done.stdout.strip() == "5", done.stderr
