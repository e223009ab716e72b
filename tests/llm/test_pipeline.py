"""The registered queries: pipeline stage by stage, oracles, and the guard of the entry module."""

import datetime as dt
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatlens.llm import mix, simhash, toxicity
from chatlens.llm.registry import ORACLE, QUERIES
from test_dedup import expected_text, lines_brute
from test_mix_and_leaks import leaks_brute

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else v.isoformat() if isinstance(v, dt.date) else str(v)
    return sorted("|".join(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, res.fetchall())


def test_all_are_registered():
    assert sorted(QUERIES) == sorted([k for k in QUERIES if k == "pipeline" or k.startswith("op")]) and len(QUERIES) == 14
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline"} == set(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    """Each stage on the rows its predecessor kept, against brute force on the same rows."""
    docs = spark.read.parquet(SF + "/documents.parquet")
    labels, bench = spark.read.parquet(SF + "/labels.parquet"), spark.read.parquet(SF + "/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, SF).cache()
    verdict = {r["doc_id"]: r["rejected"] for r in toxicity.with_toxicity(docs, labels).collect()}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, x in verdict.items() if not x)
    assert clean.columns == docs.columns

    lines = stage["line_dedup"](spark, clean, SF).cache()
    pairs = [(r["doc_id"], r["h"], r["text"]) for r in clean.withColumn("h", F.xxhash64("text")).collect()]
    gone = lines_brute(pairs, 10)
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {d: expected_text(t, gone[d, t]) for d, _, t in pairs}
    assert lines.columns == docs.columns and any(gone.values())

    single = stage["simhash_near_dedup"](spark, lines, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    fp = {d: simhash.fingerprint(t.encode()) for d, t in rows}
    root = {d: d for d in fp}
    for _ in range(len(fp)):
        new = {d: min(root[e] for e in fp if (fp[d] ^ fp[e]).bit_count() <= 2) for d in fp}
        if new == root:
            break
        root = new
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(root.values()))

    pure = stage["benchmark_decontamination"](spark, single, SF).cache()
    kept = [(r["doc_id"], r["text"]) for r in single.collect()]
    leaks = {d for d, _ in leaks_brute(kept, [(r["item_id"], r["text"]) for r in bench.collect()])}
    assert sorted(r["doc_id"] for r in pure.collect()) == sorted(d for d, _ in kept if d not in leaks) and pure.columns == docs.columns

    out = stage["mix_sources"](spark, pure, SF).collect()
    plan = {r["doc_id"]: r["copies"] for r in mix.mix(pure).collect()}
    assert {r["doc_id"]: r["copies"] for r in out} == {d: c for d, c in plan.items() if c > 0}
    texts = {r["doc_id"]: r["text"] for r in pure.collect()}
    assert all(r["text"] == texts[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] for r in out)

    again = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == Counter(tuple(r) for r in out)


def test_entry_module_works_without_the_subpackage(tmp_path):
    """A copy of the library without llm and the pipeline still imports and names its queries."""
    import os
    import shutil
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(repo, "chatlens"), tmp_path / "chatlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'department_report' in q and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
