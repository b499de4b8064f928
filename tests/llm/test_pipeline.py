"""The pipeline's stages on their own inputs."""

import corpus_pipeline as cp
from tests.llm.test_near_copies import brute_groups
from vellum.llm import decontaminate

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_dedup", "decontaminate", "mixing", "hilbert_shards"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(columns)] == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
    assert len(toxic & set(kept["toxicity"])) <= 0.2 * len(toxic) and len(clean - set(kept["toxicity"])) <= 0.02 * len(clean)
    rows = spark.read.parquet(str(tmp_path / "toxicity")).select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(kept["simhash_dedup"]) == sorted(rows[i].doc_id for i in set(brute_groups([r.text for r in rows])))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.decontaminate(spark.read.parquet(str(tmp_path / "simhash_dedup")), items).where("n_items > 0").collect()}
    assert set(kept["decontaminate"]) == set(kept["simhash_dedup"]) - hit
    assert len(set(kept["mixing"]) & clean) >= 0.9 * len(set(kept["decontaminate"]) & clean)
    assert sorted(kept["hilbert_shards"]) == sorted(kept["mixing"])
    sizes = [r["count"] for r in docs.groupBy("shard_id").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_entry_works_without_the_training_data_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(cp.__file__).parent
    shutil.copytree(repo / "vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, ops, pipeline, sql = out.stdout.split()
    assert int(n) > 50 and ops == "False" and pipeline == "False" and int(sql) > 40
