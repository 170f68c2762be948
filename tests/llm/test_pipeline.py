import hashlib
import importlib.util
import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from test_llm_operators import SF, brute_components, brute_cut, brute_quality, least_distance, prose

import corpus_pipeline
from lectern.llm import decontaminate, mixing, quality_rules, simhash
from lectern.llm.common import materialize, sweep


def brute_mix(rows):
    n = Counter(r[3] for r in rows)
    w = {s: k**mixing.ALPHA for s, k in n.items()}
    out = set()
    for r in rows:
        rate = w[r[3]] / sum(w.values()) * len(rows) / n[r[3]]
        assert rate < mixing.MOST_RATE
        u = (int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c < u:
            k += 1
            p *= rate / k
            c += p
        out |= {(r[0], r[1], j) for j in range(1, k + 1)}
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    docs = [d for d, k in zip(docs, brute_quality(docs), strict=True) if k]
    low = brute_components([(d[0], simhash.fingerprint(d[1])) for d in docs])
    docs = [d for d, k in zip(docs, low, strict=True) if d[0] == k]
    docs = [(d[0], kept.decode("utf-8", "ignore"), *d[2:]) for d, (kept, _, _) in zip(docs, brute_cut([d[1] for d in docs]), strict=True)]
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = decontaminate.Matcher(list(enumerate(items)))
    clean = [d for d in docs if not any(x in decontaminate.normalise(d[1]) for x in items) and not whole.matches(d[1])]
    for d in clean[:3]:  # the matcher itself is tested against the full dynamic programme; here a few whole documents
        assert all(least_distance(x, decontaminate.normalise(d[1])[:1500]) > int(decontaminate.RATE * len(x)) for x in items[:5])
    got = corpus_pipeline.run(spark, SF)
    rows = got.collect()
    assert {(r.doc_id, r.text, r.replica) for r in rows} == brute_mix(clean) and len(rows) > 20
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "poisson_mixing"]


def test_stages_decide_by_row(spark, tmp_path):
    """Repeated rows and null ids: one row of each component stays, and a rejected row takes no other with it."""
    a, b, c, short = prose(1, 120), prose(2, 120), prose(3, 120), "too short"
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    texts = lambda module, rows: Counter((r.doc_id, r.text) for r in module.stage(spark, make([(i, t, "en", "s") for i, t in rows]), str(tmp_path)).collect())
    assert texts(simhash, [(1, a), (1, a), (None, a), (2, a), (None, b), (None, b), (3, c)]) == Counter([(1, a), (None, b), (3, c)])
    assert texts(quality_rules, [(1, a), (1, short), (None, b), (None, short)]) == Counter([(1, a), (None, b)])
    spark.createDataFrame([(1, c[100:300])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert texts(decontaminate, [(1, a), (1, c), (None, b), (None, c)]) == Counter([(1, a), (None, b)])


def test_pipeline_keeps_a_repeated_text(spark, tmp_path):
    a = prose(1, 120)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (None, a, "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(7, 40))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(1, a)]


def pieces(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_written_pieces_stay_as_long_as_a_plan_reads_them(spark):
    before = pieces(spark) if os.path.isdir(spark.conf.get("spark.checkpoint.dir")) else set()
    piece = materialize(spark.range(50).selectExpr("id", "struct(id AS x, 'a' AS y) AS s"), "piece")
    later = piece.select("s.x").repartition(3).groupBy("x").count()
    del piece
    sweep(spark)
    assert later.count() == 50 and len(pieces(spark) - before) == 1
    later = later.join(later.withColumnRenamed("count", "n"), "x").cache()
    sweep(spark)
    assert later.count() == 50 and len(pieces(spark) - before) == 1
    later.unpersist()
    del later
    sweep(spark)
    assert not pieces(spark) - before


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_delete_what_earlier_ones_left(spark):
    sweep(spark)
    before = pieces(spark) if os.path.isdir(spark.conf.get("spark.checkpoint.dir")) else set()
    out = corpus_pipeline.run(spark, SF)
    assert {x.rsplit("-", 1)[0] for x in pieces(spark) - before} == {"pipeline-benchmark_decontamination", "op8-rates"}
    assert out.count() > 0


SWEPT = """
import os, re, sys
from pyspark.sql import SparkSession
from lectern.llm.common import sweep

spark = SparkSession.builder.master("local-cluster[1,2,1600]").config("spark.executor.memory", "1200m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def held(_):
    jvm = re.search(r"PPid:\\s+(\\d+)", open(f"/proc/{os.getppid()}/status").read())[1]
    yield sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open(f"/proc/{jvm}/smaps_rollup").read()))) / 1024

rows = lambda: spark.sparkContext.parallelize([0], 1).mapPartitions(held).first()
spark.range(0, 4_000_000, 1, 2).selectExpr("id % 2 AS k", "uuid() AS u").groupBy("k").agg({"u": "collect_list"}).selectExpr("size(`collect_list(u)`)").collect()
before = rows()
sweep(spark)
print("held", before, rows())
"""


def test_executors_give_memory_back_between_stages(tmp_path):
    (tmp_path / "home" / "work").mkdir(parents=True)  # executors write their logs there
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    repo = str(Path(__file__).parents[2])
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    said = subprocess.run([sys.executable, "-c", SWEPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    before, after = map(float, next(x for x in said.stdout.splitlines() if x.startswith("held ")).split()[1:])
    assert after < before - 200, (before, after)
