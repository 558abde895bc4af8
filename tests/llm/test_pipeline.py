"""The stages one after another on the small tables, each held against what it must have done."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import decontaminate, mixing, queries, simhash
from tests.llm.brute import LOWER, WORD, raw

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    sets = [docs]
    for _, stage in corpus_pipeline.STAGES:
        sets.append(stage(spark, sets[-1], SF).persist())
    assert all(s.columns == docs.columns for s in sets[:-1]) and sets[-1].columns == [*docs.columns, "shard", "slot"]
    good, single, clean, mixed, sharded = sets[1:]
    assert 0 < single.count() <= good.count() <= docs.count()
    assert simhash.classes(single).groupBy("component_id").count().where("count > 1").count() == 0
    assert decontaminate.digest(clean, benchmark).where("contaminated").count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= mixing.EPOCHS
    assert sharded.count() == mixed.count()
    assert sharded.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_stages_take_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_all_queries_are_there():
    assert {q.split("_")[0] for q in queries.QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for base in range(30):
        words = [rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 8) for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(5):
            own = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 30))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(None, rows[0][1]), (900, "one two"), (901, "One  TWO"), (902, "one two three"), (903, None), (904, " ")]
    rng.shuffle(rows)
    words = [WORD.findall(raw(t).translate(LOWER)) for _, t in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    label = {(r.doc_id, r.text): r.fingerprint for r in simhash.with_fingerprint(df).collect()}
    prints = [label[r] & (2**64 - 1) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    alone = 0
    for i in range(len(rows)):
        for j in range(i):
            similar = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and sets[i]
            alone += bool(similar and (prints[i] ^ prints[j]).bit_count() > 2)
            if similar or (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    assert alone > 20
    least = {}
    for i, (name, text) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0, "")), (name is None, name or 0, text or ""))
    kept = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted(least.values())
