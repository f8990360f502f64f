import random

import pytest
from conftest import ROWS
from pyspark.sql import functions as F

from nearfield.llm import sharding as S


def sizes(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r.n_bytes)
    return out


@pytest.mark.parametrize("limit", [1, 60, 700, 10**9])
def test_limits_and_minimal_splits(spark, limit):
    docs = spark.createDataFrame([(1, "a" * 50)] * 40 + [(i, "b" * i) for i in range(30)] + [(None, None), (None, "x"), (77, "z" * 500)], "doc_id INT, text STRING")
    rows = S.assign(docs, limit).collect()
    shards = sizes(rows)
    assert len(rows) == docs.count()
    for shard, held in shards.items():
        assert sum(held) <= limit or len(held) == 1
        assert not any(other != shard and other.startswith(shard) for other in shards)
    for shard in shards:  # its parent was too large
        if shard:
            parent = [b for s, held in shards.items() if s.startswith(shard[:-1]) for b in held]
            assert sum(parent) > limit and len(parent) > 1
    assert all(r.depth == len(r.shard) and r.shard_bytes == sum(shards[r.shard]) for r in rows)


def test_messy_rows_and_files(spark, messy, nothing, tmp_path):
    assert S.assign(messy).count() == len(ROWS) and S.assign(nothing).count() == 0
    S.write_shards(messy, str(tmp_path / "shards"), 200)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(ROWS)
    held = back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n"))
    assert held.where("b > 200 AND n > 1").count() == 0


def test_files_of_an_input_that_never_lies_the_same(spark, tmp_path):
    anywhere = F.udf(lambda: random.randrange(1000), "int").asNondeterministic()
    docs = spark.createDataFrame([(1, "x" * (i % 90)) for i in range(600)], "doc_id INT, text STRING").repartition(6, anywhere())
    S.write_shards(docs, str(tmp_path / "shards"), 200)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(len(r.text) for r in back.collect()) == sorted(i % 90 for i in range(600))
    held = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
    assert held.where("b > 200 AND n > 1").count() == 0
