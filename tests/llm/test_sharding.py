import math

from pyspark.sql import functions as F

from testlog.llm import sharding as sh


def test_draws_follow_the_law(spark):
    n = 3000
    for good, bad, sample in ((5, 7, 4), (300, 200, 150), (70, 3000, 900), (100000, 2000000, 50000), (900, 100, 990)):
        expr = sh.hypergeometric(f"{good}L", f"{bad}L", f"{sample}L", "7", "id")
        row = spark.range(n).select(F.expr(expr).alias("x")).agg(
            F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")
        ).first()
        total = good + bad
        mean = sample * good / total
        variance = mean * (bad / total) * (total - sample) / (total - 1)
        assert abs(row[0] - mean) < 4.5 * math.sqrt(variance / n)
        assert 0.85 * variance < row[1] < 1.15 * variance
        assert max(0, sample - bad) <= row[2] and row[3] <= min(good, sample)


def test_matrix_has_exact_margins(spark):
    counts = [(p, (p * 37) % 101 + 1) for p in range(40)]
    total = sum(n for _, n in counts)
    out = sh.communication_matrix(spark.createDataFrame(counts, "part long, n long"), 7, 3).collect()
    lines = {r.part: [b - a for a, b in zip([0, *r.ends], r.ends)] for r in out}
    assert {p: sum(v) for p, v in lines.items()} == dict(counts)
    columns = [sum(v[j] for v in lines.values()) for j in range(7)]
    assert columns == [total // 7 + (j < total % 7) for j in range(7)]


def test_sizes_slots_and_repeatability(spark):
    rows = spark.range(5003).selectExpr("id AS doc_id", "id % 3 AS shard", "IF(id % 5 = 0, NULL, id) AS key")
    rows = rows.unionByName(rows.filter("doc_id < 50"))  # repeated rows
    out = sh.shard_rows(rows, ["doc_id", "key"], 24).collect()
    assert len(out) == 5053
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sh.shard_rows(rows.repartition(7), ["doc_id", "key"], 24).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in out) == sorted((r.doc_id, r.shard, r.slot) for r in again)
    other = sh.shard_rows(rows, ["doc_id", "key"], 24, seed=1).collect()
    assert sorted((r.doc_id, r.shard) for r in out) != sorted((r.doc_id, r.shard) for r in other)


def test_few_and_no_rows(spark):
    few = sh.shard_rows(spark.range(5).selectExpr("id AS doc_id"), ["doc_id"]).collect()
    assert len(few) == 5 and len({r.shard for r in few}) == 5 and {r.slot for r in few} == {0}
    assert sh.shard_rows(spark.range(0).selectExpr("id AS doc_id"), ["doc_id"]).count() == 0
