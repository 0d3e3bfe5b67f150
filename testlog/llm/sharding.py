"""Uniform sharding with exact sizes by a hypergeometric communication matrix
(DataFrame functions only).

Rows are in partitions by a hash of their key.  How many rows of each partition go to
each shard is drawn first: under a uniform shuffle these counts follow a multivariate
hypergeometric law, given the sizes of the partitions and of the shards.  Then every
partition permutes its own rows and deals them out by its line of the matrix, the
rows are exchanged, and every shard permutes what it got.  Shard sizes are exact and
at most one apart; no row is ranked among more than its own partition or bucket.

The matrix has partitions x shards entries and is made by one expression from the
partitions' counts, so rows never pass through the driver.  Every draw is a hash of
seed, partition and shard, so a lost task repeats its work with the same result.

Defined results: keys may be null, rows may repeat (equal rows are interchangeable);
fewer rows than shards leave some shards empty; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testlog.operators.durable import store

SHARDS = 24
LEAST_PARTS = 128
ROWS_PER_PART = 4_000_000
LEAST_BUCKETS = 8
TRIALS = 40  # a draw fails all of them with a chance below 1e-12
SMALL = 16  # up to here a draw sums the probabilities instead
P = "__s_"

# Exact logarithms of factorials; Stirling's series beyond.
_TABLE = "array(" + ", ".join(f"{math.lgamma(n + 1)!r}D" for n in range(SMALL)) + ")"


def _log_factorial(x: str) -> str:
    stirling = (
        f"(({x}) + 0.5D) * ln(({x})) - ({x}) + {0.5 * math.log(2 * math.pi)!r}D + 1.0D / (12.0D * ({x}))"
        f" - 1.0D / (360.0D * power({x}, 3))"
    )
    return f"(CASE WHEN ({x}) < {SMALL} THEN {_TABLE}[CAST({x} AS INT)] ELSE {stirling} END)"


def _let(bindings: dict[str, str], name: str, body: str) -> str:
    """``body`` with ``name`` bound to a struct of values that are computed once."""
    fields = ", ".join(f"'{k}', {v}" for k, v in bindings.items())
    return f"transform(array(named_struct({fields})), {name} -> {body})[0]"


def _uniform(*parts: str) -> str:
    """A number in (0, 1) from a hash of the parts."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / 9007199254740992.0D)"


def hypergeometric(good: str, bad: str, sample: str, *seed: str) -> str:
    """SQL of how many of ``sample`` balls out of good + bad are good.

    Few balls: the probabilities are summed up to a uniform number.  Many: the ratio of
    uniforms with a table mountain hat (Stadlober), first accepted trial.
    """
    lf = _log_factorial
    sides = {
        "g": f"CAST({good} AS DOUBLE)",
        "b": f"CAST({bad} AS DOUBLE)",
        "s": f"CAST({sample} AS DOUBLE)",
    }
    halves = {
        "g": "v.g", "b": "v.b", "s": "v.s", "n": "v.g + v.b",
        "lo": "least(v.g, v.b)", "hi": "greatest(v.g, v.b)", "m": "least(v.s, v.g + v.b - v.s)",
    }
    weight = lambda k: f"({lf(k)} + {lf(f'w.lo - {k}')} + {lf(f'w.m - {k}')} + {lf(f'w.hi - w.m + {k}')})"
    # small case
    norm = f"({lf('w.lo')} + {lf('w.hi')} - {lf('w.n')} + {lf('w.m')} + {lf('w.n - w.m')})"
    u = _uniform(*seed, "0")
    summed = _let(
        {"norm": norm, "u": u},
        "q",
        "aggregate(sequence(CAST(greatest(0D, w.m - w.hi) AS INT), CAST(least(w.m, w.lo) AS INT)), "
        "named_struct('sum', 0.0D, 'k', CAST(-1.0 AS DOUBLE)), "
        f"(a, k) -> IF(a.sum >= q.u, a, named_struct('sum', a.sum + exp(q.norm - {weight('CAST(k AS DOUBLE)')}), "
        "'k', CAST(k AS DOUBLE))), a -> a.k)",
    )
    # large case
    hat = {
        "share": "w.lo / w.n",
        "mode": "floor((w.m + 1.0D) * (w.lo + 1.0D) / (w.n + 2.0D)) * 1.0D",
    }
    spread = {
        "mode": "h.mode",
        "centre": "w.m * h.share + 0.5D",
        "dev": "sqrt((w.n - w.m) * w.m * h.share * (1.0D - h.share) / (w.n - 1.0D) + 0.5D)",
    }
    trial = _let(
        {"x": _uniform(*seed, "i", "1"), "y": _uniform(*seed, "i", "2")},
        "t",
        _let(
            {"x": "t.x", "z": "z0.centre + (1.7155277699214135D * z0.dev + 0.8989161620588988D) * (t.y - 0.5D) / t.x"},
            "c",
            "CASE WHEN c.z >= 0 AND c.z < least(least(w.m, w.lo) + 1.0D, floor(z0.centre + 16.0D * z0.dev) * 1.0D) "
            f"THEN CASE WHEN 2.0D * ln(c.x) <= z1.top - {weight('(floor(c.z) * 1.0D)')} THEN floor(c.z) * 1.0D END END",
        ),
    )
    ratio = _let(
        hat,
        "h",
        _let(
            spread,
            "z0",
            _let(
                {"top": weight("z0.mode")},
                "z1",
                f"coalesce(filter(transform(sequence(1, {TRIALS}), i -> {trial}), x -> x IS NOT NULL)[0], z0.mode)",
            ),
        ),
    )
    # what was drawn is the part of the smaller colour in the smaller sample
    drawn = f"IF(least(w.m, w.lo) <= {SMALL}, {summed}, {ratio})"
    turned = _let(
        {"z": drawn},
        "d",
        "CASE WHEN w.m < w.s THEN w.g - IF(w.g > w.b, w.m - d.z, d.z) ELSE IF(w.g > w.b, w.m - d.z, d.z) END",
    )
    full = _let(sides, "v", _let(halves, "w", turned))
    return (
        f"(CASE WHEN ({sample}) <= 0 OR ({good}) <= 0 THEN 0L WHEN ({bad}) <= 0 THEN ({sample}) "
        f"WHEN ({sample}) >= ({good}) + ({bad}) THEN ({good}) ELSE CAST({full} AS BIGINT) END)"
    )


def communication_matrix(counts: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(part, ends) from counts(part, n): ``ends[j]`` rows of the part go to shards 0 to j."""
    gathered = counts.agg(
        F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )
    sizes = f"transform(sequence(0, {shards - 1}), j -> total DIV {shards} + IF(j < total % {shards}, 1L, 0L))"
    draw = hypergeometric("e.room[j]", "b.pool - e.room[j]", "b.need", str(seed), "p.part", "j")
    one_part = (
        f"aggregate(sequence(0, {shards - 1}), "
        "named_struct('need', p.n, 'pool', e.pool, 'got', CAST(array() AS ARRAY<BIGINT>)), "
        f"(b, j) -> {_let({'x': draw}, 'o', '''named_struct('need', b.need - o.x, 'pool', b.pool - e.room[j], 'got', concat(b.got, array(o.x)))''')}, "
        "b -> b.got)"
    )
    step = _let(
        {"got": one_part},
        "r",
        "named_struct('room', zip_with(e.room, r.got, (a, c) -> a - c), 'pool', e.pool - p.n, "
        "'lines', concat(e.lines, array(named_struct('part', p.part, 'got', r.got))))",
    )
    lines = (
        f"aggregate(parts, named_struct('room', {sizes}, 'pool', total, "
        "'lines', CAST(array() AS ARRAY<STRUCT<part: BIGINT, got: ARRAY<BIGINT>>>)), "
        f"(e, p) -> {step}, e -> e.lines)"
    )
    return (
        gathered.select(F.expr(lines).alias("lines"))
        .select(F.explode("lines").alias("line"))
        .select("line.part", F.col("line.got").alias("got"))
        .select(
            "part",
            F.expr("transform(got, (x, i) -> aggregate(slice(got, 1, i + 1), 0L, (a, c) -> a + c))").alias("ends"),
        )
    )


def shard_rows(rows: DataFrame, key: list[str], shards: int = SHARDS, seed: int = 20240917) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to all rows."""
    total = rows.count()
    parts = max(LEAST_PARTS, -(-total // ROWS_PER_PART))
    buckets = max(LEAST_BUCKETS, -(-total // (shards * ROWS_PER_PART)))
    names = [c for c in rows.columns if c not in ("shard", "slot")]

    def hashed(salt: int) -> Column:
        return F.xxhash64(*key, F.lit(seed), F.lit(salt))

    placed = rows.select(*names, F.pmod(hashed(1), F.lit(parts)).cast("long").alias(P + "part"))
    counts = placed.groupBy(F.col(P + "part").alias("part")).agg(F.count("*").alias("n"))
    matrix = store(communication_matrix(counts, shards, seed))
    local = Window.partitionBy(P + "part").orderBy(hashed(2), *key)
    dealt = store(
        placed.withColumn(P + "rank", F.row_number().over(local).cast("long"))
        .join(matrix.select(F.col("part").alias(P + "part"), F.col("ends").alias(P + "ends")), P + "part")
        .select(
            *names,
            F.expr(f"CAST(size(filter({P}ends, x -> x < {P}rank)) AS INT)").alias("shard"),
            F.pmod(hashed(3), F.lit(buckets)).cast("int").alias(P + "bucket"),
        )
    )
    # the second permutation: by bucket of a hash, then by another hash within the bucket
    sizes = dealt.groupBy("shard", P + "bucket").agg(F.count("*").alias(P + "n"))
    before = Window.partitionBy("shard").orderBy(P + "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(
        sizes.select("shard", P + "bucket", F.coalesce(F.sum(P + "n").over(before), F.lit(0)).alias(P + "first"))
    )
    inner = Window.partitionBy("shard", P + "bucket").orderBy(hashed(4), *key)
    return (
        dealt.withColumn(P + "rank", F.row_number().over(inner))
        .join(offsets, ["shard", P + "bucket"])
        .select(*names, "shard", (F.col(P + "first") + F.col(P + "rank") - 1).cast("long").alias("slot"))
    )
