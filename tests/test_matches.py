import random

from pyspark.sql import functions as F

from fieldloom.functions import pose as P
from fieldloom.operators import matches as ops


def _fold(rows, deleted):
    """The merge as a fold over the matches in their order."""
    pairs = {}
    for step, ref, cur, approximate, weight, ids in sorted(rows):
        key = (ref, cur)
        if key in deleted:
            continue
        old = pairs.get(key)
        if old and not old["approximate"] and approximate:
            continue
        cells = {} if old is None or (old["approximate"] and not approximate) else dict(old["cells"])
        cells.update({i: step for i in ids})
        pairs[key] = {"approximate": approximate, "step": step, "weight": max(old["weight"] if old else 0, weight), "cells": cells}
    return pairs


def test_merge_equals_the_fold(spark):
    rng = random.Random(5)
    rows = [(s, r := rng.randrange(4), r + 1 + rng.randrange(2), rng.random() < 0.5, float(rng.randrange(1, 9)), [f"c{rng.randrange(4)}" for _ in range(rng.randrange(4))]) for s in range(80)]
    deleted = {(0, 1)}
    schema = "step long, reference long, current long, approximate boolean, weight double, ids array<string>"
    df = spark.createDataFrame(rows, schema).withColumns({
        "measurement": P.pose(F.col("step").cast("double"), F.lit(0.0), F.lit(0.0)), "cells": F.transform("ids", lambda i: F.struct(i.alias("id"), F.col("step").alias("from_step"))),
    })
    pairs, cells = ops.merged(df, spark.createDataFrame(list(deleted), "reference long, current long"), ["reference", "current"], keep_strength=True)
    want = _fold(rows, deleted)
    assert {(r.reference, r.current): (r.approximate, r.step, r.weight) for r in pairs.collect()} == {k: (v["approximate"], v["step"], v["weight"]) for k, v in want.items()}
    assert {(r.reference, r.current, r.id): r.cell.from_step for r in cells.collect()} == {(*k, i): s for k, v in want.items() for i, s in v["cells"].items()}


def test_orientation_swaps_ends_and_inverts(spark):
    point = "struct<x:double,y:double>"
    schema = f"reference long, current long, measurement struct<x:double,y:double,rotation:double>, cells array<struct<reference:{point},current:{point},psr:double,support:int>>"
    rows = [(5, 2, (3.0, 0.0, 0.0), [((8.0, 0.0), (16.0, 0.0), 10.0, 1), ((1.0, 1.0), None, 3.0, 1), None]), (2, 5, (3.0, 0.0, 0.0), [((8.0, 0.0), (16.0, 0.0), None, 1)]), (1, 3, None, None)]
    got = {(r.measurement and r.measurement.x, r.cells and tuple((c.id, c.quality) for c in r.cells)) for r in ops.oriented(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(-3.0, (("2:0:1:0", 0.5),)), (3.0, (("1:0:2:0", 1.0),)), (None, None)}


def test_acceptance_without_a_second_method(spark):
    region = "struct<score:double,support:int,distance:double>"
    schema = f"kind string, gap int, corr double, f double, b double, support int, cycle double, regions array<{region}>"
    good = [(0.995, 600, 2.0)] * 4
    rows = [("temporal", 3, 5.0, 0.9996, 0.9996, 2000, 0.5, None), ("temporal", 60, 50.0, 0.995, 0.995, 2000, 1.5, good), ("temporal", 60, 50.0, 0.995, 0.995, 2000, 1.5, good[:3]), ("spatial", 3, 5.0, 1.0, 1.0, 2000, 0.5, good),
            ("temporal", 3, 5.0, 0.9996, 0.9996, 1000, 0.5, good), ("temporal", 3, None, 0.9996, 0.9996, 2000, 0.5, good), ("temporal", 3, 5.0, 0.9996, 0.9996, None, 0.5, good)]
    df = spark.createDataFrame(rows, schema)
    got = [r.m for r in df.select(ops.gpu_method(*[F.col(c) for c in ("kind", "gap", "corr", "f", "b", "support", "cycle", "regions")]).alias("m")).collect()]
    assert got == ["near-duplicate", "independent-regions", None, None, None, None, None]


def test_empty_network(spark):
    none = spark.createDataFrame([], "step long, reference long, current long, approximate boolean, weight double, measurement struct<x:double,y:double,rotation:double>, cells array<struct<id:string>>")
    pairs, cells = ops.merged(none, none.select("reference", "current"), ["reference", "current"])
    assert pairs.count() == 0 and cells.count() == 0
