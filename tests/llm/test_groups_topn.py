import random

from pyspark.sql import functions as F

from fieldloom.llm import groups, topn


def _brute(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in pairs:
        if None in (s, a, b) or a == b:
            continue
        x, y = sorted((root((s, a)), root((s, b))))
        parent[y] = x
    return {(s, root((s, m))[1], m) for s, m in parent}


def _groups(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "v bigint, a bigint, b bigint").withColumns({"lo": F.lit("x"), "hi": F.lit(1)})
    return {tuple(r) for r in groups.link_groups(df, "a", "b", ["v"], **kw).collect()}


def test_groups_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(2), rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(5, i, i + 1) for i in range(40)]
    pairs += [(None, 1, 2), (1, None, 2), (1, 3, None), (1, 7, 7), (5, 1, 0), (5, 0, 1)] + [(6, 100, i) for i in range(30)]
    assert _groups(spark, pairs) == _brute(pairs)
    assert _groups(spark, pairs, max_rounds=40) == _brute(pairs)


def test_groups_of_nothing(spark):
    assert _groups(spark, []) == set()
    assert _groups(spark, [(1, 2, 2), (1, None, 3)]) == set()


def test_frame_groups_need_records(spark):
    schema = "video_id bigint, frame bigint, incremental_match struct<frame: bigint, accepted: boolean>"
    rows = [(1, 1, None), (1, 2, (1, True)), (1, 2, (1, True)), (1, 5, (99, True)), (1, 6, (None, True)), (1, 7, (2, False)), (1, 8, (2, None)), (2, 1, (1, True)), (2, 2, (1, True))]
    found = {tuple(r) for r in groups.frame_groups(spark.createDataFrame(rows, schema)).collect()}
    assert found == {(1, 1, 1), (1, 1, 2), (2, 1, 1), (2, 1, 2)}


def test_top_n_ties_nulls_repeats_and_clashing_names(spark):
    nan = float("nan")
    rows = [("a", 1.0, 3), ("a", 1.0, 2), ("a", nan, 1), ("a", None, 0), ("a", 0.5, 9), ("a", 1.0, 2), (None, 7.0, 1), ("b", None, None), ("b", None, 4)]
    df = spark.createDataFrame(rows, "g string, score double, item bigint").withColumns({"__salt": F.lit("s"), "__place": F.lit("p"), "__rank": F.lit(0)})
    got = topn.top_n_per_group(df, ["g"], "score", "item", 3, salts=4, rank="nth")
    out = {(r.g, r["nth"]): (r.item, r["__salt"]) for r in got.collect()}
    assert {k: v[0] for k, v in out.items()} == {("a", 1): 2, ("a", 2): 2, ("a", 3): 3, (None, 1): 1, ("b", 1): 4, ("b", 2): None}
    assert all(v[1] == "s" for v in out.values())
    assert topn.top_n_per_group(df.limit(0), ["g"], "score", "item", 2).count() == 0
    unknown = topn.top_n_per_group(df.where("g = 'a'"), ["g"], "score", "item", 6, salts=2, rank="nth").where("nth > 4").orderBy("nth").collect()
    assert [r.item for r in unknown] == [0, 1]  # after 0.5; unknown and NaN scores are equal


def test_top_frames_fold_copies(spark):
    schema = "video_id bigint, cell_col bigint, cell_row bigint, frame bigint, sharpness double"
    inf = float("inf")
    rows = [(1, 0, 0, 1, 5.0), (1, 0, 0, 1, 9.0), (1, 0, 0, 2, inf), (1, 0, 0, 3, -1.0), (1, 0, 0, 4, 9.0), (1, 0, 0, 5, None), (1, None, 0, 6, 99.0), (1, 0, 1, 7, float("nan"))]
    found = [tuple(r) for r in topn.top_frames_per_cell(spark.createDataFrame(rows, schema), 4, 3).orderBy("cell_row", "place").select("cell_row", "frame").collect()]
    assert found == [(0, 1), (0, 4), (0, 2), (0, 3), (1, 7)]
