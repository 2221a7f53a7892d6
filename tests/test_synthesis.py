import pytest
from pyspark.sql import functions as F

from spanloom.operators import synthesis as G


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("cls"))
    a = {r.id: r.split for r in G.stratified_split(df, 0.2, 1, "cls", "id", F.col("id") < 10).collect()}
    b = {r.id: r.split for r in G.stratified_split(df.repartition(9), 0.2, 1, "cls", "id", F.col("id") < 10).collect()}
    assert a == b and len(a) == 1000
    assert all(a[k] == "holdout" for k in range(10))
    for c in range(3):
        own = [a[k] for k in range(10, 1000) if k % 3 == c]
        assert own.count("val") == round(len(own) * 0.2)


def test_placed_events_keep_their_gap(spark):
    got = {}
    for r in G.place_events(G.synthetic_ids(spark, 100), 480, 40, 10, 6, 32, 9).collect():
        got.setdefault(r.number, []).append((r.st, r.en))
    assert 60 < len(got) < 95
    for spans in got.values():
        spans.sort()
        assert spans[0][0] >= 0 and spans[-1][1] <= 480
        assert all(b[0] - a[1] >= 10 for a, b in zip(spans, spans[1:]))


def test_tiling_fills_exactly(spark):
    donors = spark.createDataFrame([(0, 7), (1, 30)], "donor bigint, n bigint")
    rows = G.tile_background(G.synthetic_ids(spark, 20), donors, 100, 20, 1).groupBy("number").agg(F.sum(F.col("en") - F.col("st")).alias("n"), F.min("st").alias("a"), F.max("en").alias("b")).collect()
    assert all((r.n, r.a, r.b) == (100, 0, 100) for r in rows) and len(rows) == 20


@pytest.mark.parametrize("n", [1, 2, 9])
def test_crop_keeps_half(spark, n):
    df = spark.range(50).select(F.col("id").alias("video_id"), F.lit(n).cast("bigint").alias("n"))
    assert all(r.en - r.st == -(-n // 2) and 0 <= r.st and r.en <= n for r in G.clip_crop(df, 0.5, 1).collect())


def test_crops_and_scenes(spark):
    """Crops lie in their donors and their videos, cover all places, and about a quarter of the events keep their scene."""
    events = spark.range(4000).select(F.col("id").alias("number"), F.lit(1).alias("k"), (F.col("id") % 3).alias("cls"), (F.col("id") % 50).alias("st"), F.lit(60).alias("frames"))
    donors = spark.createDataFrame([(0, 10, 5), (0, 11, 100), (1, 12, 30)], "cls bigint, donor bigint, n bigint")
    rows = G.donor_crops(events, donors, 30, 2).collect()
    assert {r.cls for r in rows} == {0, 1} and len(rows) == sum(k % 3 < 2 for k in range(4000))
    size = {10: 5, 11: 100, 12: 30}
    for r in rows:
        assert 0 <= r.left <= size[r.donor] - min(30, size[r.donor]) and r.en == min(60, r.st + min(30, size[r.donor]))
    assert {r.left for r in rows if r.donor == 11} == set(range(71))
    same = sum(r.same_scene for r in rows)
    assert abs(same - len(rows) / 4) < 4 * (len(rows) * 3 / 16) ** 0.5


def test_splice(spark):
    frames = spark.createDataFrame([(v, i, [float(v), float(i)]) for v in (1, 2) for i in range(10)], "number bigint, i bigint, emb array<double>")
    donor = spark.createDataFrame([(7, i, [70.0, float(i)]) for i in range(20)], "donor bigint, i bigint, emb array<double>")
    events = spark.createDataFrame([(1, 3, 2, 6, 7, 11, False), (2, 4, 0, 3, 7, 5, True)], "number bigint, cls bigint, st bigint, en bigint, donor bigint, left bigint, same_scene boolean")
    got = {(r.number, r.i): r for r in G.splice(frames, events, donor).collect()}
    assert len(got) == 20
    for (v, i), r in got.items():
        inside = (2 <= i < 6) if v == 1 else i < 3
        assert list(r.emb) == ([70.0, 11.0 + i - 2] if v == 1 and inside else [float(v), float(i)])
        assert r.label == ((3 if v == 1 else 4) if inside else 11) and r.edge == float((v, i) in {(1, 2), (1, 5), (2, 0), (2, 2)})
