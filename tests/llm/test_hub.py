"""A hub's join: minima are written before they are joined, so that Spark can split it."""

from angleweave.llm import common, graph, simhash


def test_star_is_split(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = common.stored(spark.range(1, 400_000).selectExpr("0L AS u", "xxhash64(id) AS v").repartition(8), "star")
        joined, _ = graph._with_least(star)
        rows = joined.selectExpr("bit_xor(v) AS x", "count(*) AS n")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().toString()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_with_and_without_broadcasts(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(200, 260)] + [(300, 300), (301, 302)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = sorted(map(tuple, graph.components(df, "a", "b").collect()))
    for m in (graph, common):
        monkeypatch.setattr(m, "broadcast_if_small", lambda d, n: d)
    assert sorted(map(tuple, graph.components(df, "a", "b").collect())) == few
    assert {c for n, c in few if n <= 40} == {0} and {c for n, c in few if 200 <= n < 260} == {100} and dict(few)[302] == 301


def test_pivot_rounds_merge_components(spark, monkeypatch):
    """A key that holds many components is met by several pivots; the result is that of all pairs."""
    import random

    rng = random.Random(8)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (rng.getrandbits(16) << 40) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})
    monkeypatch.setattr(simhash, "PAIRS_A_ROW", 0)
    found = dict(map(tuple, simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()))
    top = {f: f for f in fps}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert {f: found.get(f, f) for f in fps} == {f: find(f) for f in fps}
