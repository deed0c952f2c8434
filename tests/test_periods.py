import random

from strandlake.operators import intervals as I
from strandlake.operators import periods as P


def brute(rows):
    by = {}
    for k, a, b in rows:
        if a is not None and b is not None and b >= a:
            by.setdefault(k, []).append((a, b))
    out = []
    for k, spans in by.items():
        spans.sort()
        done = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= done[-1][1] + 1:
                done[-1][1] = max(done[-1][1], b)
            else:
                done.append([a, b])
        out += [(k, "period", a, b) for a, b in done]
        out += [(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(done, done[1:], strict=False)]
    return sorted(out, key=str)


def run(spark, rows, stretch):
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint").selectExpr("k", "a", "b", "1 AS piece", "2 AS _from", "3 AS from_position")
    got = P.covered_periods(df, ["k"], "a", "b", stretch).collect()
    return sorted(((r.k, r.piece, r.from_position, r.to_position) for r in got), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        a = rnd.randint(-50, 400)
        rows.append((rnd.choice(["x", "y", None]), a, a + rnd.choice([-1, 0, 0, 1, 2, 5, 40, 150])))
    rows += [("z", None, 5), ("z", 5, None), ("n", 1, 100), ("n", 20, 30), ("n", 101, 101), ("n", 103, 10**15), ("n", 105, 9 * 10**18), ("n", 2000, 2001), ("r", 5, 5), ("r", 5, 5)]
    for stretch in (7, 64, 1 << 20):
        assert run(spark, rows, stretch) == brute(rows)


def test_empty(spark):
    assert run(spark, [("x", None, None)], 16) == []


def test_gvcf_end(spark):
    infos = [("END=20", 20), ("CIEND=30;DP=2", 12), ("DPEND=9;END=15", 15), ("END=9", 12), ("END=.", 12), ("END=", 12), ("end=50", 12), (None, 12), ("END=1e3", 12), ("A=1;END=10", 10)]
    df = spark.createDataFrame([(i, x, 10, "ACG") for i, (x, _) in enumerate(infos)], "i int, info string, contig_position int, ref_allele string")
    assert [r.e for r in df.orderBy("i").select(P.gvcf_end().alias("e")).collect()] == [e for _, e in infos]


def test_set_operations_against_positions(spark):
    rnd = random.Random(3)

    def spans(n):
        return [("k", a, a + rnd.randint(0, 9)) for a in (rnd.randint(1, 300) for _ in range(n))]

    def cover(rows):
        return {p for _, a, b in rows for p in range(a, b + 1)}

    x, y = spans(25), spans(25)
    schema = "k string, a bigint, b bigint"
    a, b = (I.merged(spark.createDataFrame(s, schema), ["k"], "a", "b") for s in (x, y))

    def got(df):
        return {p for r in df.collect() for p in range(r.from_position, r.to_position + 1)}

    assert got(I.intersected(a, b, ["k"])) == cover(x) & cover(y)
    assert got(I.subtracted(a, b, ["k"])) == cover(x) - cover(y)
    none = b.where("false")
    assert got(I.subtracted(a, none, ["k"])) == cover(x)
    depth = {}
    for _, s, e in x:
        for p in range(s, e + 1):
            depth[p] = depth.get(p, 0) + 1
    runs = I.depth_runs(spark.createDataFrame(x, schema), ["k"], "a", "b", stretch=16).collect()
    assert {p: r.depth for r in runs for p in range(r.from_position, r.to_position + 1)} == depth
    for width in (4, 1 << 16):
        pairs = I.range_join(spark.createDataFrame(x, schema), spark.createDataFrame(y, "k string, c bigint, d bigint"), ["k"], "a", "b", "c", "d", width=width).count()
        assert pairs == sum(s <= f and e <= t for _, s, t in x for _, e, f in y)
