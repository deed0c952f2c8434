from collections import defaultdict

from strandlake.operators import hotkeys as H

SCHEMA = "record_id bigint, sample_name string, contig_id int, contig_name string, contig_position int, qual double, code int, n bigint"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        name = None if r[3] is None and r[2] is None else {"1": "1", "chrM": "MT", " M ": "MT"}.get(r[3], None) if r[3] is not None else {0: "1", 1: "MT"}.get(r[2])
        groups["contig", name, 0].append(r)
        groups["site", name, r[4]].append(r)
    out = set()
    for (level, name, at), members in groups.items():
        quals = [m[5] for m in members if m[5] is not None]
        out.add((level, name, at, len(members), round(sum(quals) / len(quals), 6) if quals else None, len({m[1] for m in members if m[1] is not None})))
    return out


def test_against_brute_force(spark):
    contigs = spark.createDataFrame([(0, "1", 100), (1, "MT", 100)], "contig_id int, contig_name string, contig_length bigint")
    rows = []
    for i in range(400):
        name = ["1", "1", "chrM", " M ", None, "??"][i % 6]
        rows.append((i, [None, "a", "b", "c"][i * 7 % 4], [0, 1, None][i % 3], name, None if i % 41 == 0 else 5 if i % 3 else i % 50 - 3, None if i % 5 == 0 else float(i % 9), 1, 2))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    for bits, flush, fan, splits in ((2, 7, 1, 900), (20, 1 << 20, 64, None), (16, 20, 2, 40)):
        got = {(r.key_level, r.contig_name, r.contig_position, r.n_rows, None if r.mean_qual is None else round(r.mean_qual, 6), r.n_samples) for r in H.key_statistics(df.repartition(3), contigs, block_bits=bits, flush_rows=flush, fan_in=fan, splits=splits).collect()}
        assert got == brute(rows)


def test_empty(spark):
    contigs = spark.createDataFrame([], "contig_id int, contig_name string, contig_length bigint")
    assert H.key_statistics(spark.createDataFrame([], SCHEMA), contigs).count() == 0
    assert H.hot_keys(spark.createDataFrame([], SCHEMA), contigs).count() == 0


def test_one_key_holds_all(spark):
    contigs = spark.createDataFrame([(0, "1", 100)], "contig_id int, contig_name string, contig_length bigint")
    df = spark.range(5000).selectExpr("id AS record_id", "concat('s', id % 3) AS sample_name", "0 AS contig_id", "'1' AS contig_name", "7 AS contig_position", "1.5D AS qual", "1 AS code", "2L AS n")
    assert [(r.n_rows, r.mean_qual, r.n_samples) for r in H.key_statistics(df, contigs).collect()] == [(5000, 1.5, 3)] * 2
    assert {(r.key_level, r.contig_name, r.contig_position) for r in H.hot_keys(df, contigs).collect()} == {("contig", "1", 0), ("site", "1", 7)}


def test_no_group_of_the_tree_grows_with_splits_or_samples():
    """5,000 splits with 10,000 samples at a few keys: the rows and pairs of the largest group of every round stay bounded."""
    import numpy as np

    splits, fan = 5000, H.FAN_IN
    parts, branches = H.tree_shape(splits, fan)
    assert -(-splits // (parts * branches)) <= fan and branches <= 2 * fan
    assert [H.block_width(x) for x in (1, 64, 65, 1 << 20, 1 << 40)] == [20, 20, 19, 6, 6]
    names = [f"s{i}" for i in range(10_000)]
    rnd = np.random.default_rng(1)
    rounds = defaultdict(lambda: [0, 0])
    for split in range(0, splits, 250):  # blocks of a split depend on its number only by part and branch
        n = 2000
        sample = rnd.integers(0, len(names), n)
        for batch in H.scatter(np.zeros(n, np.int64), rnd.integers(5, 8, n), np.ones(n), sample, names, 16, parts, split, branches):
            for r in batch.to_pylist():
                rounds[r["level"], r["contig"], r["block"], r["part"], split][0] += 1
                rounds[r["level"], r["contig"], r["block"], r["part"], split][1] += len(r["pair_offsets"])
    assert max(x[0] for x in rounds.values()) == 1  # one row of a split for each block and part
    assert max(x[1] for x in rounds.values()) <= 3 * 2000 / parts  # its pairs spread over the parts
    # All pairs there are (three sites and one contig by 10,000 samples) over the parts of a block:
    spread = np.bincount(H._pair_parts(np.repeat([5, 6, 7], len(names)), np.tile(np.arange(len(names)), 3), names, parts), minlength=parts)
    assert spread.max() <= 1.2 * 3 * len(names) / parts
