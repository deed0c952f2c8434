import random
from collections import Counter, defaultdict

from conftest import SMALL
from oracle import connect, differences

from strandlake.llm import queries, survivors, terms

COV = "cov_id bigint, cov_values array<string>, term string, records bigint"


def test_oracles(spark):
    duck = connect(SMALL)
    for name, sql in queries.ORACLES.items():
        _, ours, theirs = differences(queries.QUERIES[name](spark, SMALL), duck, sql)
        assert not ours and not theirs, (name, ours, theirs)


def counted(rows):
    out = {}
    for _, values, *_ in rows:
        items = [v for v in values or [] if v]
        for t, n in Counter(items).items():
            a, b = out.get(t, (0, 0))
            out[t] = (a + n, b + 1)
    return out


def state(counts):
    return {r.term: (r.occurrences, r.records) for r in counts.counts().collect()}


def test_counts_follow_changes(spark):
    rnd = random.Random(2)

    def row(i):
        return (i, rnd.choice([None, [], [rnd.choice(["a", "b", "B", " a", "", None, "zz"]) for _ in range(rnd.randint(1, 6))]]), "clash", 1)

    before = [row(i) for i in range(60)]
    after = [row(i) if i % 7 == 0 else before[i] for i in range(5, 60)] + [row(i) for i in range(100, 110)]
    a, b = spark.createDataFrame(before, COV), spark.createDataFrame(after, COV)
    store = terms.TermCounts(spark, buckets=3)
    store.apply(terms.list_deltas(a, "f", "cov_values"))
    assert state(store) == counted(before) | {None: (0, len(before))}
    gone, new = terms.changed_records(a, b, ["cov_id"], ["cov_values"])
    assert gone.count() < len(before) / 2
    store.apply(terms.list_deltas(gone, "f", "cov_values", terms.REMOVED), terms.list_deltas(new, "f", "cov_values"))
    assert state(store) == counted(after) | {None: (0, len(after))}
    store.apply(terms.list_deltas(b, "f", "cov_values", terms.REMOVED))
    assert state(store) == {}


def test_records_over_rows(spark):
    rows = [("r", "t", "x"), ("r", "t", "x"), ("r", "t", None), ("r", None, ""), (None, None, "x"), ("s", "t", "y")]
    df = spark.createDataFrame(rows, "report_id string, table_name string, column_name string")
    store = terms.TermCounts(spark)
    store.apply(terms.row_deltas(df, "c", ["report_id", "table_name"], "column_name"))
    assert state(store) == {"x": (3, 2), "y": (1, 1), None: (0, 4)}
    marks = {(r.term, r.mark) for r in terms.marked_terms(store.counts(), max_rare=2, common_share=0.4).collect()}
    assert marks == {("x", "rare"), ("x", "common"), ("y", "rare")}


def test_empty_terms(spark):
    store = terms.TermCounts(spark)
    store.apply(terms.list_deltas(spark.createDataFrame([], COV), "f", "cov_values"))
    assert store.counts().count() == 0 and terms.marked_terms(store.counts()).count() == 0


def test_an_update_that_dies_changes_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", "b"], "x", 1), (2, ["a"], "x", 1)], COV)
    store = terms.TermCounts(spark, buckets=2)
    assert store.apply(terms.list_deltas(rows, "f", "cov_values")) == 1
    expected = {"a": (2, 2), "b": (1, 1), None: (0, 2)}
    more = terms.list_deltas(spark.createDataFrame([(3, ["a", "c"], "x", 1)], COV), "f", "cov_values")

    # Dies after the new partitions are written, before the manifest; then after the draft of the manifest.
    for step in ("_publish", "rename"):
        broken = terms.TermCounts(spark, store.path)
        if step == "_publish":
            monkeypatch.setattr(broken, "_publish", lambda _: (_ for _ in ()).throw(KeyboardInterrupt()))
        else:
            draft = broken._publish

            def cut(manifest, draft=draft, broken=broken):
                broken._fs.create(broken._hadoop(f"draft-{manifest['version']}-dead"), False).close()
                raise KeyboardInterrupt

            monkeypatch.setattr(broken, "_publish", cut)
        try:
            broken.apply(more)
        except KeyboardInterrupt:
            pass
        again = terms.TermCounts(spark, store.path)
        assert again.version() == 1 and state(again) == expected
    # Two writers of one number: the second gets an error, the first one's counts stand.
    first, second = terms.TermCounts(spark, store.path), terms.TermCounts(spark, store.path)
    stale = second._manifest()
    monkeypatch.setattr(second, "_manifest", lambda: stale)
    assert first.apply(more) == 2
    try:
        second.apply(more)
        raise AssertionError("the second writer must fail")
    except RuntimeError:
        pass
    assert state(terms.TermCounts(spark, store.path)) == {"a": (3, 3), "b": (1, 1), "c": (1, 1), None: (0, 3)}


def test_buckets_follow_the_number_of_terms(spark):
    store = terms.TermCounts(spark, buckets=1, bucket_rows=8, writer_rows=4)
    rows = [(i, [f"t{i % 30}"], "x", 1) for i in range(60)]
    for part in (rows[:5], rows[5:20], rows[20:]):
        store.apply(terms.list_deltas(spark.createDataFrame(part, COV), "f", "cov_values"))
    assert state(store) == counted(rows) | {None: (0, 60)}
    manifest = store._manifest()
    assert manifest["n_buckets"] >= 4 and len(manifest["buckets"]) > 2


READS = "record_id bigint, flag int, contig_id int, contig_name string, contig_position int, map_q int, cigar string, mate_contig_name string, mate_position int, inferred_size int, seq string, base_quals string, attributes array<string>, read_group string, loaded_at timestamp, rank int, profile string"


def present(r):
    return {"map_q": r[5] not in (None, 255), "seq": r[10] not in (None, "", "*"), "base_quals": r[11] not in (None, "", "*"), "inferred_size": r[9] is not None, "attributes": bool(r[12])}


def brute_survivors(rows):
    """The leader's fields; of each it lacks, the best other record's that keeps the lengths alike."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[4], r[1] & 16].append(r)
    out = {}
    for members in groups.values():
        if len(members) < 2:
            continue
        low = float("-inf")
        key = lambda r: (sum(present(r).values()), r[5] if present(r)["map_q"] else low, r[14].timestamp() if r[14] else low, -r[0])
        ranked = sorted(members, key=key, reverse=True)
        lead = ranked[0]
        chosen = {}
        for f, i in (("map_q", 5), ("inferred_size", 9), ("attributes", 12)):
            chosen[f] = next((r[i] for r in ranked if present(r)[f]), None)
        n = 4  # every CIGAR here reads four bases
        if present(lead)["seq"] and present(lead)["base_quals"]:
            pair = (lead[10], lead[11])
        elif present(lead)["seq"]:
            pair = (lead[10], next((r[11] for r in ranked if present(r)["base_quals"] and len(r[11]) == len(lead[10])), None))
        elif present(lead)["base_quals"]:
            pair = (next((r[10] for r in ranked if present(r)["seq"] and len(r[10]) == n and len(lead[11]) == n), None), lead[11])
        else:
            both = next(((r[10], r[11]) for r in ranked if present(r)["seq"] and present(r)["base_quals"] and len(r[10]) == len(r[11]) == n), None)
            one = next(((r[10], None) if present(r)["seq"] else (None, r[11]) for r in ranked if (present(r)["seq"] and len(r[10]) == n) or (present(r)["base_quals"] and len(r[11]) == n)), (None, None))
            pair = both or one
        out[min(r[0] for r in members)] = (lead[0], len(members), chosen["map_q"], *pair, chosen["inferred_size"], tuple(chosen["attributes"]) if chosen["attributes"] else None)
    return out


def test_survivors_against_brute_force(spark):
    import datetime as dt

    rnd = random.Random(9)
    rows = []
    for i in range(240):
        length = rnd.choice([4, 4, 4, 5])
        rows.append(
            (i + 1, rnd.choice([0, 16]), 0, rnd.choice(["1", "chr1", " 1 "]), 10 * rnd.randint(1, 12), rnd.choice([None, 255, 0, 30, 60]), "4M", rnd.choice(["*", None, ""]), rnd.choice([0, 7, None]), rnd.choice([None, 0, 100]),
             rnd.choice([None, "*", "", "ACGT"[:4] + "A" * (length - 4)]), rnd.choice([None, "*", "I" * length]), rnd.choice([None, [], ["NM:i:1"], ["AS:i:%d" % i]]), "g", rnd.choice([None, dt.datetime(2024, 1, rnd.randint(1, 4))]), 1, "clash")
        )
    reads = spark.createDataFrame(rows, READS)
    groups = spark.createDataFrame([("g", "s")], "read_group string, sample_name string")
    contigs = spark.createDataFrame([(0, "1")], "contig_id int, contig_name string")
    expected = brute_survivors(rows)
    got = {r.group_id: (r.keep_id, r.n_records, r.map_q, r.seq, r.base_quals, r.inferred_size, tuple(r.attributes) if r.attributes else None) for r in survivors.survivors(reads, groups, contigs).collect()}
    assert got == expected


def test_a_leader_of_many_profiles_stays(spark):
    """However many records could fill what the best one lacks, it leads, and what it lacks is only filled at its own length."""
    import datetime as dt

    rnd = random.Random(3)
    for n in (10, 30, 60, 200):
        at = dt.datetime(2024, 1, 1)
        rows = [(1, 0, 0, "1", 10, 60, "100M", "*", None, None, None, None, ["NM:i:1"], "g", at, 1, "x")]
        rows[0] = (*rows[0][:9], 100, *rows[0][10:])
        for i in range(2, n + 2):
            size = 100 + i
            rows.append((i, 0, 0, "1", 10, 50, f"{size}M", "*", None, None, "A" * size, "I" * size, ["NM:i:2"] if i % 2 else None, "g", at, 1, "x"))
        fitting = rnd.randint(2, n + 1)
        rows[fitting - 1] = (*rows[fitting - 1][:10], "C" * 100, "J" * 100, *rows[fitting - 1][12:])
        rows = [r if r[0] == 1 else (*r[:12], None, *r[13:]) for r in rows]  # two present fields and a lower quality: all below the leader
        reads = spark.createDataFrame(rows, READS)
        groups = spark.createDataFrame([("g", "s")], "read_group string, sample_name string")
        contigs = spark.createDataFrame([(0, "1")], "contig_id int, contig_name string")
        (got,) = survivors.survivors(reads, groups, contigs).collect()
        assert (got.keep_id, got.n_records, got.seq, got.base_quals, got.map_q, got.inferred_size) == (1, n + 1, "C" * 100, "J" * 100, 60, 100)
        profiles = [{"rank": {"complete": 3, "map_q": 60, "loaded": 0, "minus_id": -1}, "profile": {"read_length": 100, "seq": None, "base_quals": None, "map_q": True, "inferred_size": True, "attributes": True}}]
        profiles += [{"rank": {"complete": 3, "map_q": 50, "loaded": 0, "minus_id": -i}, "profile": {"read_length": 100 + i, "seq": 100 + i, "base_quals": 100 + i, "map_q": True, "inferred_size": False, "attributes": False}} for i in range(2, n + 2)]
        assert survivors.choose_sources(profiles)["keep_id"] == 1


def test_survivors_of_odd_tables(spark):
    groups = spark.createDataFrame([("g", "s")], "read_group string, sample_name string")
    contigs = spark.createDataFrame([(0, "1")], "contig_id int, contig_name string")
    empty = spark.createDataFrame([], READS)
    assert survivors.survivor_sources(empty, groups, contigs).count() == 0 and survivors.survivors(empty, groups, contigs).count() == 0
    row = (1, 0, None, "1", 5, None, "4M", None, None, None, None, None, None, "g", None, 1, "x")
    twice = spark.createDataFrame([row, row, (*row[:13], None, *row[14:])], READS)
    assert [(r.group_id, r.keep_id, r.n_records) for r in survivors.survivor_sources(twice, groups, contigs).collect()] == [(1, 1, 2)]


def test_five_prime(spark):
    base = (0, None, "1", 100, 60, "=", 500, 1, "ACGT", "IIII", ["x"], "g", None, 1, "x")

    def read(i, flag, cigar, at):
        return (i, flag, base[1], base[2], at, 60, cigar, "=", 500, 1, "ACGT", "IIII", ["x"], "g", None, 1, "x")

    rows = [read(1, 0, "2H3S5M", 105), read(2, 0, "5M", 100), read(3, 16, "5M2D3M4S1H", 90), read(4, 16, "15M", 90), read(5, 16, "14M", 90)]
    groups = spark.createDataFrame([("g", "s")], "read_group string, sample_name string")
    contigs = spark.createDataFrame([(0, "1")], "contig_id int, contig_name string")
    got = {(r.group_id, r.n_records) for r in survivors.survivor_sources(spark.createDataFrame(rows, READS), groups, contigs).collect()}
    assert got == {(1, 2), (3, 2)}
