import pyarrow as pa
import pytest

from strandlake.plans import extensions as X


def test_registry():
    r = X.standard()
    assert "unmapped" in r.names("read_filter") and "FS" in r.names("info_annotation")
    with pytest.raises(X.ExtensionError, match="already"):
        r.register("info_annotation", "FS", lambda s: s)
    with pytest.raises(X.ExtensionError, match="no such kind"):
        r.register("walker", "x", lambda s: s)
    with pytest.raises(X.ExtensionError, match="no covariate"):
        r.get("covariate", "x")
    r.register("covariate", "first", lambda seq, quals, reverse: [seq[0]] * len(seq))
    assert list(r.covariates(["first"])) == ["first"]


def test_filters_and_changes_by_name(spark):
    r = X.standard()
    reads = spark.createDataFrame([(1, 4, 1, "II"), (2, 0, 1, "~I"), (3, None, None, None)], "record_id int, flag int, contig_position int, base_quals string")
    assert {x.record_id for x in r.filtered(reads, ["unmapped"]).collect()} == {2, 3} and r.filtered(reads, []).count() == 3
    from pyspark.sql import functions as F

    r.register("read_transformer", "mark", lambda d: d.withColumn("base_quals", F.concat("base_quals", F.lit("!"))), place="last")
    assert {x.record_id: x.base_quals for x in r.transformed(reads, ["mark", "reencode"]).collect()} == {1: "**!", 2: "_*!", 3: None}


def test_annotations_of_null_samples_meet(spark):
    r = X.Registry()
    schema = "sample string, contig string, position bigint, {} int"
    r.register("format_annotation", "A", lambda s: spark.createDataFrame([(None, "1", 5, 1), ("s", "1", 5, 2)], schema.format("A")))
    r.register("format_annotation", "B", lambda s: spark.createDataFrame([(None, "1", 5, 3), (None, "1", 6, 4)], schema.format("B")))
    sites = X.Sites(spark.createDataFrame([("1", 5, "A", "C")], "contig string, position bigint, ref string, alt string"), None, None)
    _, got = r.annotated(sites, per_sample=["A", "B"])
    assert {(x.sample, x.position, x.A, x.B) for x in got.collect()} == {(None, 5, 1, 3), ("s", 5, 2, None), (None, 6, None, 4)}


def test_functions_over_loci_and_bins(spark):
    rows = spark.createDataFrame([("1", 5, i) for i in range(40)] + [("1", 6, 1)], "contig string, position bigint, v bigint")

    def summed(key, batches):
        total = sum(sum(b.column("v").to_pylist()) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([key[1]]), pa.array([total])], names=["position", "total"])

    assert {(x.position, x.total) for x in X.map_loci(rows, summed, "position bigint, total bigint").collect()} == {(5, 780), (6, 1)}
    doubled = X.map_reads(rows, lambda pdf: pdf.assign(v=pdf.v * 2), "contig string, position bigint, v bigint")
    assert doubled.agg({"v": "sum"}).head()[0] == 2 * 781
    with pytest.raises(X.ExtensionError, match="two tables"):
        X.process_bins({"a": rows}, rows, lambda n, t: None, "x int")
