"""Counts of every distinct term over a collection, kept up to date by signed deltas.

Only records that were added, changed or deleted are read: their terms give +1 (as they are now) and -1 (as they were)
changes of a term's occurrences and of the records that hold it. The changes are aggregated (partially before the shuffle) and
merged into counts that persist as a table partitioned by a hash of the term; an update rewrites only the partitions it touches.
The number of all records is kept the same way, under the null term.

Defined results: null and empty terms are no terms, all else is taken as written; a record without terms counts as a record;
a term repeated in a record counts once as a record; terms whose counts fall to zero vanish; an empty collection has no terms;
a null record key is a key like any other; columns other than those named are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.session import new_path, staged

ADDED, REMOVED = 1, -1
_COUNTS = "field_name string, term string, occurrences bigint, records bigint"


def _is_term(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def list_deltas(rows: DataFrame, field_name: str, terms: str, sign: int = ADDED) -> DataFrame:
    """Changes from records that are one row each, with their terms in an array. One pass, no shuffle by record."""
    ordered = F.sort_array(F.filter(F.coalesce(F.col(terms), F.array().cast("array<string>")), _is_term))
    rows = rows.select(ordered.alias("_terms"))
    # In a sorted list an item that differs from the one before is the record's first of its kind.
    items = F.transform("_terms", lambda x, i: F.struct(x.alias("term"), F.lit(1).alias("occurrences"), F.when((i == 0) | (F.get("_terms", i - 1) != x), 1).otherwise(0).alias("records")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("occurrences"), F.lit(1).alias("records")))
    return _summed(rows.select(F.inline(F.concat(own, items))), field_name, sign)


def row_deltas(rows: DataFrame, field_name: str, record: list[str], term: str, sign: int = ADDED) -> DataFrame:
    """Changes from records that span rows with one term each. ``rows`` has all rows of each record in it."""
    keys = [f"_r{i}" for i in range(len(record))]
    rows = rows.select(*(F.col(r).alias(k) for r, k in zip(record, keys, strict=True)), F.col(term).alias("_term"))
    both = F.filter(F.array(F.lit(None).cast("string"), F.col("_term")), lambda x: x.isNull() | (x != ""))
    held = rows.select(*keys, F.explode(F.array_distinct(both)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("occurrences"))
    held = held.select("term", F.when(F.col("term").isNull(), 0).otherwise(F.col("occurrences")).alias("occurrences"), F.lit(1).alias("records"))
    return _summed(held, field_name, sign)


def _summed(items: DataFrame, field_name: str, sign: int) -> DataFrame:
    total = items.groupBy("term").agg((F.sum("occurrences") * sign).alias("occurrences"), (F.sum("records") * sign).alias("records"))
    return total.select(F.lit(field_name).alias("field_name"), "term", "occurrences", "records")


def changed_records(before: DataFrame, after: DataFrame, record: list[str], content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``before``, rows of ``after``) whose record was deleted, changed or added; the counts need no others.

    Records are compared by the number of their rows and two independent sums of row hashes (the content may be in any order).
    """

    row = [F.to_json(F.struct(*content))]

    def marks(df: DataFrame, side: str) -> DataFrame:
        keys = [F.col(r).alias(f"{side}{i}") for i, r in enumerate(record)]
        return df.groupBy(*keys).agg(F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(*row).cast("decimal(38,0)")), F.sum(F.hash(*row).cast("bigint"))).alias(side))

    a, b = marks(before, "_a"), marks(after, "_b")
    same = [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(record))]
    differing = a.join(b, same, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    # A record that only one side has is null on the other; null keys of both sides are null in either.
    ids = differing.select(*(F.coalesce(f"_a{i}", f"_b{i}").alias(f"_d{i}") for i in range(len(record))))

    def only(df: DataFrame) -> DataFrame:
        return df.join(ids, [F.col(r).eqNullSafe(F.col(f"_d{i}")) for i, r in enumerate(record)], "left_semi")

    return only(before), only(after)


class TermCounts:
    """Counts that persist in a folder all executors share; any number of sessions may open it one after the other.

    ``v<n>/bucket=<b>`` holds a partition as update n left it. ``manifest-<n>.json`` names the update that each partition is of and is the
    last file an update makes, in one create that fails if the file is there. So an update that dies before it leaves no trace but unused
    files, readers always find a whole manifest (that of the highest number), and of two writers of one number one gets an error and has
    changed nothing. The number of buckets follows the number of terms: where buckets would hold more than ``bucket_rows`` on average,
    the update doubles them as often as needed and rewrites all.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16, bucket_rows: int = 1_000_000, writer_rows: int = 250_000):
        self.spark, self.path, self.first_buckets, self.bucket_rows, self.writer_rows = spark, path or new_path(spark, "term-counts"), buckets, bucket_rows, writer_rows
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The number of the last complete update; 0 before the first."""
        if not self._fs.exists(self._hadoop("")):
            return 0
        names = (f.getPath().getName() for f in self._fs.listStatus(self._hadoop("")))
        return max((int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json")), default=0)

    def _manifest(self) -> dict:
        version = self.version()
        if not version:
            return {"version": 0, "n_buckets": self.first_buckets, "rows": 0, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{version}.json", wholetext=True).head()[0])

    def _publish(self, manifest: dict) -> None:
        """Make the update the valid one. The file is written under another name first, so that it is never seen in part."""
        version = manifest["version"]
        draft = self._hadoop(f"draft-{version}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._hadoop(f"manifest-{version}.json")) or not self._fs.rename(draft, self._hadoop(f"manifest-{version}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another update of {self.path} has become number {version}; apply this one anew")

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{x}" for x in folders]
        return self.spark.read.schema(_COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], _COUNTS)

    def counts(self) -> DataFrame:
        """(field_name, term, occurrences, records); the null term holds the number of all records of the field."""
        return self._read(sorted(self._manifest()["buckets"].values()))

    def apply(self, *deltas: DataFrame) -> int:
        """Merge changes and return the update's number. Partitions without changes are neither read nor written."""
        manifest = self._manifest()
        together = deltas[0]
        for more in deltas[1:]:
            together = together.unionByName(more)
        hashed = F.xxhash64("field_name", "term")
        changes = staged(together.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).withColumn("_hash", hashed), "term-deltas")
        most = manifest["rows"] + changes.count()
        n_buckets = manifest["n_buckets"]
        while most > n_buckets * self.bucket_rows:
            n_buckets *= 2
        bucket = F.pmod("_hash", F.lit(n_buckets)).cast("int")
        touched = {str(r[0]) for r in changes.select(bucket.alias("b")).distinct().collect()}  # at most n_buckets
        if n_buckets != manifest["n_buckets"]:
            touched |= set(manifest["buckets"])  # all are written anew
            held = self._read(sorted(manifest["buckets"].values()))
        else:
            held = self._read(sorted(f for b, f in manifest["buckets"].items() if b in touched))
        merged = held.withColumn("_hash", hashed).unionByName(changes).groupBy("_hash", "field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        merged = merged.where((F.col("occurrences") != 0) | (F.col("records") != 0))
        version = manifest["version"] + 1
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"  # of no other writer
        writers = max(1, -(-most // (n_buckets * self.writer_rows)))  # several files of a large bucket
        spread = merged.withColumns({"bucket": bucket, "_writer": F.pmod(F.shiftright("_hash", 32), F.lit(writers))}).repartition("bucket", "_writer").drop("_hash", "_writer")
        seen = Observation()
        spread.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("bucket").mode("errorifexists").parquet(f"{self.path}/{folder}")
        kept = {} if n_buckets != manifest["n_buckets"] else {b: f for b, f in manifest["buckets"].items() if b not in touched}
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(folder))]
        written = {x.removeprefix("bucket="): f"{folder}/{x}" for x in names if x.startswith("bucket=")}
        rows = seen.get["n"] if not kept else most  # with buckets left alone: a bound from above
        self._publish({"version": version, "n_buckets": n_buckets, "rows": rows, "buckets": kept | written})
        return version


def marked_terms(counts: DataFrame, max_rare: int = 3, common_share: float = 0.5) -> DataFrame:
    """(field_name, term, occurrences, records, mark): ``rare`` in at most ``max_rare`` records, ``common`` in more than their share of all.

    A term of a small collection can be both and then has two rows; a term that is neither has a null mark.
    """
    totals = counts.where(F.col("term").isNull()).select("field_name", F.col("records").alias("_all"))
    rare, common = F.when(F.col("records") <= max_rare, "rare"), F.when(F.col("records") > F.col("_all") * common_share, "common")
    marks = F.array_compact(F.array(rare, common))
    joined = counts.where(F.col("term").isNotNull()).join(totals, "field_name")
    return joined.select("field_name", "term", "occurrences", "records", F.explode_outer(marks).alias("mark"))
