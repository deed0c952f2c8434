"""A mixture of sources in which each contributes its target share of the tokens.

Documents are ordered by a hash of their id. Token sums by source and hash bucket (sources x 4096 numbers) show in which bucket a
source's budget ends; only that bucket is refined by the next bits of the hash, until it holds one document. What is then left is a
threshold per source: a document is taken if its hash lies below it. Nothing is sorted, and thresholds of larger budgets contain the
smaller ones' documents. A budget of several times a source is whole copies of it and a threshold for the rest.

The total is the largest at which every source that has tokens reaches its share with its allowed repeats, unless one is given; then
sources that can't reach theirs give all they have. Reached shares are reported.

Defined results: documents of null or unlisted sources are left out, spellings of a source are unified (case, blanks, ``-`` for ``_``);
a null share is 0, null repeats are 1; a listed source without tokens reaches 0 and doesn't limit the total; documents without
tokens are never used; repeated ids share a hash and are used together; an empty table yields no documents; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import staged

#: Bits of the hash that one pass looks at, and how many sources a mixture may name (the histograms are collected).
BITS, MAX_SOURCES = 12, 10_000


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(source, r"^\s+|\s+$", ""), r"[-\s]+", "_"))


def _goals(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(source_key(F.col("source")), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mixture of more than {MAX_SOURCES} sources")
    return {s: (share or 0.0, 1 if repeats is None else repeats) for s, share, repeats in rows if s is not None}


def largest_total(tokens: dict[str, int], goals: dict[str, tuple[float, int]]) -> int:
    """The largest total at which every source with tokens reaches its share."""
    return int(min((tokens[s] * repeats / share for s, (share, repeats) in goals.items() if share > 0 and tokens.get(s, 0) > 0), default=0))


def _bucket(hashed: Column, level: int) -> Column:
    """The level's bits of the hash, from the top."""
    shift = 64 - BITS * (level + 1)
    return F.shiftrightunsigned(hashed, shift).bitwiseAND((1 << BITS) - 1) if shift >= 0 else hashed.bitwiseAND((1 << (BITS + shift)) - 1)


def thresholds(docs: DataFrame, budgets: dict[tuple[str, int], int]) -> dict[tuple[str, int], int]:
    """For each (source, budget number) the unsigned hash below which documents sum to the budget, as nearly as whole documents allow.

    docs: (source, hashed, n_tokens). Each level is one pass that sums only what lies in a bucket where some budget ends.
    """
    found: dict[tuple[str, int], int] = {}
    open_ = {k: (0, b) for k, b in budgets.items()}  # hash prefix so far, what is left of the budget inside it
    for level in range(-(-64 // BITS)):
        if not open_:
            break
        width = min(BITS, 64 - BITS * level)
        rows = docs
        if level:
            prefixes = sorted({(s, prefix) for (s, _), (prefix, _) in open_.items()})
            inside = docs.sparkSession.createDataFrame(prefixes, "source string, _prefix bigint")
            rows = docs.withColumn("_prefix", F.shiftrightunsigned("hashed", 64 - BITS * level)).join(F.broadcast(inside), ["source", "_prefix"])  # a row per budget
        else:
            rows = docs.withColumn("_prefix", F.lit(0).cast("bigint"))
        cells: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
        summed = rows.groupBy("source", "_prefix", _bucket(F.col("hashed"), level).alias("_bucket")).agg(F.sum("n_tokens"), F.count(F.lit(1)))
        for s, prefix, bucket, size, n in summed.collect():  # sources x 4096 at most at the first level, budgets x 4096 after it
            cells.setdefault((s, prefix), []).append((bucket, size, n))
        for k in list(open_):
            prefix, left = open_.pop(k)
            end, last = (prefix + 1) << (64 - BITS * level), level == -(-64 // BITS) - 1
            for bucket, size, n in sorted(cells.get((k[0], prefix), [])):
                here = (prefix << width) + bucket
                after = (here + 1) << (64 - BITS * level - width)
                if size <= left:
                    left -= size
                    continue
                if n == 1 or last:  # one document, or ids that share all of their hash: in if that comes nearer
                    end = after if size - left < left else here << (64 - BITS * level - width)
                else:
                    open_[k] = (here, left)
                break
            if k not in open_:
                found[k] = end
    return found


def mix(docs: DataFrame, targets: DataFrame, fractions: tuple[float, ...] = (1.0,), total: int | None = None, seed: int = 17, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, shares) of nested mixtures, one for each fraction of the total.

    docs: (doc, source, n_tokens). documents: (fraction, doc, source, n_tokens, copies). shares: (fraction, source, target_share, max_repeats,
    source_tokens, used_tokens, reached_share, deviation, token_deviation, most_copies), a row for every source of the targets; a deviation is what was reached less the target.
    """
    spark, goals = docs.sparkSession, _goals(targets)
    known = docs.select(F.col(doc).alias("_doc"), source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    known = known.where(F.col("source").isin(list(goals)) & (F.col("n_tokens") > 0)).withColumn("hashed", F.xxhash64(F.col("_doc"), F.lit(seed)))
    known = staged(known, "mix-sizes")
    tokens = {s: n for s, n in known.groupBy("source").agg(F.sum("n_tokens")).collect()}
    whole = largest_total(tokens, goals) if total is None else total
    copies, budgets = {}, {}
    for s, size in tokens.items():
        share, repeats = goals[s]
        for i, fraction in enumerate(fractions):
            wanted = min(round(whole * fraction * share), size * repeats)
            copies[s, i], budgets[s, i] = divmod(wanted, size)
    below = thresholds(known.drop("_doc"), {k: b for k, b in budgets.items() if b > 0})
    flip = 1 << 63  # the order of unsigned numbers, in signed ones; 2**64 itself has no such number
    rows = [(s, float(fractions[i]), n, max(-flip, min(below.get((s, i), 0), 2 * flip - 1) - flip), below.get((s, i), 0) >= 2 * flip) for (s, i), n in copies.items()]
    rules = spark.createDataFrame(rows, "source string, fraction double, _whole bigint, _below bigint, _all boolean")
    taken = F.col("_whole") + ((F.col("hashed").bitwiseXOR(F.lit(-flip)) < F.col("_below")) | F.col("_all")).cast("int")
    used = known.join(F.broadcast(rules), "source").withColumn("copies", taken).where("copies > 0")  # a row per source and fraction
    documents = used.select("fraction", F.col("_doc").alias(doc), "source", "n_tokens", "copies")
    sums = documents.groupBy("fraction", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    listed = spark.createDataFrame([(float(f), s, share, repeats, tokens.get(s, 0)) for f in fractions for s, (share, repeats) in goals.items()], "fraction double, source string, target_share double, max_repeats int, source_tokens bigint")
    per = listed.join(sums, ["fraction", "source"], "left").fillna(0, ["used_tokens", "most_copies"])
    all_used = per.groupBy("fraction").agg(F.sum("used_tokens").alias("_total"))
    shares = per.join(all_used, "fraction").withColumn("reached_share", F.when(F.col("_total") > 0, F.col("used_tokens") / F.col("_total")).otherwise(F.lit(0.0)))
    shares = shares.withColumns({"deviation": F.col("reached_share") - F.coalesce("target_share", F.lit(0.0)), "token_deviation": F.col("used_tokens") - F.round(F.coalesce("target_share", F.lit(0.0)) * F.col("_total")).cast("bigint")})
    return documents, shares.select("fraction", "source", "target_share", "max_repeats", "source_tokens", "used_tokens", "reached_share", "deviation", "token_deviation", "most_copies")
