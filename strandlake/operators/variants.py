"""Variant records: decoding of INFO and sample columns, alleles, splitting, trimming, merging and joins of known ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import ordered
from strandlake.operators.periods import gvcf_end
from strandlake.tables import contig_key, with_contig

#: Upper ends of the genotype quality bands of reference blocks.
GQ_BANDS = (*range(1, 61), 70, 80, 90, 99)


def info_map(info: Column) -> Column:
    """INFO as map<string,string>; a key without a value has a null one; ``.`` and null are empty. Of repeated keys the first counts."""
    parts = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda x: ~x.isin("", "."))
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]).alias("at"), (i + 1).alias("i"))), lambda p: p["at"] == p["i"])
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


def info_value(info: Column, key: str) -> Column:
    """One INFO value as text, by pattern; cheaper than the map where only a key or two are needed."""
    found = F.regexp_extract(F.coalesce(info, F.lit("")), f"(?:^|;){key}=([^;]*)", 1)
    return F.when(found != "", found)


def sample_value(keys: Column, genotype: Column, key: str) -> Column:
    """The sample column's value of a FORMAT key; null if the key or the (trailing) value is missing."""
    at = F.array_position(F.split(keys, ":"), key)
    value = F.when(at > 0, F.get(F.split(genotype, ":"), (at - 1).cast("int")))
    return F.when(~value.isin("", "."), value)


def decoded(variants: DataFrame) -> DataFrame:
    """Encoded calls with ``rest`` split into info, format_keys and genotype."""
    parts = F.split("rest", "\t")
    return variants.withColumns({"info": F.get(parts, F.lit(0)), "format_keys": F.get(parts, F.lit(1)), "genotype": F.get(parts, F.lit(2))})


def alts(alt: Column) -> Column:
    return F.when(alt.isNull() | (alt == "."), F.array().cast("array<string>")).otherwise(F.split(alt, ","))


def is_symbolic(allele: Column) -> Column:
    return allele.startswith("<") | (allele == "*")


def allele_type(ref: Column, alt: Column) -> Column:
    same = F.length(ref) == F.length(alt)
    return F.when(is_symbolic(alt), "SYMBOLIC").when(same & (F.length(ref) == 1), "SNP").when(same, "MNP").otherwise("INDEL")


def variant_type(ref: Column, alt: Column) -> Column:
    """The type of all alternates if they agree, ``MIXED`` if not, ``NO_VARIATION`` without any; symbolic ones count only alone."""
    kinds = F.array_distinct(F.transform(alts(alt), lambda a: allele_type(ref, a)))
    real = F.array_remove(kinds, "SYMBOLIC")
    return F.when(F.size(kinds) == 0, "NO_VARIATION").when(F.size(real) == 0, "SYMBOLIC").when(F.size(real) > 1, "MIXED").otherwise(F.element_at(real, 1))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the common end, leaving at least one base of each."""
    most = F.least(F.length(a), F.length(b)) - 1
    lengths = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: F.right(a, i) == F.right(b, i))
    return F.array_max(lengths)


def common_prefix(a: Column, b: Column) -> Column:
    most = F.least(F.length(a), F.length(b)) - 1
    lengths = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: F.left(a, i) == F.left(b, i))
    return F.array_max(lengths)


def trimmed(rows: DataFrame, position: str = "contig_position", ref: str = "ref_allele", alt: str = "alt") -> DataFrame:
    """Biallelic rows with shared ends of their alleles cut, the end first; the start moves with a cut prefix. Symbolic alleles stay."""
    real = ~is_symbolic(F.col(alt))
    rows = rows.withColumn("_cut", F.when(real, common_suffix(F.col(ref), F.col(alt))).otherwise(0))
    short = lambda c: F.left(F.col(c), F.length(c) - F.col("_cut"))
    rows = rows.withColumns({ref: short(ref), alt: F.when(real, short(alt)).otherwise(F.col(alt))})
    rows = rows.withColumn("_skip", F.when(real, common_prefix(F.col(ref), F.col(alt))).otherwise(0))
    rest = lambda c: F.substring(F.col(c), F.col("_skip") + 1, F.length(c))
    return rows.withColumns({position: F.col(position) + F.col("_skip"), ref: F.when(real, rest(ref)).otherwise(F.col(ref)), alt: F.when(real, rest(alt)).otherwise(F.col(alt))}).drop("_cut", "_skip")


def biallelic(rows: DataFrame) -> DataFrame:
    """A row per alternate, with its own AD (ref, alt) and diploid PL (three values) where the record has them."""
    split = rows.select("*", F.posexplode(alts(F.col("alt"))).alias("alt_index", "one_alt"))
    ad = F.split(sample_value(F.col("format_keys"), F.col("genotype"), "AD"), ",")
    pl = F.split(sample_value(F.col("format_keys"), F.col("genotype"), "PL"), ",")
    a = F.col("alt_index") + 1
    het, hom = (a * (a + 1) / 2).cast("int"), (a * (a + 3) / 2).cast("int")  # genotypes 0/a and a/a in the order of PL
    pick = lambda arr, i: F.get(arr, i).try_cast("int")
    return split.withColumns({"alt": F.col("one_alt"), "ref_depth": pick(ad, F.lit(0)), "alt_depth": pick(ad, a), "pl_ref": pick(pl, F.lit(0)), "pl_het": pick(pl, het), "pl_hom": pick(pl, hom)}).drop("one_alt")


def primitives(rows: DataFrame) -> DataFrame:
    """Block substitutions of biallelic rows as single-base rows where the bases differ."""
    same = (F.length("ref_allele") == F.length("alt")) & ~is_symbolic(F.col("alt"))
    steps = F.when(same, F.filter(F.sequence(F.lit(0), F.length("ref_allele") - 1), lambda i: F.substring("ref_allele", i + 1, F.lit(1)) != F.substring("alt", i + 1, F.lit(1)))).otherwise(F.array(F.lit(-1)))
    out = rows.withColumn("_i", F.explode(steps))
    whole = F.col("_i") < 0
    one = lambda c: F.when(whole, F.col(c)).otherwise(F.substring(c, F.col("_i") + 1, F.lit(1)))
    return out.withColumns({"contig_position": F.when(whole, F.col("contig_position")).otherwise(F.col("contig_position") + F.col("_i")), "_r": one("ref_allele"), "_a": one("alt")}).drop("ref_allele", "alt", "_i").withColumnsRenamed({"_r": "ref_allele", "_a": "alt"})


def merged_sites(rows: DataFrame) -> DataFrame:
    """One row per (contig, position): the longest reference, all alternates extended to it, summed depth, best quality, joined ids.

    An alternate of a shorter reference gets the bases that the longest one has more. Every value comes from an aggregate over distinct alleles.
    """
    keyed = rows.withColumn("contig", contig_key(F.col("contig_name")))
    depth = info_value(F.col("info"), "DP").try_cast("bigint")
    site = keyed.groupBy("contig", "contig_position").agg(
        F.max_by("ref_allele", F.struct(F.length("ref_allele"), "ref_allele")).alias("ref"), F.count(F.lit(1)).alias("n_records"), F.countDistinct("sample_name").alias("n_samples"), F.max("qual").alias("best_qual"), F.sum(depth).alias("depth"),
        F.concat_ws(";", F.array_sort(F.collect_set(F.when(F.col("variant_id") != ".", F.col("variant_id"))))).alias("ids"),
    )
    alleles = keyed.select("contig", "contig_position", "ref_allele", F.explode(alts(F.col("alt"))).alias("a")).distinct()
    extended = alleles.join(site.select("contig", "contig_position", "ref"), ["contig", "contig_position"])
    longer = F.when(is_symbolic(F.col("a")), F.col("a")).otherwise(F.concat(F.col("a"), F.substring("ref", F.length("ref_allele") + 1, F.length("ref"))))
    sets = extended.groupBy("contig", "contig_position").agg(F.array_join(F.array_sort(F.collect_set(longer)), ",").alias("alts"))
    return site.join(sets, ["contig", "contig_position"], "left").withColumn("alts", F.coalesce("alts", F.lit("")))


def with_known_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``known_ids``: ids of the known records at the same contig and start, with the same reference and a shared alternate; joined by ``;``.

    Both sides have contig_name, contig_position, ref_allele, alt; ``rows`` a unique record_id, ``known`` variant_id.
    """

    def alleles(df: DataFrame) -> DataFrame:
        return df.withColumns({"_k": contig_key(F.col("contig_name")), "_a": F.explode(alts(F.col("alt")))})

    theirs = alleles(known.where("variant_id <> '.'")).select("_k", F.col("contig_position").alias("_p"), F.col("ref_allele").alias("_r"), "_a", "variant_id").distinct()
    ours = alleles(rows).select("record_id", "_k", F.col("contig_position").alias("_p"), F.col("ref_allele").alias("_r"), "_a")
    ids = ours.join(theirs, ["_k", "_p", "_r", "_a"]).groupBy("record_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("variant_id"))).alias("known_ids"))
    return rows.join(ids, "record_id", "left")


def with_overlap_flag(rows: DataFrame, track: DataFrame, out: str = "in_track") -> DataFrame:
    """Add ``out``: whether an unfiltered record of the track starts at the same place."""
    places = track.where(F.col("filters").isNull() | F.col("filters").isin(".", "PASS")).select(contig_key(F.col("contig_name")).alias("_k"), F.col("contig_position").alias("_p")).distinct().withColumn("_hit", F.lit(True))
    keyed = rows.withColumn("_k", contig_key(F.col("contig_name")))
    joined = keyed.join(places, (keyed["_k"] == places["_k"]) & (keyed["contig_position"] == places["_p"]), "left")
    return joined.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_k", "_p", "_hit")


def gq_band(gq: Column) -> Column:
    """The half-open band of genotype qualities: the number of upper ends not above it."""
    return F.when(gq < 60, F.greatest(gq, F.lit(0))).otherwise(sum((F.when(gq >= b, 1).otherwise(0) for b in (60, 70, 80, 90, 99)), F.lit(59)))


def reference_blocks(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """Hom-ref records merged while they touch or overlap the one before and keep its quality band.

    (sample_name, contig_name, from_position, to_position, n_records, median_gq, median_dp, min_dp, min_pl): medians are the upper of two middle
    values, qualities capped at 99, min_pl the smallest PL of each genotype.
    """
    number = lambda key: sample_value(F.col("format_keys"), F.col("genotype"), key).try_cast("int")
    named = with_contig(records, contigs, out="_c").where(F.col("_c").isNotNull() & F.col("alt").isin("<NON_REF>", "."))
    rows = named.select(
        "record_id", "sample_name", F.col("_c").alias("contig_name"), F.col("contig_position").cast("bigint").alias("a"), gvcf_end().cast("bigint").alias("b"), F.least(number("GQ"), F.lit(99)).alias("gq"), number("DP").alias("dp"), F.coalesce(number("MIN_DP"), number("DP")).alias("mdp"),
        F.transform(F.split(sample_value(F.col("format_keys"), F.col("genotype"), "PL"), ","), lambda x: x.try_cast("int")).alias("pl"),
    ).where("gq is not null").withColumn("band", gq_band(F.col("gq")))
    keys = ["sample_name", "contig_name"]
    blocks = ordered.with_island(rows, keys, "a", ["record_id"], ["b", "band"], lambda p: (F.col("a") > p["b"] + 1) | (F.col("band") != p["band"]))
    # Medians from histograms: a block's length doesn't bound its records, the values' range does.
    whole = blocks.groupBy(*keys, "island").agg(F.min("a").alias("from_position"), F.max("b").alias("to_position"), F.count(F.lit(1)).alias("n_records"), F.min("mdp").alias("min_dp"), *(F.min(F.get("pl", F.lit(i))).alias(f"_pl{i}") for i in range(3)))
    for v in ("gq", "dp"):
        counts = blocks.where(f"{v} is not null").groupBy(*keys, "island", v).agg(F.count(F.lit(1)).alias("n"))
        packed = counts.groupBy(*keys, "island").agg(F.sort_array(F.collect_list(F.struct(v, "n"))).alias("h"), F.floor(F.sum("n") / 2).alias("half"))
        whole = whole.join(packed.select(*keys, "island", _weighted_middle(v).alias(f"median_{v}")), [*keys, "island"], "left")
    return whole.select(*keys, "from_position", "to_position", "n_records", "median_gq", "median_dp", "min_dp", F.concat_ws(",", *(F.col(f"_pl{i}").cast("string") for i in range(3))).alias("min_pl"))


def _weighted_middle(value: str) -> Column:
    """Of the sorted histogram ``h``: the value at which more than ``half`` of the counts are reached."""
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(None).cast("int").alias("m"))

    def step(a: Column, x: Column) -> Column:
        seen = a["s"] + x["n"]
        return F.struct(seen.alias("s"), F.coalesce(a["m"], F.when(seen > F.col("half"), x[value])).alias("m"))

    return F.aggregate("h", start, step, lambda a: a["m"])


def reverse_complemented(allele: Column) -> Column:
    return F.when(is_symbolic(allele), allele).otherwise(F.reverse(F.translate(allele, "ACGTacgt", "TGCAtgca")))


def pruned_info(info: Column, kept: list[str]) -> Column:
    """INFO with the listed keys only, in their order there; ``.`` if none is left."""
    parts = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda x: F.substring_index(x, "=", 1).isin(list(kept)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ";")).otherwise(".")


def alleles_within(inner: Column, outer: Column) -> Column:
    """Whether all alleles of one list are in the other."""
    return F.size(F.array_except(inner, outer)) == 0


def allele_permutation(of: Column, to: Column) -> Column:
    """For each allele of one list its index in the other, -1 where it isn't there."""
    return F.transform(of, lambda a: (F.array_position(to, a) - 1).cast("int"))


def called_alternates(gt: Column, alternates: Column) -> Column:
    """The distinct alternates that a genotype (indices) has."""
    return F.array_compact(F.transform(F.array_distinct(F.filter(gt, lambda g: g > 0)), lambda g: F.get(alternates, g - 1)))


def mean_alternate_size(ref: Column, called: Column) -> Column:
    """Mean size of called alternates: mismatches of equally long alleles, else the change of length; 1 for symbolic ones. Null without any."""

    def size(a: Column) -> Column:
        differing = F.size(F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.substring(ref, i, F.lit(1)) != F.substring(a, i, F.lit(1))))
        return F.when(is_symbolic(a), 1).when(F.length(a) == F.length(ref), differing).otherwise(F.abs(F.length(a) - F.length(ref)))

    return F.when(F.size(called) > 0, F.aggregate(F.transform(called, size), F.lit(0), lambda s, x: s + x) / F.size(called))


def total_ploidy(gt_text: Column) -> Column:
    """Alleles of a genotype text, called or not; 0 without one."""
    return F.when(gt_text.isNull(), 0).otherwise(F.size(F.split(gt_text, "[/|]")))


def _pl_index(a: Column, b: Column) -> Column:
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (hi * (hi + 1) / 2 + lo).cast("int")


def allele_subset(rows: DataFrame, kept: Column) -> DataFrame:
    """Records cut to some of their alleles: ``kept`` holds their indices, 0 first. Adds ``new_alts``, ``new_ad``, ``new_pl`` (from 0) and ``new_gt``, the likeliest genotype left.

    rows: alt, format_keys, genotype. AD and PL are null where the record has none or not one for each allele; without PL the genotype is ``./.``.
    """
    n = F.size(alts(F.col("alt"))) + 1
    numbers = lambda key: F.transform(F.split(sample_value(F.col("format_keys"), F.col("genotype"), key), ","), lambda x: x.try_cast("int"))
    rows = rows.withColumns({"_kept": kept, "_ad": numbers("AD"), "_pl": numbers("PL")})
    pairs = F.flatten(F.transform("_kept", lambda b, j: F.transform(F.slice("_kept", F.lit(1), j + 1), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    picked = F.transform(pairs, lambda p: F.get("_pl", _pl_index(p["a"], p["b"])))
    rows = rows.withColumns({"_new_pl": F.when(F.size("_pl") == (n * (n + 1) / 2).cast("int"), picked), "new_alts": F.transform(F.filter("_kept", lambda k: k > 0), lambda k: F.get(alts(F.col("alt")), k - 1))})
    least = F.array_min("_new_pl")
    rows = rows.withColumns({"new_pl": F.transform("_new_pl", lambda x: x - least), "new_ad": F.when(F.size("_ad") == n, F.transform("_kept", lambda k: F.get("_ad", k)))})
    # The place of a pair among the kept alleles, in the order of PL, is that of its genotype.
    order = F.flatten(F.transform("_kept", lambda b, j: F.transform(F.sequence(F.lit(0), j), lambda i: F.concat_ws("/", i.cast("string"), j.cast("string")))))
    best = F.get(order, (F.array_position("new_pl", F.lit(0)) - 1).cast("int"))
    return rows.withColumn("new_gt", F.coalesce(F.when(~F.exists("new_pl", lambda x: x.isNull()), best), F.lit("./."))).drop("_kept", "_ad", "_pl", "_new_pl")
