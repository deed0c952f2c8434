"""Tables as text lines of the formats, and their files: sorted by coordinate in ranges, the header in the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.tables import contig_key, with_contig

#: What read groups have where nothing is given, and the first lines of a VCF file.
READ_GROUP_DEFAULTS = {"platform": "illumina", "lib": "lib1", "platform_unit": "unit1"}
VCF_META = ("##fileformat=VCFv4.1",)


def _or_star(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == ""), "*").otherwise(F.col(c))


def sam_line() -> Column:
    """A read as a SAM line; the mate's contig is ``=`` where it is the own one."""
    mate = F.when(F.col("mate_contig_name") == "=", "=").when(contig_key(F.col("mate_contig_name")) == contig_key(F.col("contig_name")), "=").otherwise(_or_star("mate_contig_name"))
    number = lambda c, none: F.coalesce(F.col(c), F.lit(none)).cast("string")
    fixed = [_or_star("read_name"), number("flag", 0), _or_star("contig_name"), number("contig_position", 0), number("map_q", 255), _or_star("cigar"), mate, number("mate_position", 0), number("inferred_size", 0), _or_star("seq"), _or_star("base_quals")]
    tags = F.filter(F.coalesce("attributes", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.concat_ws("\t", *fixed, F.when(F.size(tags) > 0, F.concat_ws("\t", tags)))


def format_qual(qual: Column) -> Column:
    """Two decimals without trailing zeros of a whole number; ``.`` for null."""
    return F.when(qual.isNull(), ".").otherwise(F.regexp_replace(F.format_string("%.2f", qual), r"\.00$", ""))


def format_double(x: Column) -> Column:
    """Two decimals from 1 on, three from 0.01, scientific below; 0 as 0.00."""
    size = F.abs(x)
    return F.when(size >= 1, F.format_string("%.2f", x)).when(size >= 0.01, F.format_string("%.3f", x)).when(size > 1e-20, F.format_string("%.3e", x)).otherwise("0.00")


def vcf_line(tail: str | None = "rest") -> Column:
    """A call as a VCF line; ``tail`` is the column with INFO and what follows it."""
    fixed = [_dot("contig_name"), F.col("contig_position").cast("string"), _dot("variant_id"), _dot("ref_allele"), _dot("alt"), format_qual(F.col("qual")), _dot("filters")]
    return F.concat_ws("\t", *fixed, _dot(tail) if tail else F.lit("."))


def _dot(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == ""), ".").otherwise(F.col(c))


def info_text(info: Column) -> Column:
    """A map as INFO text, keys in order; a key with a null value is a flag."""
    parts = F.transform(F.array_sort(F.map_entries(info)), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(info) > 0, F.concat_ws(";", parts)).otherwise(".")


def genotype_text(values: list[Column]) -> Column:
    """FORMAT values joined by ``:``; missing ones as ``.``, those at the end left out."""
    text = F.concat_ws(":", *(F.coalesce(v.cast("string"), F.lit(".")) for v in values))
    return F.regexp_replace(text, r"(?::\.)+$", "")


def fastq_text() -> Column:
    """A read as the four lines of a FASTQ record."""
    return F.concat(F.lit("@"), F.col("description"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("base_quals"))


def pair_columns() -> tuple[Column, Column]:
    """A pair of reads (read_name, seq1, quals1, seq2, quals2) as two FASTQ records."""
    record = lambda n: F.concat(F.lit("@"), F.col("read_name"), F.lit(f"/{n}\n"), F.col(f"seq{n}"), F.lit("\n+\n"), F.col(f"quals{n}"))
    return record(1), record(2)


def write_fastq_pairs(pairs: DataFrame, path: str, partitions: int | None = None, seed: int = 11) -> None:
    """Pairs as FASTQ text under ``path/1`` and ``path/2``: part n of one folder holds the mates of part n of the other, in the same order.

    Pairs are dealt by a hash of the name and sorted within their part, so both writes lay them out alike, however often they are evaluated.
    """
    first, second = pair_columns()
    n = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("read_name", first.alias("_1"), second.alias("_2")).repartition(n, F.xxhash64("read_name", F.lit(seed))).sortWithinPartitions("read_name", "_1", "_2")
    dealt.select(F.col("_1").alias("value")).write.mode("errorifexists").text(f"{path}/1")
    dealt.select(F.col("_2").alias("value")).write.mode("errorifexists").text(f"{path}/2")


def sam_header_lines(contigs: DataFrame, read_groups: DataFrame, is_sorted: bool = True, max_rows: int = 1_000_000) -> list[str]:
    """Header of a SAM file: a line per contig and read group, whose number doesn't grow with the reads of a file; too many are an error."""
    sq, rg = contigs.orderBy("contig_id").limit(max_rows + 1).collect(), read_groups.orderBy("read_group").limit(max_rows + 1).collect()
    if max(len(sq), len(rg)) > max_rows:
        raise ValueError(f"more than {max_rows} header lines")
    lines = [f"@HD\tVN:1.4\tSO:{'coordinate' if is_sorted else 'unsorted'}"] + [f"@SQ\tSN:{r.contig_name}\tLN:{r.contig_length}" for r in sq]
    value = lambda r, k: r[k] or READ_GROUP_DEFAULTS[k]
    return lines + [f"@RG\tID:{r.read_group}\tSM:{r.sample_name}\tPL:{value(r, 'platform')}\tLB:{value(r, 'lib')}\tPU:{value(r, 'platform_unit')}" for r in rg]


def vcf_header_lines(contigs: DataFrame, samples: list[str] = (), max_rows: int = 1_000_000) -> list[str]:
    rows = contigs.orderBy("contig_id").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} contigs")
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return [*VCF_META, *(f"##contig=<ID={r.contig_name},length={r.contig_length}>" for r in rows), "\t".join(columns)]


def write_sorted(rows: DataFrame, contigs: DataFrame, line: Column, header: list[str], path: str, partitions: int | None = None) -> None:
    """Text files in coordinate order across files: ranges of (contig, position), the header at the begin of the first; unplaced rows last."""
    spark = rows.sparkSession
    coded = with_contig(rows, contigs, "contig_name", "contig_id" if "contig_id" in rows.columns else None, out="_c", code="_code")
    body = coded.select(F.coalesce("_code", F.lit(1 << 30)).alias("_code"), F.coalesce(F.col("contig_position").cast("bigint"), F.lit(0)).alias("_at"), F.xxhash64(line).alias("_tie"), line.alias("value"))
    top = spark.createDataFrame([(-1, i, 0, x) for i, x in enumerate(header)], "_code int, _at bigint, _tie bigint, value string")
    both = top.unionByName(body)
    ranged = both.repartitionByRange(partitions, "_code", "_at", "_tie") if partitions else both.repartitionByRange("_code", "_at", "_tie")
    ranged.sortWithinPartitions("_code", "_at", "_tie").select("value").write.mode("errorifexists").text(path)


__all__ = ["fastq_text", "format_double", "format_qual", "genotype_text", "info_text", "sam_header_lines", "sam_line", "vcf_header_lines", "vcf_line", "write_sorted"]
