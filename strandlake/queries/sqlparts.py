"""Pieces of the oracle SQL that several queries share."""

from __future__ import annotations


def contig_key(column: str = "contig_name") -> str:
    bare = rf"regexp_replace(regexp_replace({column}, '^\s+|\s+$', '', 'g'), '^[cC][hH][rR]', '')"
    return f"CASE WHEN {bare} = 'M' THEN 'MT' WHEN {bare} IN ('', '*') THEN NULL ELSE {bare} END"


def contigs() -> str:
    """CTE body: (ckey, cname, cid, clen), one row per unified name."""
    return f"SELECT {contig_key()} AS ckey, contig_name AS cname, contig_id AS cid, contig_length AS clen FROM contigs"


def cigar_sum(ops: str, column: str = "cigar") -> str:
    return rf"coalesce(list_sum(list_transform(regexp_extract_all({column}, '(\d+)[{ops}]', 1), lambda x: CAST(x AS BIGINT))), 0)"
