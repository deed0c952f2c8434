"""One surviving record for each group of duplicate reads, built field by field.

Records of a group are ranked by trust: the most complete, then the higher mapping quality, the later load, the smaller id. The
first is the leader, and no choice can displace it; a field it lacks comes from the next best record. Fields that depend on each other
form a bundle: bases and base qualities have one length, which the leader's CIGAR fixes, and come from one record unless the leader has one
of them. A branch-and-bound search chooses a source for each bundle: the most fields filled, and of equals the most trusted records, compared
as whole numbers one after the other, with no dependency broken.

No group is gathered. A first aggregate (partial before the shuffle) keeps the best record of each profile: the fields that a record has, and their
lengths. A second one gives each group its leader and the best record of each field that stands alone. Only where the leader lacks bases or qualities are further records asked: those with the length that the leader demands, the best
of each of three classes (bases fit, qualities fit, both), found by a join and a third aggregate. The search sees at most seven
records, however many a group has and however their lengths vary.

Defined results: fields are missing if null, empty, ``*`` or a mapping quality of 255; missing qualities and load times rank last;
equal ranks go to the smaller id; repeated rows (also of one id) are records of the group; groups of one have no row; a null sample or
contig, if records have one, is a value like any other; an empty table yields no rows; other columns are ignored. Of rows that share an id the
survivor takes the values of the best ranked.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.session import staged
from strandlake.tables import FLAG_REVERSE, contig_key, with_contig, with_sample

#: Fixed value: unmapped, secondary, duplicate and supplementary records take no part.
EXCLUDED_FLAGS = 3332
KEYS = ["sample", "contig", "is_reverse", "five_prime", "mate_contig", "mate_at"]
FIELDS = ["map_q", "seq", "base_quals", "inferred_size", "attributes"]
_CHOSEN = "group_id bigint, keep_id bigint, n_records bigint, " + ", ".join(f"{f}_from bigint" for f in FIELDS)


def _text(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin("", "*")


def _presence() -> tuple[Column, Column, dict[str, Column]]:
    """(how many fields a record has, if its mapping quality is one, which fields it has)."""
    has_quality = F.col("map_q").isNotNull() & (F.col("map_q") != 255)
    has = {"map_q": has_quality, "seq": _text("seq"), "base_quals": _text("base_quals"), "inferred_size": F.col("inferred_size").isNotNull(), "attributes": F.coalesce(F.size("attributes"), F.lit(0)) > 0}
    return sum((x.cast("int") for x in has.values()), F.lit(0)), has_quality, has


def fragment_ends(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """The participating reads with the keys of their fragment end, their profile and their rank."""
    part = reads.where((F.col("flag").bitwiseAND(EXCLUDED_FLAGS) == 0) & (F.col("contig_position") >= 1) & C.has_cigar(F.col("cigar")) & F.col("read_group").isNotNull())
    named = with_sample(with_contig(part, contigs, "contig_name", "contig_id", out="_contig"), read_groups, out="_sample")
    cigar, start = F.col("cigar"), F.col("contig_position").cast("bigint")
    reverse = F.col("flag").bitwiseAND(FLAG_REVERSE) != 0
    five = F.when(reverse, start + C.reference_length(cigar) - 1 + C.trailing_clip(cigar)).otherwise(start - C.leading_clip(cigar))
    own = F.coalesce(F.col("_contig"), contig_key(F.col("contig_name")))
    mate = F.when(F.trim("mate_contig_name") == "=", contig_key(own)).otherwise(contig_key(F.col("mate_contig_name")))
    complete, has_quality, has = _presence()
    return named.select(
        F.col("_sample").alias("sample"),
        own.alias("contig"),
        reverse.alias("is_reverse"),
        five.alias("five_prime"),
        mate.alias("mate_contig"),
        F.when(mate.isNotNull(), F.col("mate_position").cast("bigint")).alias("mate_at"),
        F.struct(
            C.read_length(cigar).alias("read_length"),
            F.when(has["seq"], F.length("seq")).alias("seq"),
            F.when(has["base_quals"], F.length("base_quals")).alias("base_quals"),
            has["map_q"].alias("map_q"),
            has["inferred_size"].alias("inferred_size"),
            has["attributes"].alias("attributes"),
        ).alias("profile"),
        F.struct(complete.alias("complete"), F.when(has_quality, F.col("map_q")).alias("map_q"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded"), (-F.col("record_id")).alias("minus_id")).alias("rank"),
    )


def _order(rank: dict) -> tuple:
    low = float("-inf")
    return tuple(low if rank[k] is None else rank[k] for k in ("complete", "map_q", "loaded", "minus_id"))


def branch_and_bound(bundles: list[list[tuple[tuple[int, int], dict]]], allowed) -> list[dict]:
    """One option of each bundle, with the largest gain among the choices that ``allowed`` accepts.

    bundles: for each, its options (gain, values), the best first. A gain is (fields filled, minus the places of their records): the gains
    of bundles add up and sums are compared in that order, in whole numbers. ``allowed(chosen, values)`` says if an option agrees with those
    chosen so far. A branch is cut where even the best options of all bundles to come can't beat what was found.
    """
    add = lambda x, y: (x[0] + y[0], x[1] + y[1])
    rest = [(0, 0)] * (len(bundles) + 1)
    for i in range(len(bundles) - 1, -1, -1):
        rest[i] = add(rest[i + 1], bundles[i][0][0])
    best: list = [None, []]

    def descend(i: int, gain: tuple[int, int], chosen: list[dict]) -> None:
        if i == len(bundles):
            if best[0] is None or gain > best[0]:
                best[:] = [gain, chosen]
            return
        for more, values in bundles[i]:
            if best[0] is not None and add(add(gain, more), rest[i + 1]) <= best[0]:
                break
            if allowed(chosen, values):
                descend(i + 1, add(gain, more), [*chosen, values])

    descend(0, (0, 0), [])
    return best[1]


def choose_sources(profiles: list[dict]) -> dict:
    """Which record each field of a group's survivor comes from. profiles: records with ``rank`` and ``profile``; the best ranked is the leader."""
    ranked = sorted(profiles, key=lambda p: _order(p["rank"]), reverse=True)
    ids = [-p["rank"]["minus_id"] for p in ranked]
    looks = [p["profile"] for p in ranked]
    leader = looks[0]
    length = leader["read_length"]

    def single(field: str) -> list[tuple[tuple[int, int], dict]]:
        options = [((1, -i), {field: i}) for i, p in enumerate(looks) if p[field]]
        return [*options[:1], ((0, 0), {field: None})]

    bases = {}
    for i, p in enumerate(looks):
        for seq, quals in ((i, i), (i, None), (None, i), (None, None)):
            # What the leader holds is kept as it is; what is filled must agree with it.
            pick = {"seq": 0 if leader["seq"] is not None else seq, "base_quals": 0 if leader["base_quals"] is not None else quals}
            if all(s is None or looks[s][f] is not None for f, s in pick.items()):
                used = [s for s in pick.values() if s is not None]
                bases[tuple(pick.values())] = ((len(used), -sum(used)), pick)

    def allowed(chosen: list[dict], values: dict) -> bool:
        if "seq" not in values:
            return True
        seq, quals = values["seq"], values["base_quals"]
        if seq not in (0, None) and looks[seq]["seq"] != length or quals not in (0, None) and seq is None and looks[quals]["base_quals"] != length:
            return False
        return seq is None or quals is None or seq == quals == 0 or looks[seq]["seq"] == looks[quals]["base_quals"]

    options = [sorted(bases.values(), key=lambda x: x[0], reverse=True), *(single(f) for f in ("map_q", "inferred_size", "attributes"))]
    source = {k: v for values in branch_and_bound(options, allowed) for k, v in values.items()}
    return {"keep_id": ids[0]} | {f"{f}_from": None if source[f] is None else ids[source[f]] for f in FIELDS}


def _search(batches):
    names = ["group_id", "keep_id", "n_records", *(f"{f}_from" for f in FIELDS)]
    schema = pa.schema([(n, pa.int64()) for n in names])
    for batch in batches:
        rows = [{"group_id": r["group_id"], "n_records": r["n_records"]} | choose_sources([p for p in r["profiles"] if p is not None]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in names], schema=schema)


def _candidates(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row per group of two or more: (keys, n_records, group_id, profiles), the profiles those that a best choice can use, null where there is none."""
    ends = fragment_ends(reads, read_groups, contigs)
    # Records of one profile (fields present, and their lengths) can stand in for each other, so the best of each is enough for all that follows.
    best_of = ends.groupBy(*KEYS, "profile").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.max("rank.minus_id").alias("minus_min"))
    best_of = staged(best_of, "read-profiles")  # read twice
    record = F.struct("rank", "profile")
    alone = [F.max(F.when(F.col(f"profile.{f}"), record)).alias(f"_{f}") for f in ("map_q", "inferred_size", "attributes")]
    groups = best_of.groupBy(*KEYS).agg(F.sum("n").alias("n_records"), (-F.max("minus_min")).alias("group_id"), F.max(record).alias("_leader"), *alone).where("n_records > 1")
    groups = staged(groups, "duplicate-groups")  # read twice
    seq, quals = F.col("_leader.profile.seq"), F.col("_leader.profile.base_quals")
    wanted = groups.where(seq.isNull() | quals.isNull()).select(
        *(F.col(k).alias(f"_k_{k}") for k in KEYS),
        # The length that bases, and that qualities, must have to stand beside what the leader holds; null where the leader has its own.
        F.when(seq.isNull(), F.when(quals.isNull() | (quals == F.col("_leader.profile.read_length")), F.col("_leader.profile.read_length"))).alias("_seq_length"),
        F.when(quals.isNull(), F.coalesce(seq, F.col("_leader.profile.read_length"))).alias("_quals_length"),
    )
    others = best_of.where(F.col("profile.seq").isNotNull() | F.col("profile.base_quals").isNotNull()).select(*KEYS, F.col("profile.seq").alias("_seq"), F.col("profile.base_quals").alias("_quals"), record.alias("_record"))
    joined = others.join(wanted, [others[k].eqNullSafe(wanted[f"_k_{k}"]) for k in KEYS])
    seq_fits, quals_fit = (F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in (("_seq", "_seq_length"), ("_quals", "_quals_length")))
    classes = {"_both": seq_fits & quals_fit, "_seq_only": seq_fits, "_quals_only": quals_fit}
    best = joined.where(seq_fits | quals_fit).groupBy(*wanted.columns[: len(KEYS)]).agg(*(F.max(F.when(c, F.col("_record"))).alias(n) for n, c in classes.items()))
    found = groups.join(best, [groups[k].eqNullSafe(best[f"_k_{k}"]) for k in KEYS], "left")
    return found.select("group_id", "n_records", F.array_distinct(F.array("_leader", *(f"_{f}" for f in ("map_q", "inferred_size", "attributes")), *classes)).alias("profiles"))


def survivor_sources(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row per group of two or more: its smallest id, the leader, its size, and the record that each field comes from."""
    return _candidates(reads, read_groups, contigs).mapInArrow(_search, _CHOSEN)


def survivors(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """The surviving records: (group_id, keep_id, n_records) and the fields as chosen, null where no record of the group has them."""
    chosen = survivor_sources(reads, read_groups, contigs)
    wanted = chosen.select("group_id", "keep_id", "n_records", F.inline(F.array(*(F.struct(F.lit(f).alias("_field"), F.coalesce(F.col(f"{f}_from"), F.col("keep_id")).alias("_source"), F.col(f"{f}_from").isNotNull().alias("_has")) for f in FIELDS))))
    wanted = wanted.groupBy("group_id", "keep_id", "n_records", "_source").agg(F.collect_set(F.when(F.col("_has"), F.col("_field"))).alias("_fields"))
    complete, has_quality, _ = _presence()
    trust = F.struct(complete, F.when(has_quality, F.col("map_q")), F.col("loaded_at"), *FIELDS)
    values = reads.groupBy("record_id").agg(F.max_by(F.struct(*FIELDS), trust).alias("_v")).select("record_id", "_v.*")
    joined = wanted.join(values, wanted["_source"] == values["record_id"])
    picked = [F.max(F.when(F.array_contains("_fields", f), F.col(f))).alias(f) for f in FIELDS]
    return joined.groupBy("group_id", "keep_id", "n_records").agg(*picked)
