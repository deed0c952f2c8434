"""The germline path as a plan: remove duplicates, realign, recalibrate, cut reads, find active regions, call. Each stage's output is read by a later one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.operators import calling, clipping, dedup, pileup, realignment, recal, reference, regions
from strandlake.plans.stages import Plan, Stage
from strandlake.session import staged

INPUTS = ("reads", "read_groups", "contigs", "variants")
_PLACES = ("read_groups", "contigs")


def germline(spark: SparkSession, tables: dict[str, DataFrame], threshold: int = 10_000) -> Plan:
    """A plan over reads, read_groups, contigs and variants (known sites). A reference may be given as ``reference`` slices; else it is the consensus of the unique reads."""
    plan = Plan(spark, tables)

    def stage(name: str, inputs: tuple[str, ...], output: str, run, keep: bool = False) -> None:
        plan.add(Stage(name, inputs, (output,), (lambda *t: staged(run(*t), name.replace("_", "-"))) if keep else run, fusible=not keep, detached=keep, staged=keep))

    stage("remove_duplicates", ("reads", *_PLACES), "unique_reads", lambda r, g, c: dedup.deduplicated(r, g, c).select(*r.columns), keep=True)
    if "reference" not in tables:
        stage("take_consensus", ("unique_reads", *_PLACES), "reference", lambda r, g, c: reference.read_slices(pileup.read_rows(r, g, c)), keep=True)
    stage("find_targets", ("unique_reads", *_PLACES, "variants"), "targets", lambda r, g, c, v: regions.targets(regions.indel_events(pileup.indels(pileup.read_rows(r, g, c)), v)), keep=True)
    stage("realign", ("targets", "unique_reads", *_PLACES, "reference", "variants"), "moves", realignment.realigned, keep=True)
    stage("move_reads", ("unique_reads", "moves", "read_groups"), "realigned_reads", lambda r, m, g: realignment.with_mates_fixed(realignment.with_moves(r, m), m, g), keep=True)
    stage("find_known_sites", ("variants",), "known_sites", recal.known_sites)
    stage("meet_reference", ("realigned_reads", *_PLACES, "reference", "known_sites"), "reads_on_reference", recal.reads_on_reference)
    stage("count_covariates", ("reads_on_reference",), "recal_counts", recal.counted, keep=True)
    stage("estimate_qualities", ("recal_counts",), "recal_tables", lambda n: recal.with_empirical(recal.tables(n)), keep=True)
    stage("recalibrate", ("realigned_reads", "recal_tables"), "recalibrated_reads", lambda r, t: recal.recalibrated(r, t).drop("old_quals"), keep=True)
    stage("place_reads", ("recalibrated_reads", *_PLACES), "placed_reads", pileup.read_rows)
    stage("score_activity", ("placed_reads", "reference"), "activity", lambda p, r: regions.activity_on(p, r, reference.SLICE), keep=True)
    stage("cut_regions", ("activity",), "regions", lambda a: regions.active_runs(a, threshold), keep=True)
    stage("cut_reads", ("recalibrated_reads", *_PLACES), "calling_reads", clipping.ready_for_calling, keep=True)
    stage("gather_regions", ("regions", "calling_reads", *_PLACES, "reference"), "region_groups", calling.region_groups)
    plan.add(Stage("call", ("region_groups",), ("calls",), calling.called, fusible=False, detached=True))
    return plan
