"""Job entry points: run a query or a group of them over a folder of tables and write what they give.

    python -m siftlake.jobs <folder> <out> <name or group> [...]

Groups name the drivers of the suite, the frontier, the ablations, the external
evaluation and the label audit; ``models`` runs the suite's queries once for
each model of a list and writes them partitioned by model.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import claims as K
from siftlake.sources.tables import Versions, environment, markdown

GROUPS = {
    "suite": ["r15_r16_hit_vectors", "a4_u12_rates_with_intervals", "u9_u12_contrasts", "u7_u12_holm_within_model", "u5_u6_equivalence", "u10_absolute_only"],
    "frontier": ["u13_frontier_vs_first_level", "w5_u13_inflection", "u14_w6_evidence_tiers", "u15_drift_audit", "d7_ladder_violations"],
    "ablation": ["r21_r23_ablation_sweep", "r7_r23_ablation_permissive", "r24_dropped_tokens_by_blend", "r26_r27_substitution_levels", "x1_decay_contrasts"],
    "crosslingual": ["r17_x3_tracks"],
    "external": ["r18_p34_external_evaluation", "r18_representative_failures", "x4_failure_counts"],
    "exposure": ["a17_p35_exposure_matrix", "a17_best_operating_point", "a18_exposure_diagonal", "j15_a17_actionable_frontier"],
    "audit": ["a9_label_space", "a10_reused_codes", "a11_stub_audit", "a12_term_coverage", "g11_label_defects"],
    "candidates": ["j7_j8_jaccard_candidates", "j7_cross_source_twins", "p28_structural_codes", "p29_successor_codes"],
    "emit": ["g12_equivalence_doc", "g12_queries_v2", "j9_t5_equivalent_labels", "s17_merge_slices", "g14_curated_set"],
    "recall": ["u16_recall_by_label_view", "j11_u17_a20_label_sensitivity"],
    "gates": ["g1_gate_independence", "g3_threshold_calibration", "g5_t4_gate_verdict", "g6_audit_assembly", "g7_slice_failures", "g8_shard_checks", "g9_g10_bundle_validation", "g13_claims", "g13_claims_over_results"],
    "stats": ["u2_u4_clopper_pearson", "u3_mcnemar", "u7_w4_holm", "u8_permutation", "u11_boundary", "u18_robustness_by_model", "u19_version_impact", "u20_summary"],
}


def names(wanted: list[str]) -> list[str]:
    """Queries of the groups and names, each once, in their order; ``all`` is every group."""
    from siftlake.plans.registry import QUERIES

    out: list[str] = []
    for w in wanted:
        for name in sum(GROUPS.values(), []) if w == "all" else GROUPS.get(w, [w]):
            if name not in QUERIES:
                raise ValueError(f"no query or group is called {name}")
            if name not in out:
                out.append(name)
    return out


def run(spark: SparkSession, folder: str, out: str, wanted: list[str], report: bool = False) -> list[str]:
    """Writes each query's rows to out/name as Parquet, and if asked for a Markdown text beside it, which of more than 1,000 rows only says where they are; returns the names."""
    from siftlake.plans.registry import QUERIES

    done = names(wanted)
    for name in done:
        rows: DataFrame = QUERIES[name](spark, folder)
        rows.write.mode("overwrite").parquet(f"{out}/{name}")
        kept = spark.read.parquet(f"{out}/{name}")
        if report:
            small = kept.limit(1001).count() <= 1000
            text = markdown(kept, name) if small else f"# {name}\n\nOver 1,000 rows: they are in {out}/{name}."
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}.md")
    environment(spark, queries=done, folder=folder).coalesce(1).write.mode("overwrite").json(f"{out}/environment")
    return done


def assembled(spark: SparkSession, out: str, wanted: list[str]) -> DataFrame:
    """(query, row as JSON) of results written before: one table of all statistics."""
    all_rows: DataFrame | None = None
    for name in names(wanted):
        part = spark.read.parquet(f"{out}/{name}")
        part = part.select(F.lit(name).alias("query"), F.to_json(F.struct(*part.columns)).alias("row"))
        all_rows = part if all_rows is None else all_rows.union(part)
    if all_rows is None:
        raise ValueError("nothing to put together")
    return all_rows


def verify(spark: SparkSession, out: str, registry: str, update: bool = False) -> dict[str, int]:
    """Checks the claims of a registry (a folder of versions) against the summary written before; returns how many have each status.

    The checked claims go to out/claims.  With update, what was found becomes the
    registry's next version; the version before can be read and reverted to.
    """
    versions = Versions(spark, registry)
    last = versions.latest()
    if last is None:
        raise ValueError(f"{registry} holds no claims")
    K.check(versions.read(step=last["step"]), spark.read.parquet(f"{out}/u20_summary")).write.mode("overwrite").parquet(f"{out}/claims")
    checked = spark.read.parquet(f"{out}/claims")
    if update:
        renewed = K.updated(checked)
        versions.adopt(renewed.drop("status"), f"claims-{last['step'] + 1}", after=last["step"])
        checked = renewed
    return {r.status: r["count"] for r in checked.groupBy("status").count().collect()}


def run_models(spark: SparkSession, folder: str, out: str, models: list[str]) -> dict[str, str | None]:
    """The hit vectors of each model to out/model=..., one job each; a model that fails is reported with its error and stops no other."""
    from siftlake.plans.registry import QUERIES

    said: dict[str, str | None] = {}
    for model in models:
        try:
            rows = QUERIES["r15_r16_hit_vectors"](spark, folder).filter(F.col("model") == model)
            if rows.isEmpty():
                raise LookupError("no such model")
            rows.drop("model").write.mode("overwrite").parquet(f"{out}/model={model}")
            said[model] = None
        except Exception as e:  # reported, not hidden: the others go on
            said[model] = f"{type(e).__name__}: {e}"
    return said


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siftlake.jobs")
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("wanted", nargs="+", metavar="name", help="queries or groups: " + ", ".join([*GROUPS, "all"]))
    p.add_argument("--report", action="store_true", help="Markdown beside the rows")
    p.add_argument("--claims", help="folder of a registry of claims, checked against the summary (u20_summary, which must be run or be there)")
    p.add_argument("--update", action="store_true", help="what is found becomes what the registry claims")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("siftlake").getOrCreate()
    print("\n".join(run(spark, a.folder, a.out, a.wanted, a.report)))
    if a.claims:
        said = verify(spark, a.out, a.claims, a.update)
        print(" ".join(f"{k}={v}" for k, v in sorted(said.items())))
        if said.get("MISMATCH") or said.get("ERROR"):
            raise SystemExit(1)


if __name__ == "__main__":
    main()
