"""Headline timings as one JSON line. Staged tables are rebuilt here and timed as their own
entries, so every query below them is measured on warm inputs and nothing is hidden."""

from __future__ import annotations

import json
import os
import time


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from runloom.session import get_session
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from runloom.plans import dataset as D
    from runloom.plans.adapter import staged_steps
    from runloom.plans.catalog import all_queries
    stages = {
        "stage_steps": staged_steps, "stage_signatures": D.sig_steps, "stage_merge": D.mapping,
        "stage_reference": D.ref_states, "stage_paths": D.reference_rows, "stage_hits": D.hits, "match_run": D.metrics,
        "quality_report": D.reports, "waste_flags": D.flags, "cyclic_patterns": D.cycles, "annotations": D.annotations}
    times: dict[str, float] = {}
    for name, fn in stages.items():
        t = time.time()
        fn(spark, sf_dir)
        times[name] = round(time.time() - t, 3)
    queries = all_queries()
    for name in ("label_intent", "coherence", "temporal_profile", "workflow_similarity", "profile", "equivalence_join",
                 "rank_in_cohort", "auroc", "curation_table", "tfidf_vectors", "soft_match_f1", "read_chatlog", "read_atif"):
        t = time.time()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    build = sum(times[n] for n in stages)
    # The published baseline starts from parsed runs; normalising them is timed apart.
    from_parsed = build - times["stage_steps"]
    assessed = D.reports(spark, sf_dir).count()
    print(json.dumps({"metric": "runloom_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "trajectories_assessed": assessed,
                      "build_sec": round(build, 3), "trajectories_per_sec": round(assessed / from_parsed, 2),
                      "trajectories_per_sec_with_parsing": round(assessed / build, 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
