from pyspark.sql import functions as F

from runloom.plans import dataset as D
from runloom.plans import studies as S


def test_hits_of_a_study_are_a_table_scan(spark, sf, monkeypatch):
    """``spread`` counts the splits of what it gets, which runs the joins of a plan that is not a scan."""
    seen = []
    monkeypatch.setattr(S, "spread", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    cell = {"k": F.lit(3), "draw_id": F.lit(0), "perm_id": F.lit(0)}
    g = {"states": D.ref_states(spark, sf), "paths": D.ref_paths(spark, sf), "mapping": D.mapping(spark, sf)}
    got = S.assessed(spark, sf, "test_studies", {n: t.withColumns(cell) for n, t in g.items()}, D.candidates(spark, sf), D.runs(spark, sf))
    assert len(seen) == 1 and "Join" not in seen[0] and "Aggregate" not in seen[0]
    same = ["trajectory_id", "matched_count", "best_path", "f1_score"]
    assert sorted(got.select(*same).collect()) == sorted(D.metrics(spark, sf).select(*same).collect())
