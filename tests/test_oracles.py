"""Spark against SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from strandlake.plans.catalogue import QUERIES
from strandlake.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = "part customer orders lineitem events embeddings".split()
SOME = """voxel_degree endpoint_voxels prune_spurs border_shell_labelled six_faces median3 gaussian3d branch_components label_components
component_label_class rung_severed fragment_endpoints nematic_tensor endpoint_pairs bridge_candidates bridge_costs diffuse_flood diffuse_nearest
prune_repropagate panoptic_metrics consensus_matches stitched_labels border_split densify resample_unit inbox_runs through_curves knn8_periodic
crossing_dip spine_points projected_points overlap_add gad_points natural_sort triplet_join""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(repr(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(repr(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(rel.columns) == cols
    assert got == want
