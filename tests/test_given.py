"""Queries against their SQL on a table whose last plane, alone in its layer of bricks, isn't whole."""

import duckdb
import pytest
from test_answers import SQL, _key

from voxelbrick.plans import registry

NAMES = "p6_transpose p8_uint16 a4_report a5_value_percentiles e2_information r3_coarse r3_field r4_composed r4_one_pass r5_nearest s7_stack s8_tiff_pages s9_tiff_planes t6_blend w4_center_slices w5_overlay x6_seams j2_tiles_of_bricks w7_stacked j1_placed x5_report".split()


@pytest.fixture(scope="module")
def ragged(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ragged")
    con = duckdb.connect()
    con.execute(f"copy (from '{sf}/embeddings.parquet' where vec_id < 406) to '{folder}/embeddings.parquet' (format parquet)")
    con.execute(f"create view embeddings as from '{folder}/embeddings.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_last_plane_not_whole(name, spark, ragged):
    folder, con = ragged
    got = registry.queries()[name](spark, folder)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = sorted(map(_key, cur.fetchall()))
    assert sorted(_key([r[c] for c in columns]) for r in got.collect()) == want


@pytest.fixture(scope="module")
def holed(sf, tmp_path_factory):
    """Without a layer of bricks in the middle, and without a seventh of the other vectors."""
    folder = tmp_path_factory.mktemp("holed")
    con = duckdb.connect()
    con.execute(f"copy (from '{sf}/embeddings.parquet' where vec_id < 486 and vec_id not between 190 and 405 and vec_id % 7 <> 3) to '{folder}/embeddings.parquet' (format parquet)")
    con.execute(f"create view embeddings as from '{folder}/embeddings.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", "a5_value_percentiles e2_information p6_transpose p8_uint16 r3_coarse s7_stack s8_tiff_pages s9_tiff_planes t6_blend".split())
def test_vectors_missing_between(name, spark, holed):
    test_last_plane_not_whole(name, spark, holed)


@pytest.fixture(scope="module")
def gapped(sf, tmp_path_factory):
    """Users in two far groups, a fourth cycle, one cycle without its fixed channel, and events without a value."""
    folder = tmp_path_factory.mktemp("gapped")
    con = duckdb.connect()
    con.execute(f"create table e as from '{sf}/events.parquet'")
    con.execute("create table more as from e union all select event_id + 1000, ts + interval 13 day, user_id + 400, event_type, case when event_id % 5 > 0 then value * 1.5 end, props from e where event_id % 3 > 0")
    con.execute(f"copy (from more where event_type <> 'click' or date_diff('day', timestamp '2024-01-01', ts) not between 10 and 19) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as from '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", "a1_ncc a2_nrmse a3_nmi".split())
def test_users_and_cycles_far_apart(name, spark, gapped):
    test_last_plane_not_whole(name, spark, gapped)
