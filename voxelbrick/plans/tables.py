"""Queries on catalogs, slices, regions, tiles, sources, manifests and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelbrick.functions import parse
from voxelbrick.operators import catalog as C
from voxelbrick.operators import manifest as M
from voxelbrick.operators import tiling
from voxelbrick.sources import fixtures as X

table = X.table

# ---------------------------------------------------------------- sources


def _datasets(spark, sf_dir):
    c = X.catalog(spark, sf_dir)
    shape = F.when(F.col("owner") % 7 == 0, F.array("nz", "ny")).otherwise(F.array("nz", "ny", "nx"))
    sp = F.array(*[F.lit(s) for s in (0.711, 0.711, 1.5)])
    override = F.when(F.col("owner") % 3 == 0, F.array(F.lit(2.0), F.lit(2.0), F.lit(4.0)))
    return c.select("path", F.when(F.col("owner") % 2 == 0, F.replace("dataset_key", F.lit("/"), F.lit("\\"))).otherwise(F.col("dataset_key")).alias("dataset_key"), shape.alias("shape"), sp.alias("spacing"), override.alias("override"))


def s1_catalog(spark, sf_dir):
    return C.build_catalog(_datasets(spark, sf_dir))


def s2_dataset_key(spark, sf_dir):
    k = parse.parse_dataset_key(F.col("dataset_key"))
    bad = F.when(F.col("owner") % 5 == 0, F.concat("dataset_key", F.lit("/Histogram"))).otherwise(F.replace("dataset_key", F.lit("/"), F.lit("\\")))
    d = X.catalog(spark, sf_dir).select("path", F.col("level").alias("want"), bad.alias("dataset_key"))
    return d.select("path", "want", k["level"].alias("level"), k["timepoint"].alias("timepoint"), k["channel"].alias("channel"))


def s2_levels(spark, sf_dir):
    return C.levels(X.catalog(spark, sf_dir), ["path"])


def s3_discover(spark, sf_dir):
    c = X.catalog(spark, sf_dir).select("owner", "dataset_key", (F.col("nz").cast("long") * F.col("ny") * F.col("nx")).alias("size"))
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    r = r.select((F.col("owner") * 10 + F.col("level")).alias("request_id"), "owner", "level", F.lit(0).alias("timepoint"), (F.col("owner") % 3).alias("channel"))
    return C.discover_dataset(c, r)


def s4_spacing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"), F.col("p_retailprice").cast("double").alias("hi"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")).alias("lo"))
    return p.select("p_partkey", F.round(parse.spacing_from_extents(F.col("lo"), F.col("hi"), F.col("n")), 6).alias("spacing"))


def s5_slices(spark, sf_dir):
    return C.discover_slices(X.slices(spark, sf_dir)).select("dir", "file", "dir_index", "z")


def s6_validate(spark, sf_dir):
    """Folders of slices: one has another shape throughout, files whose name ends in 7 another sample type."""
    f = X.slices(spark, sf_dir)
    f = f.withColumn("shape", F.when(F.col("dir").contains("555"), "100,200").otherwise("100,300")).withColumn("dtype", F.when(F.col("file").like("%7.tif"), "u1").otherwise("u2"))
    return C.validate_slices(f)


def s10_bricks(spark, sf_dir):
    """Bricks written as Parquet and read again, one channel pruned by its folder."""
    from voxelbrick.operators import bricks as B
    from voxelbrick.sources.scratch import folder

    e = X.vox_evt(spark, sf_dir)
    shape = B.shape_of(e)
    b = B.to_bricks(e.select(F.col("cycle").cast("string").alias("volume_id"), "channel", "z", "y", "x", "v"), shape, (10, 64, 24))
    B.write_bricks(b, path := folder(spark, "bricks"))
    back = B.read_bricks(spark, path).where("channel = 2")
    return B.to_voxels(back, zeros=False).select(F.col("volume_id").cast("int").alias("cycle"), "z", "y", "x", "v")


def s12_roi_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("int").alias("a"), F.col("l_suppkey").cast("int").alias("b"), F.col("l_quantity").cast("int").alias("q"))
    s = lambda c: F.col(c).cast("string")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.format_string('{"x0":%d,"y0":%d,"z0":0,"x1":%d,"y1":%d,"z1":%d}', "a", "b", F.col("a") + F.col("q"), F.col("b") + F.col("q") - 3, "q"))
    text = text.when(F.col("l_linenumber") % 3 == 1, F.format_string('{"x":%d,"y":%d,"z":1,"size_x":%d,"size_y":5,"size_z":2}', "a", "b", "q"))
    text = text.otherwise(F.concat(s("a"), F.lit(", "), s("b"), F.lit(",0,"), s("b"), F.lit(","), s("a"), F.lit(", 9")))
    r = parse.parse_roi(F.col("roi"))
    out = li.withColumn("roi", text)
    return out.select("l_orderkey", "l_linenumber", *[r[c].alias(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1")])


def s13_manifest(spark, sf_dir):
    """Rows to JSON texts and back, registered_tif before registered, volume files only."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").cast("int").alias("channel"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".json").otherwise(".nrrd")).alias("registered"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.lit(".TIF"))).alias("registered_tif"), F.col("o_totalprice").cast("double").alias("elapsed_seconds"))
    return M.read_manifest(M.write_manifest(o, "run"), "run")


def s14_metrics_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.groupBy(F.col("event_type").alias("channel"), F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("phase")).agg(F.round(F.avg("value"), 6).alias("ncc"), F.round(F.max("value"), 6).alias("nmi"), F.round(F.min("value"), 6).alias("nrmse"))
    return M.metrics_summary(m, ["channel"])


# ---------------------------------------------------------------- regions and parsing


def _boxes(spark, sf_dir):
    return M.roi_union(X.roi_pts(spark, sf_dir))


_BOXC = ("x0", "x1", "y0", "y1", "z0", "z1")


def a9_roi_bbox(spark, sf_dir):
    b = M.roi_bbox(X.roi_pts(spark, sf_dir), 1568)
    return b.select("roi_id", *[F.col(c).cast("int").alias(c) for c in _BOXC], "empty")


def a10_roi_union(spark, sf_dir):
    p = X.roi_pts(spark, sf_dir).withColumn("slice", F.when(F.col("roi_id") % 4 != 0, F.col("slice") - 1))
    return M.roi_union(p, (3, 9)).select("roi_id", *[F.col(c).cast("int").alias(c) for c in _BOXC])


def p2_bounds(spark, sf_dir):
    return M.check_bounds(_boxes(spark, sf_dir), 5, 80, 1500).select("roi_id", "out_of_bounds", "empty_box", "starts_at_zero")


def p3_z_range(spark, sf_dir):
    t = F.concat(F.col("l_linenumber").cast("string"), F.lit(" ,"), (F.col("l_suppkey") % 9).cast("string"))
    z = parse.z_range(t)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", z["z0"].alias("z0"), F.coalesce(z["z1"], F.lit(1568)).alias("z1"))


def p10_channels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"))
    t = F.concat(F.col("s").cast("string"), F.lit("-"), (F.col("p_partkey") % 60).cast("string"), F.lit(", 2,0 ,"), (F.col("s") % 3).cast("string"))
    return p.select("p_partkey", F.explode(parse.parse_channels(t)).alias("channel"))


def p11_spacing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.col("p_partkey").cast("string").alias("k"))
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat("s", F.lit(".5"))).when(F.col("p_partkey") % 3 == 1, F.concat("s", F.lit(" , "), "k", F.lit(",2.25"))).otherwise(F.concat("s", F.lit(",-1"), "k"))
    sp, tr = parse.parse_spacing(t), parse.parse_triplet(F.concat("s", F.lit(",0,"), "k"), 0)
    return p.select("p_partkey", *[sp[i].alias(c) for i, c in enumerate(("sx", "sy", "sz"))], tr[0].alias("tz"), tr[2].alias("tx"), parse.parse_triplet(F.concat("s", F.lit(",0,"), "k")).isNull().alias("zero_refused"))


def _files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("folder"), F.col("l_linenumber").cast("int").alias("n"), "l_partkey")
    name = F.when(F.col("n") == 1, F.concat(F.lit("Vol_CH0"), F.col("n").cast("string"))).when(F.col("n") == 2, F.concat(F.lit("em_"), F.col("n").cast("string"), F.lit("x"))).when(F.col("n") == 3, F.concat(F.lit("channel-"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("Ex_"), (F.col("n") * 83).cast("string")))
    return li.select("folder", F.concat(F.lit("/d/"), name, F.lit("_p"), (F.col("l_partkey") % 2).cast("string"), F.lit(".ims")).alias("path")).distinct()


def p12_infer_channel(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("channel", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return f.where(parse.matches_channel(F.col("path"), F.col("channel"))).select("folder", "path", "channel", parse.channel_order(F.col("path")).alias("sort_key"))


def p13_duration(spark, sf_dir):
    return X.run_log(spark, sf_dir).select("step", parse.format_duration(F.floor(F.col("seconds") * 40) / 4 + 0.125).alias("text"))


_DIR, _SP, _OR = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.5, 0.25, 2.0], [10.0, -20.0, 5.0]


def p14_physical(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    ix = [F.col("x0"), F.col("y0"), F.col("z0")]
    return b.select("roi_id", *[F.round(parse.index_to_physical(i, _SP, _OR, _DIR, ix), 4).alias(c) for i, c in enumerate(("px", "py", "pz"))])


def p15_names(spark, sf_dir):
    ext = F.when(F.col("s_suppkey") % 3 == 0, ".NII.gz").when(F.col("s_suppkey") % 3 == 1, ".tar.TIFF").otherwise("")
    path = F.concat(F.lit("/data/a.b/"), F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")), F.lit(" é"), ext)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path"))
    stem = parse.file_stem(F.col("path"))
    return s.select("s_suppkey", parse.file_suffix(F.col("path")).alias("suffix"), stem.alias("stem"), parse.with_channel(parse.safe_name(stem), F.col("s_suppkey") % 2).alias("name"))


# ---------------------------------------------------------------- levels, sources, picks


def _requests(spark, sf_dir):
    c = X.catalog(spark, sf_dir).where("level = 0")
    s = F.explode(F.array(*[F.lit(i) for i in (1, 2, 4, 8, 16)]))
    r = c.withColumn("s", s).select((F.col("owner") * 1000 + F.col("channel") * 100 + F.col("s")).alias("request_id"), "path", "level", "timepoint", "channel", "nz", "ny", "nx", F.col("s").alias("s_z"), F.col("s").alias("s_y"), F.col("s").alias("s_x"))
    return r


def j4_pyramid(spark, sf_dir):
    return C.match_pyramid(_requests(spark, sf_dir), X.catalog(spark, sf_dir)).select("request_id", "match")


def j5_coarsest(spark, sf_dir):
    c = C.coarsest_level(X.catalog(spark, sf_dir), ["path", "channel"])
    return c.select("path", "channel", "level", *[F.round(f"scale_{a}", 6).alias(f"scale_{a}") for a in "zyx"])


def j6_sources(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("vol"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel"))
    o = c.where("(vol + channel) % 3 = 0").select("vol", "channel", F.when(F.col("vol") % 2 == 0, "over/{channel}.tif").otherwise("over/x.raw").alias("path"))
    return C.resolve_sources(c, o, F.concat(F.lit("v"), F.col("vol").cast("string"), F.lit(".IMS")))


def j7_channel_files(spark, sf_dir):
    f = _files(spark, sf_dir)
    ch = f.select("folder").distinct().withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return C.infer_channel_files(f, ch, ["folder"])


def _wanted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel")).distinct()
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 5).cast("int").alias("channel"))
    return o, have


def j8_missing(spark, sf_dir):
    o, have = _wanted(spark, sf_dir)
    return M.missing_channels(o, have, ["run"])


def _work(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "QuickSyN").otherwise("TRSAA")
    req = o.select(F.col("o_orderkey").alias("pair_id"), kind.alias("type"), (F.col("o_orderkey") % 3).cast("int").alias("downsample"))
    done = o.where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("pair_id"), F.when(F.col("o_orderkey") % 2 == 0, M.ALIAS["QuickSyN"]).otherwise("TRSAA").alias("type"), (F.col("o_orderkey") % 2).cast("int").alias("downsample"))
    return req, done


def j9_pending(spark, sf_dir):
    return M.pending_work(*_work(spark, sf_dir))


def j9_reuse(spark, sf_dir):
    return M.reusable_work(*_work(spark, sf_dir))


def j10_tile_transforms(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("tile_index"), F.lit(0).alias("z0"))
    s = t.where("tile_index % 7 <> 0").select("tile_index", (F.col("tile_index") % 3 == 0).alias("skipped"), F.when(F.col("tile_index") % 5 == 0, F.lit(True)).alias("output_skipped"), F.lit(1).alias("dz"), (F.col("tile_index") % 4).alias("dy"), F.lit(-1).alias("dx"))
    return M.tiles_with_transforms(t, s)


def w9_pick_one(spark, sf_dir):
    f = _files(spark, sf_dir)
    more = f.where("folder % 5 = 0").select("folder", F.upper("path").alias("path")).unionAll(f.where("folder % 3 = 0").select("folder", F.replace("path", F.lit("/d/"), F.lit("/d/Registered_")).alias("path"))).unionAll(f.where("folder % 7 = 0").select("folder", F.concat(F.lit("/registered"), "path").alias("path")))
    few = f.where(F.col("path").contains("CH01")).unionAll(more.where(F.lower("path").contains("ch01")))
    return C.pick_one(few, ["folder"])


# ---------------------------------------------------------------- tiles


def t1_axis_starts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 5).cast("int").alias("n"), (F.col("p_size") % 13 + 20).cast("int").alias("t"), (F.col("p_partkey") % 7).cast("int").alias("o"))
    return p.select("p_partkey", F.posexplode(tiling.axis_starts(F.col("n"), F.col("t"), F.col("o"))).alias("i", "start"))


def _tiles(spark, sf_dir):
    return tiling.make_tiles(X.catalog(spark, sf_dir), (1568, 2048, 2048), (0, 512, 512), ["path", "channel", "level"])


def t2_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir)


def t2_first_tiles(spark, sf_dir):
    return tiling.make_tiles(X.catalog(spark, sf_dir), (500, 700, 2000), (50, 50, 50), ["path", "channel", "level"], first=4)


def t3_schedule(spark, sf_dir):
    c = X.catalog(spark, sf_dir).select("path", "level", "nz", "ny", "nx")
    cols = ["path", "level", "rows", "cols", "tile_z", "tile_y", "tile_x", "over_y", "over_x"]
    a = tiling.auto_schedule(c, 16, 0.25).select(F.lit("fraction").alias("kind"), *cols)
    return a.unionAll(tiling.auto_schedule(c, 12, None, 40).select(F.lit("pixels"), *cols))


def t4_tile_map(spark, sf_dir):
    return tiling.tile_map(_tiles(spark, sf_dir), ["path", "channel", "level"])


def t5_weights(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 61 + 1).cast("int").alias("n"), (F.col("c_custkey") % 17).cast("int").alias("o"))
    n = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return n.select("k", "i", F.round(tiling.ramp_weight(F.col("i"), F.col("n"), F.col("o")), 9).alias("w"))


def t7_blend_gib(spark, sf_dir):
    c = tiling.blend_gib(X.catalog(spark, sf_dir), 300.0)
    return c.select("path", "level", F.round("blend_gib", 6).alias("blend_gib"), "fits")


# ---------------------------------------------------------------- numbering and logs


def w1_pack_channels(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 12).cast("int").alias("channel"), (F.col("o_custkey") % 8).cast("int").alias("offset"))
    return M.pack_channels(d, ["run"], "offset", "DAPI")


def w2_cycle_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("cycle")).agg(F.count("*").cast("int").alias("n"))
    return M.cycle_offsets(d, ["run"], "cycle")


def w3_eta(spark, sf_dir):
    e = M.eta(X.run_log(spark, sf_dir).withColumn("seconds", F.round(F.col("seconds") * 100).cast("bigint")), ["channel", "stage"], "step", "seconds")
    return e.select("step", "elapsed", "done", "total", F.round("eta", 4).alias("eta"))


def a11_timing(spark, sf_dir):
    r = M.timing_rollup(X.run_log(spark, sf_dir))
    return r.select("channel", "stage", F.round("seconds", 4).alias("seconds"), "steps", F.round("share", 6).alias("share"))


def w8_cycle_manifest(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").cast("int").alias("cycle"), (F.col("l_orderkey") % 4).cast("int").alias("channel"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit(".tif")).alias("path")).distinct()
    return M.cycle_manifest(p, ["run"])


# ---------------------------------------------------------------- SQL

_KEY = "'ResolutionLevel\\s+(\\d+).*?TimePoint\\s+(\\d+).*?Channel\\s+(\\d+).*?/Data$'"
_FILES = """files as (select distinct l_orderkey%500 folder, '/d/'||case l_linenumber when 1 then 'Vol_CH01' when 2 then 'em_2x' when 3 then 'channel-3' else 'Ex_'||(l_linenumber*83) end||'_p'||(l_partkey%2)||'.ims' path from lineitem)"""
_MATCH = "regexp_matches(lower(path), '(^|[^0-9])(ch|em)[_-]?0*'||channel||'([^0-9]|$)|(^|[^0-9])channel[_ -]?0*'||channel||'([^0-9]|$)')"
_ORDER = "coalesce(cast(nullif(regexp_extract(lower(path), 'ex[_-]?([0-9]+)', 1), '') as bigint), cast(nullif(regexp_extract(lower(path), 'em[_-]?([0-9]+)', 1), '') as bigint), cast(nullif(regexp_extract(lower(path), 'ch[_-]?([0-9]+)', 1), '') as bigint), 1000000000)"
_CS = X.sql("catalog")


def _starts(n: str, t: int, o: int) -> str:
    a, b = f"least({t}, {n})", f"least({o}, greatest({n}-1, 0))"
    return f"case when {a} >= {n} then [0] else list_sort(list_distinct(list_concat(range(0, {n}-{a}+1, {a}-{b}), [{n}-{a}]))) end"


def _tile_sql(t, o) -> str:
    u = ", ".join(f"unnest({_starts('n' + a, i, j)}) {a}0" for a, i, j in zip("zyx", t, o, strict=True))
    z, y, x = (f"(select path, channel, level, n{a}, unnest({_starts('n' + a, i, j)}) s from catalog)" for a, i, j in zip("zyx", t, o, strict=True))
    return f"""tiles as (select z.path, z.channel, z.level, cast(row_number() over (partition by z.path, z.channel, z.level order by z.s, y.s, x.s) as int) tile_index,
        cast(z.s as int) z0, cast(least(z.s+{t[0]}, nz) as int) z1, cast(y.s as int) y0, cast(least(y.s+{t[1]}, ny) as int) y1, cast(x.s as int) x0, cast(least(x.s+{t[2]}, nx) as int) x1
        from {z} z join {y} y using (path, channel, level) join {x} x using (path, channel, level))"""


def _axis(n: str, c: str, f: str | None, px: int = 0) -> tuple[str, str]:
    tile = f"cast(ceil({n}/({c}-({c}-1)*{f})) as int)" if f else f"cast(ceil(({n}+({c}-1)*{px})/{c}) as int)"
    over = f"cast(round_even({tile}*{f}, 0) as int)" if f else str(px)
    return f"case when {c} <= 1 then {n} else least({tile}, {n}) end", f"case when {c} <= 1 then 0 else greatest(0, least({over}, {tile}-1)) end"


def _schedule(kind: str, n: int, f: str | None, px: int) -> str:
    (ty, oy), (tx, ox) = _axis("ny", "rows", f, px), _axis("nx", "cols", f, px)
    return f"select '{kind}' kind, path, level, rows, cols, nz tile_z, cast({ty} as int) tile_y, cast({tx} as int) tile_x, cast({oy} as int) over_y, cast({ox} as int) over_x from (select *, cast({n}//rows as int) cols from (select path, level, nz, ny, nx, arg_min(cast(r as int), (abs(ln(({n}::double/r)/r/(nx::double/ny))), r)) rows from catalog, range(1, {n}+1) t(r) where {n}%r=0 and r <= floor(sqrt({n})) group by all))"


_UNION = "select roi_id, floor(min(px)) x0, ceil(max(px)) x1, floor(min(py)) y0, ceil(max(py)) y1, min(case when slice > 0 then slice-1 end) z0, max(case when slice > 0 then slice-1 end)+1 z1 from roi_pts group by roi_id"
_INTS = ", ".join(f"cast({c} as int) {c}" for c in _BOXC)

SQL = {
    "s1_catalog": _CS + f""", d as (select path, owner, case when owner%2=0 then replace(dataset_key, '/', '\\') else dataset_key end dataset_key, nz, ny, nx from catalog where owner%7<>0)
        select path, dataset_key, {', '.join(f"cast(regexp_extract(replace(dataset_key, '\\', '/'), {_KEY}, {i}) as int) {c}" for i, c in ((1, 'level'), (2, 'timepoint'), (3, 'channel')))}, 'zyx' axis_order, nz, ny, nx,
        case when owner%3=0 then 2.0 else 0.711::double end sx, case when owner%3=0 then 2.0 else 0.711::double end sy, case when owner%3=0 then 4.0 else 1.5::double end sz from d""",
    "s2_dataset_key": _CS + "select path, level want, case when owner%5<>0 then level end as level, case when owner%5<>0 then timepoint end as timepoint, case when owner%5<>0 then channel end as channel from catalog",
    "s2_levels": _CS + "select distinct path, level from catalog",
    "s3_discover": _CS + """, r as (select cast(s_suppkey*10+l as int) request_id, cast(s_suppkey as int) owner, l, s_suppkey%3 c from supplier, range(5) t(l))
        select request_id, dataset_key, exact from (select r.request_id, dataset_key, dataset_key = 'DataSet/ResolutionLevel '||l||'/TimePoint 0/Channel '||c||'/Data' exact,
        row_number() over (partition by request_id order by dataset_key <> 'DataSet/ResolutionLevel '||l||'/TimePoint 0/Channel '||c||'/Data', not contains(dataset_key, 'Data'), not contains(dataset_key, 'ResolutionLevel '||l), not contains(dataset_key, 'TimePoint 0'), not contains(dataset_key, 'Channel '||c), cast(nz as bigint)*ny*nx, dataset_key) n
        from r join catalog using (owner)) where n=1""",
    "s4_spacing": "select p_partkey, round(case when p_size<=1 or p_partkey%4=0 then 1.0::double else abs(cast(p_retailprice as double)-p_size)/(p_size-1) end, 6) spacing from part",
    "s5_slices": X.sql("slices") + """, d as (select dir, cast(row_number() over (order by cast(regexp_extract(dir, '([0-9]+)', 1) as int))-1 as int) dir_index from (select distinct dir from slices))
        select s.dir, file, dir_index, cast(row_number() over (partition by s.dir order by cast(regexp_extract(file, 'img_([0-9]+)_', 1) as bigint), cast(regexp_extract(file, '_([0-9]+)[.]', 1) as bigint))-1 as int) z from slices s join d using (dir)""",
    "s6_validate": X.sql("slices") + """, s as (select *, case when dir like '%555%' then '100,200' else '100,300' end shape, case when file like '%7.tif' then 'u1' else 'u2' end dtype from slices),
        d as (select dir from s order by cast(regexp_extract(dir, '([0-9]+)', 1) as int) limit 1),
        one as (select shape fs, dtype ft, (select count(*) from s join d using (dir)) want from s join d using (dir) order by cast(regexp_extract(file, 'img_([0-9]+)', 1) as bigint), cast(regexp_extract(file, '_([0-9]+)[.]', 1) as bigint) limit 1)
        select dir, count(*) n_slices, count(*) filter (shape <> fs) off_shape, count(*) filter (dtype <> ft) off_dtype, count(*) <> max(want) or count(*) filter (shape <> fs or dtype <> ft) > 0 bad from s, one group by dir""",
    "s10_bricks": X.sql("evt") + "select cycle, z, y, x, cast(v as double) v from evt where channel=2 and v<>0",
    "s12_roi_text": """with r as (select l_orderkey, l_linenumber, case l_linenumber%3 when 0 then [l_partkey, l_suppkey, 0, l_partkey+q, l_suppkey+q-3, q] when 1 then [l_partkey, l_suppkey, 1, l_partkey+q, l_suppkey+5, 3] else [l_partkey, l_suppkey, 0, l_suppkey, l_partkey, 9] end b
        from (select *, cast(trunc(l_quantity) as int) q from lineitem)), g as (select *, b[4]>b[1] and b[5]>b[2] and b[6]>b[3] and list_min(b)>=0 ok from r)
        select l_orderkey, l_linenumber, """ + ", ".join(f"cast(case when ok then b[{i + 1}] end as int) {c}" for i, c in enumerate(("x0", "y0", "z0", "x1", "y1", "z1"))) + " from g",
    "s13_manifest": "select o_custkey run, cast(o_orderkey as int) channel, case when o_orderkey%3=0 then 'c'||o_orderkey||'.TIF' else 'c'||o_orderkey||'.nrrd' end path, cast(o_totalprice as double) elapsed_seconds from orders where o_orderkey%3=0 or o_orderkey%5<>0",
    "s14_metrics_summary": "select event_type channel, " + ", ".join(f"round({f}(value) filter (event_id%2={i}), 6) {p}_{n}" for i, p in ((0, "before"), (1, "after")) for n, f in (("ncc", "avg"), ("nmi", "max"), ("nrmse", "min"))) + " from events group by 1",
    "a9_roi_bbox": X.sql("roi_pts") + f"select roi_id, {_INTS}, x1<=x0 or y1<=y0 as empty from (select roi_id, floor(min(px)) x0, ceil(max(px)) x1, floor(min(py)) y0, ceil(max(py)) y1, 0 z0, 1568 z1 from roi_pts group by 1)",
    "a10_roi_union": X.sql("roi_pts").replace("cast(l_linenumber as int) slice", "case when l_orderkey%4<>0 then cast(l_linenumber as int)-1 end slice") + f"select roi_id, {_INTS.replace('cast(z0 as', 'cast(coalesce(z0, 3) as').replace('cast(z1 as', 'cast(coalesce(z1, 9) as')} from ({_UNION})",
    "p2_bounds": X.sql("roi_pts") + f"select roi_id, x0<0 or x1>1500 or y0<0 or y1>80 or z0<0 or z1>5 out_of_bounds, x1<=x0 or y1<=y0 or z1<=z0 empty_box, x0=0 or y0=0 or z0=0 starts_at_zero from ({_UNION})",
    "p3_z_range": "select l_orderkey, l_linenumber, case when ok then cast(l_linenumber as int)-1 end z0, case when ok then cast(l_suppkey%9 as int) else 1568 end z1 from (select *, l_suppkey%9 >= l_linenumber ok from lineitem)",
    "p10_channels": "select distinct p_partkey, cast(unnest(list_concat(range(p_size, p_partkey%60+1), [2, 0, p_size%3])) as int) channel from part where p_partkey%60 >= p_size",
    "p11_spacing": """select p_partkey, case p_partkey%3 when 0 then p_size+0.5::double when 1 then p_size::double end sx, case p_partkey%3 when 0 then p_size+0.5::double when 1 then p_partkey::double end sy, case p_partkey%3 when 0 then p_size+0.5::double when 1 then 2.25::double end sz,
        cast(p_size as int) tz, cast(p_partkey as int) tx, true zero_refused from part""",
    "p12_infer_channel": f"with {_FILES} select folder, path, cast(channel as int) channel, {_ORDER} sort_key from files, range(1, 5) t(channel) where {_MATCH}",
    "p13_duration": X.sql("run_log") + """, s as (select step, floor(seconds*40)/4+0.125 s from run_log), n as (select *, cast(round_even(s, 0) as bigint) n from s)
        select step, case when s<60 then printf('%.1f', round(s, 1))||'s' when n//60<60 then (n//60)||'m'||lpad((n%60)::varchar, 2, '0')||'s' else (n//3600)||'h'||lpad((n//60%60)::varchar, 2, '0')||'m'||lpad((n%60)::varchar, 2, '0')||'s' end as text from n""",
    "p14_physical": X.sql("roi_pts") + f"select roi_id, round(10+y0*0.25::double, 4) px, round(-20-x0*0.5::double, 4) py, round(5+z0*2.0::double, 4) pz from ({_UNION})",
    "p15_names": """with s as (select s_suppkey, replace(s_name, '#', ' ')||' é' base, case s_suppkey%3 when 0 then '.NII.gz' when 1 then '.tar.TIFF' else '' end ext from supplier),
        t as (select s_suppkey, case s_suppkey%3 when 0 then '.nii.gz' when 1 then '.tiff' else '' end suffix, case s_suppkey%3 when 1 then base||'.tar' else base end stem from s)
        select s_suppkey, suffix, stem, regexp_replace(stem, '[^A-Za-z0-9._-]', '_', 'g')||'_ch'||(s_suppkey%2) as name from t""",
    "j4_pyramid": _CS + """, q as (select cast(owner*1000+channel*100+s as int) request_id, path, timepoint, channel, nz, ny, nx, s from catalog, (values (1), (2), (4), (8), (16)) t(s) where level=0),
        m as (select request_id, c.level, abs(c.nz-ceil(q.nz/s::double)) a, abs(c.ny-ceil(q.ny/s::double)) b, abs(c.nx-ceil(q.nx/s::double)) d, abs(q.nz::double/c.nz-s)+abs(q.ny::double/c.ny-s)+abs(q.nx::double/c.nx-s) e from q join catalog c using (path, timepoint, channel) where c.level<>0 and s>1)
        select request_id, match from q left join (select request_id, level as match, row_number() over (partition by request_id order by a+b+d, e, level) n from m where a<=1 and b<=1 and d<=1) using (request_id) where coalesce(n, 1)=1""",
    "j5_coarsest": _CS + "select o.path, o.channel, o.level, round(b.nz::double/o.nz, 6) scale_z, round(b.ny::double/o.ny, 6) scale_y, round(b.nx::double/o.nx, 6) scale_x from (select *, row_number() over (partition by path, channel order by cast(nz as bigint)*ny*nx, level desc) n from catalog where level<>0) o join catalog b on b.path=o.path and b.channel=o.channel and b.level=0 where n=1",
    "j6_sources": "select cast(s_suppkey as int) vol, cast(c as int) channel, case when (s_suppkey+c)%3<>0 then 'v'||s_suppkey||'.IMS' when s_suppkey%2=0 then 'over/'||c||'.tif' else 'over/x.raw' end source, (s_suppkey+c)%3<>0 or s_suppkey%2=0 known from supplier, range(4) t(c)",
    "j7_channel_files": f"""with {_FILES}, ch as (select folder, cast(c as int) channel from (select distinct folder from files), range(6) t(c)),
        h as (select ch.folder, channel, count(*) hits, min(path) named from ch join files using (folder) where {_MATCH} group by all),
        o as (select folder, path placed, cast(row_number() over (partition by folder order by {_ORDER}, lower(path))-1 as int) channel from files)
        select folder, channel, case when hits=1 then named when hits is null then placed end path, case when hits=1 then 'name' when hits>1 then 'ambiguous' when placed is not null then 'order' else 'missing' end how from ch left join h using (folder, channel) left join o using (folder, channel)""",
    "j8_missing": "select distinct o_custkey run, cast(c as int) channel from orders, range(4) t(c) where not exists (select 1 from orders p where p.o_custkey=orders.o_custkey and p.o_orderkey%5=c)",
    "j9_pending": "select o_orderkey pair_id, case when o_orderkey%2=0 then 'antsRegistrationSyNQuick[s]' else 'TRSAA' end as type, cast(o_orderkey%3 as int) downsample from orders where o_orderkey%4=1 or o_orderkey%3<>o_orderkey%2",
    "j9_reuse": "select o_orderkey pair_id, case when o_orderkey%2=0 then 'antsRegistrationSyNQuick[s]' else 'TRSAA' end as type, cast(o_orderkey%3 as int) downsample from orders where o_orderkey%4<>1 and o_orderkey%3=o_orderkey%2",
    "j10_tile_transforms": """select cast(c_custkey as int) tile_index, 0 z0, case when c_custkey%7=0 then null when c_custkey%3=0 then 0 else 1 end dz, cast(case when c_custkey%7=0 then null when c_custkey%3=0 then 0 else c_custkey%4 end as int) dy, case when c_custkey%7=0 then null when c_custkey%3=0 then 0 else -1 end dx, c_custkey%7=0 lacking
        from customer where c_custkey%7=0 or c_custkey%5<>0""",
    "w9_pick_one": f"with {_FILES}, k as (select folder, path from files where path like '%CH01%' union all select folder, upper(path) from files where folder%5=0 and path like '%CH01%' union all select folder, '/registered'||path from files where folder%7=0 and path like '%CH01%'), one as (select folder, lower(path) low, min(path) path from k group by all) select folder, count(*) n, case when count(*)=1 then min(path) end path from one group by folder",
    "t1_axis_starts": "select p_partkey, cast(row_number() over (partition by p_partkey order by start)-1 as int) i, cast(start as int) start from (select p_partkey, unnest(case when t>=n then [0] else list_sort(list_distinct(list_concat(range(0, n-t+1, t-o), [n-t]))) end) start from (select p_partkey, p_size*37+5 n, p_size%13+20 t, p_partkey%7 o from part))",
    "t2_tiles": _CS + ", " + _tile_sql((1568, 2048, 2048), (0, 512, 512)) + " select * from tiles",
    "t2_first_tiles": _CS + ", " + _tile_sql((500, 700, 2000), (50, 50, 50)) + " select * from tiles where tile_index<=4",
    "t3_schedule": _CS + _schedule("fraction", 16, "0.25::double", 0) + " union all " + _schedule("pixels", 12, None, 40),
    "t4_tile_map": _CS + ", " + _tile_sql((1568, 2048, 2048), (0, 512, 512)) + ", p as (" + " union ".join(f"select path, channel, level, '{a}' axis, {a}0 as start, {a}1 as stop from tiles" for a in "zyx") + "), q as (select *, lead(start) over (partition by path, channel, level, axis order by start) next_start from p) select *, case when next_start is not null then greatest(stop-next_start, 0) end band from q",
    "t5_weights": "with g as (select c_custkey k, cast(c_custkey%61+1 as int) n, cast(c_custkey%17 as int) o from customer), w as (select k, cast(i as int) i, n, least(o, n//2) e, least(i, n-1-i) m from g, range(61) t(i) where i<n) select k, i, round(case when e<=0 then 1.0::double when m<e then greatest(0.5*(1-cos(pi()*m/e)), 1e-4) else 1.0 end, 9) w from w",
    "t7_blend_gib": _CS + "select path, level, round(cast(nz as bigint)*ny*nx*8/1073741824.0::double, 6) blend_gib, cast(nz as bigint)*ny*nx*8/1073741824.0::double <= 300 fits from catalog",
    "w1_pack_channels": "select o_custkey run, channel, cast(n as int) out_channel, 'DAPI_C'||lpad(n::varchar, 3, '0') as name from (select o_custkey, channel, row_number() over (partition by o_custkey order by channel)-1+o_custkey%8 n from (select distinct o_custkey, cast(o_orderkey%12 as int) channel from orders))",
    "w2_cycle_offsets": "select run, cycle, n, cast(coalesce(sum(n) over (partition by run order by cycle rows between unbounded preceding and 1 preceding), 0) as int) as offset from (select o_custkey run, o_orderpriority cycle, cast(count(*) as int) n from orders group by all)",
    "w3_eta": X.sql("run_log") + "select step, cast(elapsed as bigint) elapsed, done, total, round(elapsed::double/done*(total-done), 4) eta from (select step, sum(cast(round(seconds*100) as bigint)) over w elapsed, count(*) over w done, count(*) over (partition by channel, stage) total from run_log window w as (partition by channel, stage order by step rows between unbounded preceding and current row))",
    "a11_timing": X.sql("run_log") + "select channel, stage, round(sum(seconds), 4) as seconds, count(*) steps, round(sum(seconds)/(select sum(seconds) from run_log), 6) share from run_log group by rollup(channel, stage)",
    "w8_cycle_manifest": "select run, cast(row_number() over (partition by run order by cycle, channel, path)-1 as int) position, cycle, channel, path from (select distinct l_suppkey run, cast(l_linenumber as int) cycle, cast(l_orderkey%4 as int) channel, 'c'||l_orderkey||'.tif' path from lineitem)",
}

_FUNCTIONS = (s1_catalog, s2_dataset_key, s2_levels, s3_discover, s4_spacing, s5_slices, s6_validate, s10_bricks, s12_roi_text, s13_manifest, s14_metrics_summary, a9_roi_bbox, a10_roi_union, p2_bounds, p3_z_range, p10_channels, p11_spacing, p12_infer_channel, p13_duration, p14_physical, p15_names, j4_pyramid, j5_coarsest, j6_sources, j7_channel_files, j8_missing, j9_pending, j9_reuse, j10_tile_transforms, w9_pick_one, t1_axis_starts, t2_tiles, t2_first_tiles, t3_schedule, t4_tile_map, t5_weights, t7_blend_gib, w1_pack_channels, w2_cycle_offsets, w3_eta, a11_timing, w8_cycle_manifest)
QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in _FUNCTIONS}
