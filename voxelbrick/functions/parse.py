"""Columns parsed from text: dataset keys, regions, ranges, lists, spacings, names, durations. What can't be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"ResolutionLevel\s+(\d+).*?TimePoint\s+(\d+).*?Channel\s+(\d+).*?/Data$"


def parse_dataset_key(key: Column) -> Column:
    """struct(level, timepoint, channel), null if the key has another form or a number beyond an int. Backslashes count as slashes."""
    k = F.replace(key, F.lit("\\"), F.lit("/"))
    at = lambda i: F.regexp_extract(k, KEY, i).try_cast("int")
    whole = k.rlike(KEY) & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull()
    return F.when(whole, F.struct(at(1).alias("level"), at(2).alias("timepoint"), at(3).alias("channel")))


def spacing_from_extents(low: Column, high: Column, n: Column) -> Column:
    """|high - low| / (n - 1); 1 for one voxel or where an extent is missing."""
    return F.when((n <= 1) | low.isNull() | high.isNull(), 1.0).otherwise(F.abs(high - low) / (n - 1))


def _pieces(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


_BOX = ("x0", "y0", "z0", "x1", "y1", "z1")


def _once(value: Column, use) -> Column:
    """use(value), where value is worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_roi(text: Column) -> Column:
    """struct(x0, y0, z0, x1, y1, z1), ends exclusive, from six numbers or JSON with ends or sizes; null if empty, negative or of another form."""
    whole = lambda a: F.forall(a, lambda v: v.isNotNull())

    def of_json(j: Column) -> Column:
        ends = F.array(*[j[c] for c in _BOX])
        sizes = F.array(j["x"], j["y"], j["z"], *[F.try_add(j[a], j[f"size_{a}"]) for a in "xyz"])
        return F.when(whole(ends), ends).when(whole(sizes), sizes)

    def box(got: Column) -> Column:
        at = lambda i: F.get(got, F.lit(i))
        good = F.coalesce(whole(got) & (at(3) > at(0)) & (at(4) > at(1)) & (at(5) > at(2)) & (F.array_min(got) >= 0), F.lit(False))
        return F.when(good, F.struct(*[at(i).alias(c) for i, c in enumerate(_BOX)]))

    j = F.from_json(text, "x0 int, y0 int, z0 int, x1 int, y1 int, z1 int, x int, y int, z int, size_x int, size_y int, size_z int")
    p = F.transform(_pieces(text), lambda s: F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int")))
    return _once(F.when(text.startswith("{"), _once(j, of_json)).otherwise(_once(p, lambda p: F.when(F.size(p) == 6, p))), box)


def z_range(text: Column) -> Column:
    """struct(z0, z1) from one-based inclusive 'first,last'."""
    p = F.transform(_pieces(text), lambda s: F.when(s.rlike("^[0-9]+$"), s.try_cast("int")))
    return F.when((F.size(p) == 2) & (F.get(p, F.lit(0)) >= 1) & (F.get(p, F.lit(1)) >= F.get(p, F.lit(0))), F.struct((F.get(p, F.lit(0)) - 1).alias("z0"), F.get(p, F.lit(1)).alias("z1")))


def parse_channels(text: Column) -> Column:
    """Sorted distinct channel numbers of a list such as 0-2,5; null if empty, falling, not numbers or beyond an int."""
    items = _pieces(text)
    good = (F.size(items) > 0) & F.forall(items, lambda s: s.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$"))
    first = lambda s: F.regexp_extract(s, r"^([0-9]+)", 1).try_cast("int")
    last = lambda s: F.regexp_extract(s, r"([0-9]+)$", 1).try_cast("int")
    rising = F.forall(items, lambda s: F.coalesce(last(s) >= first(s), F.lit(False)))
    return F.when(good, F.when(rising, F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda s: F.sequence(first(s), F.greatest(last(s), first(s)))))))))


def parse_spacing(text: Column) -> Column:
    """Three positive numbers from one or three; null otherwise."""
    p = F.transform(_pieces(text), lambda s: F.when(s.rlike(r"^[+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.cast("double")))
    ok = F.forall(p, lambda v: v.isNotNull() & (v > 0))
    return F.when(ok & (F.size(p) == 1), F.array(F.get(p, F.lit(0)), F.get(p, F.lit(0)), F.get(p, F.lit(0)))).when(ok & (F.size(p) == 3), p)


def parse_triplet(text: Column, least: int = 1) -> Column:
    """Three whole numbers of at least `least` (1 for sizes, 0 for overlaps)."""
    p = F.transform(_pieces(text), lambda s: F.when(s.rlike("^-?[0-9]+$"), s.try_cast("int")))
    return F.when((F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull() & (v >= least)), p)


def matches_channel(path: Column, channel: Column) -> Column:
    """Whether ch, em or channel with the number stands in the path, no other digit before or after."""
    n = channel.cast("string")
    return F.regexp_like(F.lower(path), F.concat(F.lit(r"(?<![0-9])(ch|em)[_-]?0*"), n, F.lit(r"(?![0-9])|(?<![0-9])channel[_ -]?0*"), n, F.lit("(?![0-9])")))


def channel_order(path: Column) -> Column:
    """The sort key of sibling files: the number after ex, else em, else ch, else a large one."""
    low = F.lower(path)
    at = lambda k: F.nullif(F.regexp_extract(low, rf"{k}[_-]?([0-9]+)", 1), F.lit("")).try_cast("bigint")
    return F.coalesce(at("ex"), at("em"), at("ch"), F.lit(10**9).cast("bigint"))


def format_duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0.0), seconds.cast("double"))
    n = F.rint(s).cast("bigint")
    minutes, sec = F.floor(n / 60), n % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    under = F.concat(F.format_string("%.1f", s), F.lit("s"))
    return F.when(s < 60, under).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), two(sec), F.lit("s"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), two(minutes % 60), F.lit("m"), two(sec), F.lit("s")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_suffix(path: Column) -> Column:
    """Lower case, .nii.gz as one; empty if there is none."""
    name = F.lower(file_name(path))
    return F.when(name.endswith(".nii.gz"), ".nii.gz").otherwise(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(path)))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def with_channel(stem: Column, channel: Column) -> Column:
    """_ch<N> at the end, unless it is there."""
    tail = F.concat(F.lit("_ch"), channel.cast("string"))
    return F.when(stem.endswith(tail), stem).otherwise(F.concat(stem, tail))


def natural_key(name: Column) -> Column:
    """An orderable array: digit runs as numbers of any length (by length without leading zeros, then digits), the rest in lower case, in turn.

    Numbers begin with 0 and sort before the rest, which begins with 1."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda p: F.ltrim(p, F.lit("0"))
    number = lambda p: (p >= "0") & (p < ":")
    return F.transform(parts, lambda p: F.when(number(p), F.concat(F.lit("0"), F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(F.concat(F.lit("1"), p)))


def index_to_physical(axis: int, spacing: list, origin: list, direction: list, index: list[Column]) -> Column:
    """Coordinate `axis` (x, y, z = 0, 1, 2) of a voxel index (x, y, z): origin + direction . (index * spacing)."""
    out = F.lit(float(origin[axis]))
    for j in range(3):
        out = out + F.lit(float(direction[3 * axis + j])) * (index[j] * F.lit(float(spacing[j])))
    return out
