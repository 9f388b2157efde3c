"""Map tables: city grids, ground sizes, building slots, positions, overlaps,
and the display scales (heights, date hues).  Pure projections, aggregates
and equi-joins; the geometry itself is left to whoever draws the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import with_group_index

# Fixed values of the reference's map: building base width, spacing (base / 5),
# city position scale, padding of the overlap test, hue range.
BUILDING_BASE = 10.0
BUILDING_SPACING = BUILDING_BASE / 5
POSITION_SCALE = 200.0
OVERLAP_PAD = 2 * BUILDING_BASE
HUE_OLD, HUE_NEW = 230.0, 360.0


def prime_factors(n: Column) -> Column:
    """Ascending prime factors of n (n >= 2), trial division by d <= sqrt(n)
    with up to 62 repeats of each divisor."""
    init = F.struct(n.cast("long").alias("rem"), F.array().cast("array<long>").alias("fs"))

    def by_divisor(acc, d):
        def once(a, _):
            hit = (a["rem"] % d == 0) & (a["rem"] >= d)
            return F.struct(
                F.when(hit, F.floor(a["rem"] / d).cast("long")).otherwise(a["rem"]).alias("rem"),
                F.when(hit, F.concat(a["fs"], F.array(d.cast("long")))).otherwise(a["fs"]).alias("fs"),
            )
        return F.aggregate(F.sequence(F.lit(1), F.lit(62)), acc, once)

    limit = F.greatest(F.lit(2), F.floor(F.sqrt(n)).cast("long"))
    res = F.aggregate(F.sequence(F.lit(2).cast("long"), limit), init, by_divisor)
    return F.when(res["rem"] > 1, F.concat(res["fs"], F.array(res["rem"]))).otherwise(res["fs"])


def grid_dims(n: Column) -> Column:
    """(width, height) of a city of n buildings: factors from the largest,
    each onto the currently smaller side (width first on ties)."""
    fs = F.reverse(prime_factors(n))
    init = F.struct(F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("h"))
    dims = F.aggregate(
        fs, init,
        lambda acc, f: F.when(acc["w"] <= acc["h"], F.struct((acc["w"] * f).alias("w"), acc["h"].alias("h")))
        .otherwise(F.struct(acc["w"].alias("w"), (acc["h"] * f).alias("h"))),
    )
    return F.when(n <= 1, F.struct(F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("h"))).otherwise(dims)


def city_grid_dims(buildings: DataFrame) -> DataFrame:
    """(label, n_buildings, grid_w, grid_h); factorisation runs once per
    distinct building count."""
    counts = buildings.groupBy("label").agg(F.count(F.lit(1)).alias("n_buildings"))
    dims = counts.select("n_buildings").distinct().select("n_buildings", grid_dims(F.col("n_buildings")).alias("d"))
    return counts.join(dims, "n_buildings").select(
        "label", "n_buildings", F.col("d.w").alias("grid_w"), F.col("d.h").alias("grid_h"))


def side(k: Column) -> Column:
    return k * F.lit(BUILDING_BASE) + (k + 1) * F.lit(BUILDING_SPACING)


def city_ground_size(dims: DataFrame) -> DataFrame:
    return dims.select("label", "grid_w", "grid_h",
                       side(F.col("grid_w")).alias("ground_width"), side(F.col("grid_h")).alias("ground_length"))


def building_slots(buildings: DataFrame, dims: DataFrame) -> DataFrame:
    """Slot of each building, row by row in file-name order:
    x = spacing + base/2 + col * (spacing + base), same for z with the row."""
    ranked = with_group_index(buildings.select("label", "fileName", "height"), ["label"], [F.col("fileName")], name="i")
    j = ranked.join(dims.select("label", "grid_w"), "label")
    col = F.col("i") % F.col("grid_w")
    row = F.floor(F.col("i") / F.col("grid_w"))
    step = BUILDING_SPACING + BUILDING_BASE
    first = BUILDING_SPACING + BUILDING_BASE / 2
    return j.select("label", "fileName", "height", F.col("i").alias("slot"),
                    (F.lit(first) + col * step).alias("x"), (F.lit(first) + row * step).alias("z"))


def city_positions(cities: DataFrame, ground: DataFrame) -> DataFrame:
    """cities(label, x, y) normalised centroids -> position and centre."""
    j = cities.join(ground, "label")
    px = F.col("x") * POSITION_SCALE
    pz = F.col("y") * POSITION_SCALE
    return j.select("label", px.alias("pos_x"), pz.alias("pos_z"), "ground_width", "ground_length",
                    (px + F.col("ground_width") / 2).alias("center_x"),
                    (pz + F.col("ground_length") / 2).alias("center_z"))


def overlapping_cities(pos: DataFrame) -> DataFrame:
    """Pairs (i, j), i != j, where city i padded by 20 on each side meets city j.

    A range join done as equi-joins on a grid of many levels: a rectangle's own
    level is the smallest power of two that holds its longer side, so it
    covers at most four cells there.  It meets rectangles of its own and of finer
    levels on its own level, where those cover four cells at most as well.  A
    rectangle is listed on the levels that the other side has (a short list:
    exponents of two), and stands for its own level on one side of the join
    only, so that many small cities near a huge one do not meet each other on
    the huge one's level.  The exact inequalities decide; a pair is kept once,
    in the cell of the larger of the two lower-left corners."""
    r1 = pos.select(
        F.col("label").alias("id"),
        (F.col("pos_x") - OVERLAP_PAD).alias("x0"), (F.col("pos_z") - OVERLAP_PAD).alias("z0"),
        (F.col("pos_x") - OVERLAP_PAD + F.col("ground_width") + 2 * OVERLAP_PAD).alias("x1"),
        (F.col("pos_z") - OVERLAP_PAD + F.col("ground_length") + 2 * OVERLAP_PAD).alias("z1"))
    r2 = pos.select(
        F.col("label").alias("id"), F.col("pos_x").alias("x0"), F.col("pos_z").alias("z0"),
        (F.col("pos_x") + F.col("ground_width")).alias("x1"), (F.col("pos_z") + F.col("ground_length")).alias("z1"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"), F.lit(1e-6))
    r1, r2 = (r.withColumn("own", F.ceil(F.log2(side)).cast("int")) for r in (r1, r2))
    levels = [sorted(row["own"] for row in r.select("own").distinct().collect() if row["own"] is not None) for r in (r1, r2)]

    def cells(df: DataFrame, level, key: str) -> DataFrame:
        df = df.withColumn("level", level)
        size = F.pow(F.lit(2.0), F.col("level"))
        for c, lo, hi in (("cx", "x0", "x1"), ("cz", "z0", "z1")):
            df = df.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long"))))
        return df.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in ("x0", "z0", "x1", "z1")], "level", "cx", "cz")

    def listed(known: list[int], strict: bool):
        wanted = F.array(*[F.lit(x) for x in known]).cast("array<int>")
        return F.explode(F.filter(wanted, lambda x: x > F.col("own") if strict else x >= F.col("own")))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        j = a.join(b, ["level", "cx", "cz"]).where(F.col("i") != F.col("j"))
        size = F.pow(F.lit(2.0), F.col("level"))
        hit = (F.col("x0_i") < F.col("x1_j")) & (F.col("x0_j") < F.col("x1_i")) & \
              (F.col("z0_i") < F.col("z1_j")) & (F.col("z0_j") < F.col("z1_i"))
        own = (F.col("cx") == F.floor(F.greatest("x0_i", "x0_j") / size)) & \
              (F.col("cz") == F.floor(F.greatest("z0_i", "z0_j") / size))
        return j.where(hit & own).select("i", "j")

    # i's level at least j's, or j's above i's: each pair in one of the two
    return meet(cells(r1, F.col("own"), "i"), cells(r2, listed(levels[0], False), "j")).unionByName(
        meet(cells(r1, listed(levels[1], True), "i"), cells(r2, F.col("own"), "j")))


def min_max_height(buildings: DataFrame) -> DataFrame:
    """min and max building height; the maximum starts at 0 like the page's."""
    return buildings.agg(F.min("height").alias("min_height"),
                         F.greatest(F.lit(0).cast("long"), F.max("height")).alias("max_height"))


def height_scale(buildings: DataFrame) -> DataFrame:
    """Scale of each building: 1..10 between the smallest and largest height,
    1 when all heights are equal."""
    mm = min_max_height(buildings)
    mn = mm.select("min_height").scalar()
    mx = mm.select("max_height").scalar()
    h = F.col("height")
    scaled = F.when(mx - mn == 0, F.lit(1.0)).otherwise(F.lit(9.0) / (mx - mn) * h + (mx - 10 * mn) / (mx - mn))
    return buildings.withColumn("scale", scaled)


def min_max_date(dates: DataFrame, date_type: str = "last_modification") -> DataFrame:
    return dates.agg(F.min(date_type).alias("min_date"), F.max(date_type).alias("max_date"))


def _epoch_ms(c: Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1000 if isinstance(c, str) else F.unix_micros(c.cast("timestamp")) / 1000


def date_color_hue(buildings: DataFrame, dates: DataFrame, date_type: str = "last_modification") -> DataFrame:
    """Hue 230 (oldest) .. 360 (newest) of each building by the chosen date;
    NULL (default colour) for files without a date or for 'base'."""
    if date_type not in ("last_modification", "creation_date"):
        return buildings.withColumn("hue", F.lit(None).cast("double"))
    d = dates.select(F.col("path").alias("fileName"), F.col(date_type).alias("__d"))
    lo = dates.select(F.min(date_type)).scalar()
    hi = dates.select(F.max(date_type)).scalar()
    t, t0, t1 = _epoch_ms(F.col("__d")), _epoch_ms(lo), _epoch_ms(hi)
    hue = F.try_divide((HUE_NEW - HUE_OLD) * (t - t0), (t1 - t0)) + HUE_OLD
    return buildings.join(d, "fileName", "left").withColumn("hue", hue).drop("__d")
