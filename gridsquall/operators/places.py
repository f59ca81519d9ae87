"""Pairs of stations by the places they stand at.

Stations of one place have one distance to every other place, so distances are worked out
for pairs of places, and stations come in as counts, least numbers or lists.  Places are
dealt into tiles; tiles whose boxes are further apart than the radius never meet, and every
pair of tiles is a key of its own, so no task holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.functions.geo import haversine
from gridsquall.operators.rank import numbered_sort
from gridsquall.session import cut, stored

#: Stations in a list, and places in a tile.
MOST, LEAST_TILE, MOST_TILE = 256, 32, 2048


def dealt_tiles(places: DataFrame, radius_m: float | None, tiles: int, last: str) -> tuple[DataFrame, DataFrame]:
    """``places`` with their ``_tile``, dealt by ``lat, lon`` and ``last``, and ``_tile_i, _tile_j`` of the tiles that can hold places within the radius."""
    dy, dx = (None, None) if radius_m is None else (radius_m / 110_540.0 * 1.01, radius_m / (111_320.0 * 0.5) * 1.01)
    strip = F.floor(F.col("lat") / dy) if dy else F.lit(0)
    dealt = places.withColumn("_strip", strip).repartitionByRange(tiles, "_strip", "lon", "lat", last)
    dealt = stored(dealt.drop("_strip").withColumn("_tile", F.spark_partition_id()))
    box = dealt.groupBy("_tile").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)))  # a row for each tile
    one = lambda k: box.select(*(F.col(c).alias(f"{c}_{k}") for c in box.columns))
    met = F.col("_tile_i") <= F.col("_tile_j")
    if radius_m is not None:
        for c, width in (("lat", dy), ("lon", dx)):
            met = met & (F.greatest(F.col(f"min_{c}_i"), F.col(f"min_{c}_j")) - F.least(F.col(f"max_{c}_i"), F.col(f"max_{c}_j")) <= width)
    return dealt, cut(one("i").join(one("j"), met).select("_tile_i", "_tile_j"))


def tile_pairs(places: DataFrame, radius_m: float | None = None) -> DataFrame:
    """Every unordered pair of rows of ``places`` (``lat, lon, part`` are its key) within the radius, a row with itself included.

    Columns get ``_i`` and ``_j``, beside ``dist`` and ``same``.
    """
    spark = places.sparkSession
    n = places.count()
    tiles = max(1, n // min(MOST_TILE, max(LEAST_TILE, n // 24)))
    dealt, keys = dealt_tiles(places, radius_m, tiles, "part")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1024, tiles * (tiles + 1) // 2))
    side = lambda k: dealt.select(*(F.col(c).alias(f"{c}_{k}") for c in dealt.columns)).join(keys, f"_tile_{k}").repartition(width, "_tile_i", "_tile_j")
    key = lambda k: F.struct(*(F.col(f"{c}_{k}").alias(c) for c in ("lat", "lon", "part")))
    both = side("i").hint("merge").join(side("j"), ["_tile_i", "_tile_j"])
    both = both.filter((F.col("_tile_i") < F.col("_tile_j")) | (key("i") <= key("j")))
    both = both.withColumn("same", key("i") == key("j")).withColumn("dist", haversine(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")))
    both = both if radius_m is None else both.filter(F.col("dist") < radius_m)
    return both.drop("_tile_i", "_tile_j")


def station_pairs(stations: DataFrame, radius_m: float | None = None, extra: tuple[str, ...] = (), towards: Callable[..., Column] | None = None) -> DataFrame:
    """``i, j, dist`` of all pairs with i before j within the radius, with the stations' ``extra`` columns as ``_i`` and ``_j``.

    ``towards`` of the latitudes and longitudes of i and j gives a further column of that name, which is worked
    out once for each pair of places and direction.
    """
    place = Window.partitionBy("lat", "lon").orderBy("sid")
    part = F.floor((F.row_number().over(place) - 1) / MOST)
    lists = stations.withColumn("part", part).groupBy("lat", "lon", "part").agg(F.collect_list(F.struct("sid", *extra) if extra else "sid").alias("m"))
    met = tile_pairs(lists, radius_m)
    ways = ["there", "back"] if towards else []
    for way, (a, b) in zip(ways, ("ij", "ji"), strict=False):
        met = met.withColumn(way, towards(*(F.col(f"{c}_{k}") for k in (a, b) for c in ("lat", "lon"))))
    each = met.select("same", "dist", *ways, F.explode("m_i").alias("a"), "m_j").select("same", "dist", *ways, "a", F.explode("m_j").alias("b"))
    number = lambda k: F.col(f"{k}.sid" if extra else k)
    first = number("a") < number("b")
    each = each.filter(~F.col("same") | first)
    pick = lambda c, k: F.when(first, F.col(f"{'ab'[k]}.{c}")).otherwise(F.col(f"{'ba'[k]}.{c}"))
    way = [F.when(first, F.col("there")).otherwise(F.col("back")).alias("towards")] if towards else []
    return each.select(F.least(number("a"), number("b")).alias("i"), F.greatest(number("a"), number("b")).alias("j"), "dist", *way, *(pick(c, k).alias(f"{c}_{'ij'[k]}") for c in extra for k in (0, 1)))


def counted(stations: DataFrame) -> DataFrame:
    """``lat, lon, part, n, low, low2``: the stations of each place, counted, and its two least numbers."""
    k = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("sid"))
    at = lambda r: F.min(F.when(F.col("_k") == r, F.col("sid")))
    return stations.withColumn("_k", k).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), at(1).alias("low"), at(2).alias("low2")).withColumn("part", F.lit(0))


def _directed(pairs: DataFrame) -> DataFrame:
    """Pairs of two places in both directions: ``lat, lon`` of the one, ``n, low, dist`` of the other."""
    way = lambda a, b: F.struct(F.col(f"lat_{a}").alias("lat"), F.col(f"lon_{a}").alias("lon"), F.col(f"n_{b}").alias("n"), F.col(f"low_{b}").alias("low"))
    return pairs.filter(~F.col("same")).select("dist", F.explode(F.array(way("i", "j"), way("j", "i"))).alias("w")).select("dist", "w.*")


def _summary(directed: DataFrame) -> DataFrame:
    return directed.groupBy("lat", "lon").agg(F.sum("n").alias("others"), F.min("dist").alias("least"), F.min(F.struct(F.round("dist", 3).alias("d"), F.col("low").alias("j"))).alias("best"))


def _per_station(stations: DataFrame, places: DataFrame, around: DataFrame) -> DataFrame:
    """``sid, n, least, j`` from what a place has around it and its own other stations."""
    s = stations.select("sid", "lat", "lon").join(places.drop("part"), ["lat", "lon"]).join(around, ["lat", "lon"], "left")
    own = F.when(F.col("n") > 1, F.struct(F.lit(0.0).alias("d"), F.when(F.col("sid") == F.col("low"), F.col("low2")).otherwise(F.col("low")).alias("j")))
    return s.select("sid", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.when(F.col("n") > 1, 0.0).otherwise(F.col("least")).alias("least"), F.least(own, F.col("best"))["j"].alias("j"))


def within(stations: DataFrame, radius_m: float) -> DataFrame:
    """``sid, n, least, j``: how many other stations lie within the radius, the least distance, and the nearest (by millimetres, then number)."""
    places = cut(counted(stations))
    return _per_station(stations, places, _summary(_directed(tile_pairs(places, radius_m))))


def nearest(stations: DataFrame, first_m: float = 250.0) -> DataFrame:
    """``sid, j``: the nearest other station (by millimetres, then number); the radius grows until every place has found another."""
    places = cut(counted(stations))
    open_, around, radius = places.select("lat", "lon"), None, first_m
    while True:
        wide = radius > 2e6
        got = _summary(_directed(tile_pairs(places, None if wide else radius))).join(open_, ["lat", "lon"], "left_semi")
        got = cut(got if wide else got.filter(F.col("best.d") < radius - 0.01))  # beyond it another may be as near by millimetres
        around = got if around is None else around.unionByName(got)
        open_ = cut(open_.join(got, ["lat", "lon"], "left_anti"))
        if wide or open_.isEmpty():
            return _per_station(stations, places, around).filter("j IS NOT NULL").select("sid", "j")
        radius *= 16


def later_distances(stations: DataFrame, block: int = 4096, salt: int = 16) -> DataFrame:
    """``i, n, mean, least`` of the distances from each station to all stations of larger number.

    Stations are dealt into blocks by number.  Of all later blocks a place needs only how many
    stations each place has there; inside a block stations meet one by one.
    """
    spark = stations.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64)
    s = cut(numbered_sort(stations.filter("sid IS NOT NULL").select("sid", "lat", "lon"), F.asc("sid")).withColumn("k", F.floor(F.col("pos") / block)).drop("pos"))
    counts = s.groupBy("k", "lat", "lon").agg(F.count(F.lit(1)).alias("c"))
    grid = s.select("lat", "lon").distinct().crossJoin(s.select("k").distinct())  # places x blocks
    after = Window.partitionBy("lat", "lon").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    later = grid.join(counts, ["k", "lat", "lon"], "left").withColumn("c", F.sum(F.coalesce("c", F.lit(0))).over(after)).filter("c > 0")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("z")
    own = lambda *by: F.pmod(F.xxhash64(*by), F.lit(salt)).cast("int").alias("z")
    a = s.select("k", F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i")).distinct().select("*", own("lat_i", "lon_i")).repartition(width, "k", "z")
    b = later.select("k", "c", F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j"), spread).repartition(width, "k", "z")
    dist = haversine(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"))
    far = a.hint("merge").join(b, ["k", "z"]).withColumn("dist", dist).groupBy("k", F.col("lat_i").alias("lat"), F.col("lon_i").alias("lon")).agg(F.sum("c").alias("n1"), F.sum(F.col("c") * F.col("dist")).alias("s1"), F.min("dist").alias("l1"))
    i = s.select("k", F.col("sid").alias("i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"), own("sid")).repartition(width, "k", "z")
    j = s.select("k", F.col("sid").alias("j"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j"), spread).repartition(width, "k", "z")
    near = i.hint("merge").join(j, ["k", "z"]).filter("i < j").withColumn("dist", dist).groupBy(F.col("i").alias("sid")).agg(F.count(F.lit(1)).alias("n2"), F.sum("dist").alias("s2"), F.min("dist").alias("l2"))
    x = s.join(far, ["k", "lat", "lon"], "left").join(near, "sid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("n1") + zero("n2")
    return x.select(F.col("sid").alias("i"), n.alias("n"), F.try_divide(zero("s1") + zero("s2"), n).alias("mean"), F.least("l1", "l2").alias("least")).filter("n > 0")


def weighted_median(values: DataFrame, value: str, weight: str, bins: int = 4096, few: int = 100_000) -> tuple[int, float | None, float | None]:
    """The weights' sum, the median of values that count ``weight`` times, and the least value.

    The bins that hold the two middle places are cut into bins again until few values are left
    in them, so no task holds all distinct values.
    """
    row = values.agg(F.sum(weight).alias("n"), F.min(value).alias("a"), F.max(value).alias("z")).first()  # one row
    n = int(row.n or 0)
    if not n:
        return 0, None, None

    def place(k: int) -> float:
        """The value of place k, from 0."""
        a, z, left, skip = row.a, row.z, values, 0
        while a < z:
            step = (z - a) / bins
            at = F.least(F.floor((F.col(value) - a) / step), F.lit(bins - 1)) if step else F.lit(0)
            sums = left.groupBy(at.alias("b")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("rows"), F.min(value).alias("a"), F.max(value).alias("z")).orderBy("b").collect()  # a row for each bin
            for s in sums:
                if k < skip + s.w:
                    break
                skip += s.w
            a, z = s.a, s.z
            left = left.filter(F.col(value).between(a, z))
            if a < z and s.rows <= few:
                for v, w in left.groupBy(value).agg(F.sum(weight)).orderBy(value).collect():  # few rows
                    skip += w
                    if k < skip:
                        return v
        return a

    low = place((n - 1) // 2)
    high = low if n % 2 else place(n // 2)
    return n, low + (high - low) * 0.5, row.a


def all_distances(stations: DataFrame) -> DataFrame:
    """``dist, w``: the distances of all pairs of stations, each with the number of pairs that have it by their places."""
    n = F.col("n_i")
    w: Column = F.when(F.col("same"), F.floor(n * (n - 1) / 2)).otherwise(n * F.col("n_j")).cast("long")
    return tile_pairs(counted(stations)).select("dist", w.alias("w")).filter("w > 0")
