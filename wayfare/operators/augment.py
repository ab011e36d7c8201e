"""Deterministic attributes from ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.expr import inverse_cdf, with_uniform, zipf

# Salts, category weights, price parameters.
SALTS = {"vertical": 0x5EED_0001, "region": 0x5EED_0002, "merchant": 0x5EED_0003, "price": 0x5EED_0004, "device": 0x5EED_0005, "rating": 0x5EED_0006, "merchant_region": 0x5EED_0011, "merchant_rating": 0x5EED_0012, "merchant_radius": 0x5EED_0013, "merchant_minutes": 0x5EED_0014}
VERTICAL_WEIGHTS = {"food_delivery": 0.22, "restaurant": 0.18, "grocery": 0.25, "pharmacy": 0.10, "commerce": 0.15, "lifestyle": 0.10}
PRICES = {"food_delivery": (2.5, 0.5), "restaurant": (3.0, 0.6), "grocery": (1.6, 0.7), "pharmacy": (2.2, 0.6), "commerce": (3.4, 0.9), "lifestyle": (3.1, 1.0)}
DEVICE_WEIGHTS = [0.58, 0.18, 0.17, 0.07]
REGIONS, ZIPF, PER_VERTICAL, MIN_PRICE, SEED = 12, 1.1, 120, 0.99, 42


def user_attributes(users: DataFrame, seed: int = SEED) -> DataFrame:
    """(user_id, region_id, device): Zipf-sized regions and weighted devices."""
    df = with_uniform(users.select("user_id"), "user_id", seed, SALTS["region"], "_r")
    df = with_uniform(df, "user_id", seed, SALTS["device"], "_d")
    return df.select("user_id", inverse_cdf(F.col("_r"), zipf(REGIONS, ZIPF)).alias("region_id"), inverse_cdf(F.col("_d"), DEVICE_WEIGHTS).alias("device"))


def root_verticals(sizes: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(root, vertical): largest root first, to the vertical furthest below its share; ties to smaller ids.

    Each step depends on the one before, so this folds over one array of the roots (a category tree has tens of them).
    """
    w = weights or list(VERTICAL_WEIGHTS.values())
    total = sum(w)
    lists = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "root"))).alias("r"), F.sum("n").alias("t"))
    start = F.struct(F.transform(F.array(*[F.lit(x / total) for x in w]), lambda x: x * F.col("t")).alias("left"), F.array().cast("array<struct<root:int,vertical:int>>").alias("out"))

    def step(acc, x):
        pick = F.array_position(acc["left"], F.array_max(acc["left"])).cast("int") - 1
        left = F.transform(acc["left"], lambda v, i: F.when(i == pick, v + x["m"]).otherwise(v))
        return F.struct(left.alias("left"), F.concat(acc["out"], F.array(F.struct(x["root"].cast("int").alias("root"), pick.alias("vertical")))).alias("out"))

    return lists.select(F.inline(F.aggregate("r", start, step)["out"]))


def merchants(spark: SparkSession, seed: int = SEED, per_vertical: int = PER_VERTICAL) -> DataFrame:
    """A table of merchants with ids in sequence, per_vertical in each vertical."""
    rows = spark.range(per_vertical * len(VERTICAL_WEIGHTS)).select(F.col("id").alias("merchant_id"), F.floor(F.col("id") / per_vertical).cast("int").alias("vertical"))
    return merchant_attributes(rows, seed)


def merchant_attributes(merchants_: DataFrame, seed: int = SEED) -> DataFrame:
    """merchants (merchant_id, vertical) with Zipf-sized regions, Beta(8, 2) ratings, radii of 2 to 15 km and 15 to 74 minutes, from hashed uniforms."""
    df = merchants_.select("merchant_id", "vertical")
    for c in ("region", "rating", "radius", "minutes"):
        df = with_uniform(df, "merchant_id", seed, SALTS[f"merchant_{c}"], f"_{c}")
    inside = F.greatest(F.least(F.col("_rating"), F.lit(1 - LEAST_UNIFORM)), F.lit(LEAST_UNIFORM))
    return df.select(
        "merchant_id", "vertical", inverse_cdf(F.col("_region"), zipf(REGIONS, ZIPF)).alias("region_id"), F.round(beta_quantile(inside, 8) * 5, 2).alias("rating"),
        F.round(2 + 13 * F.col("_radius"), 1).alias("delivery_radius_km"), (15 + F.floor(60 * F.col("_minutes"))).cast("int").alias("avg_delivery_minutes"),
    )


def item_merchants(items: DataFrame, merchant_table: DataFrame) -> DataFrame:
    """(item_id, vertical, merchant_id): a hashed merchant of the item's own vertical."""
    nr = F.row_number().over(Window.partitionBy("vertical").orderBy("merchant_id")) - 1
    m = merchant_table.select("vertical", "merchant_id", nr.alias("_i"), F.count(F.lit(1)).over(Window.partitionBy("vertical")).alias("_n"))
    df = with_uniform(items.select("item_id", "vertical"), "item_id", 0, F.lit(SALTS["merchant"]) + F.col("vertical"), "_u")
    sizes = m.select("vertical", "_n").distinct()
    df = df.join(sizes, "vertical").withColumn("_i", (F.floor(F.col("_u") * F.col("_n")) % F.col("_n")).cast("int"))
    return df.join(m.drop("_n"), ["vertical", "_i"]).select("item_id", "vertical", "merchant_id")


# Coefficients of Wichura's AS 241 (PPND16), lowest power first: numerators and denominators of the
# centre, of the tails, and of the far tails.
QUANTILE = {
    "a": [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    "b": [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
    "c": [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    "d": [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
    "e": [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    "f": [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
}
LEAST_UNIFORM, HALVINGS = 1e-9, 50


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal's quantile of u in (0, 1), to about 16 digits."""
    ratio = lambda top, bottom, x: _polynomial(QUANTILE[top], x) / _polynomial(QUANTILE[bottom], x)
    q = u - 0.5
    r = F.sqrt(-F.log(F.least(u, 1 - u)))
    tail = F.when(r <= 5.0, ratio("c", "d", r - 1.6)).otherwise(ratio("e", "f", r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio("a", "b", F.lit(0.180625) - q * q)).otherwise(F.signum(q) * tail)


def beta_quantile(u: Column, a: int) -> Column:
    """Beta(a, 2) has the distribution function (a + 1)x^a - a x^(a + 1); inverted binary digit by digit."""
    steps = F.array(*[F.lit(2.0**-i) for i in range(1, HALVINGS + 1)])
    below = lambda x: (a + 1) * F.pow(x, F.lit(float(a))) - a * F.pow(x, F.lit(float(a + 1))) < u
    return F.aggregate(steps, F.lit(0.0), lambda x, s: F.when(below(x + s), x + s).otherwise(x))


def beta72_quantile(u: Column) -> Column:
    return beta_quantile(u, 7)


def item_prices(items: DataFrame, seed: int = SEED) -> DataFrame:
    """(item_id, vertical, price, base_rating): log-normal prices by vertical and Beta(7, 2) ratings, from hashed uniforms."""
    df = with_uniform(items.select("item_id", "vertical"), "item_id", seed, F.lit(SALTS["price"]) + F.col("vertical"), "_p")
    df = with_uniform(df, "item_id", seed, SALTS["rating"], "_r")
    inside = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - LEAST_UNIFORM)), F.lit(LEAST_UNIFORM))
    mu, sigma = (F.element_at(F.array(*[F.lit(p[i]) for p in PRICES.values()]), F.col("vertical") + 1) for i in (0, 1))
    price = F.round(F.greatest(F.exp(mu + sigma * normal_quantile(inside("_p"))), F.lit(MIN_PRICE)), 2)
    return df.select("item_id", "vertical", price.alias("price"), F.round(beta72_quantile(inside("_r")) * 5, 2).alias("base_rating"))
