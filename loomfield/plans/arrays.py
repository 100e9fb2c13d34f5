"""Exact sums, images as arrays, geometry of matches and principal axes, over values of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators import exact as E
from loomfield.operators import homography as H
from loomfield.operators import images as I
from loomfield.operators import neardup as N
from loomfield.operators import projection as J
from loomfield.plans.registering import query
from loomfield.storage import stored


@query("""WITH v AS (SELECT l_returnflag, l_linestatus, unnest([1e16::DECIMAL(38, 4), l_quantity::DECIMAL(38, 4) / 4, -1e16::DECIMAL(38, 4)]::DECIMAL(38, 4)[]) AS x FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(x)::DOUBLE AS value FROM v GROUP BY ALL""")
def exact_totals(t):
    """Quarters of quantities among terms of 1e16 that cancel: a plain sum of doubles loses them."""
    terms = F.explode(F.array(F.lit(1e16), F.col("l_quantity").cast("double") / 4, F.lit(-1e16)))
    return E.exact_sums(t("lineitem").select("l_returnflag", "l_linestatus", terms.alias("x")), ["l_returnflag", "l_linestatus"], "x").drop("error")


def pictures(t) -> DataFrame:
    """(id, luma): a picture of 32 by 32 for each vector under twice its id, and of every fifth one its mirror image
    with a little noise under the next number."""
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    at = lambda k: F.when(F.col("copy") == 1, 31 - k % 32).otherwise(k % 32)
    value = lambda k: F.element_at("e", ((at(k) * 3 + F.floor(k / 32) * 5) % 64 + 1).cast("int"))
    noise = lambda k: F.when(F.col("copy") == 1, (k * 31 + F.col("vec_id")) % 3 - 1).otherwise(0)
    luma = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 300 * value(k)) + noise(k))).cast("int"))
    return e.filter("copy = 0 OR vec_id % 5 = 0").select((2 * F.col("vec_id") + F.col("copy")).alias("id"), luma.alias("luma"))


@query()
def luma_near_pairs(t):
    """Pictures that are near duplicates, mirrored or not, from their luma values on: pairs of kinds of fingerprint, and
    the other pictures of a kind beside its first one."""
    kinds, members = N.representatives(stored(I.luma_fingerprints(pictures(t), "id", "luma"), "luma"))
    return N.with_members(N.near_pairs(kinds, 4, 10), members)


@query()
def luma_near_members(t):
    """The pictures of each kind of fingerprint."""
    return N.representatives(I.luma_fingerprints(pictures(t), "id", "luma"))[1]


@query()
def texture_patterns(t):
    """Local binary patterns of each picture under a mask with holes."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: k % 37 != F.col("id") % 37)
    rows = pictures(t).withColumns({"width": F.lit(32), "mask": mask})
    found = I.texture_histograms(rows, "id", "luma", "width", "mask")
    return found.select("id", "pixels", F.transform("histogram", lambda x: F.round(x, 9)).alias("histogram"))


_BYTES = "list_transform(embedding, lambda x: printf('%02x', CAST(floor(128 + 100 * x::DOUBLE) AS BIGINT) % 256))"


@query(f"""SELECT vec_id, sha256(unhex('00000003' || '00000007' || array_to_string(list_slice({_BYTES}, 1, 63), ''))) AS digest FROM embeddings""")
def pixel_digests(t):
    """Vectors as images of 3 by 7 pixels."""
    byte = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 63), lambda x: F.lpad(F.hex(F.pmod(F.floor(128 + 100 * x), F.lit(256))), 2, "0"))
    return t("embeddings").select("vec_id", I.pixel_digest(F.lit(3), F.lit(7), F.unhex(F.array_join(byte, ""))).alias("digest"))


def match_pairs(t) -> DataFrame:
    """Pairs of images with 32 matches each: points from a vector, mapped by a plane with perspective; of
    every match for which (place + id) % 7 < id % 4 the target is another point, and so are all of every ninth pair."""
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    part = lambda k: F.pmod(F.element_at("e", (k + 1).cast("int")) * 1000, F.lit(1.0))
    x, y = (lambda k: 20 + 600 * part(2 * k)), (lambda k: 20 + 440 * part(2 * k + 1))
    w = lambda k: 1 + 1e-4 * x(k) - 5e-5 * y(k)
    bad = lambda k: (F.pmod(k + F.col("vec_id"), F.lit(7)) < F.col("vec_id") % 4) | (F.col("vec_id") % 9 == 0)
    u = lambda k: F.when(bad(k), 640 * part((2 * k + 33) % 64)).otherwise((0.9 * x(k) - 0.2 * y(k) + 40) / w(k))
    v = lambda k: F.when(bad(k), 480 * part((2 * k + 18) % 64)).otherwise((0.15 * x(k) + 1.05 * y(k) - 20) / w(k))
    each = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(x(k).alias("x"), y(k).alias("y"), u(k).alias("u"), v(k).alias("v")))
    sizes = {"left_width": 640, "left_height": 480, "right_width": 640, "right_height": 480}
    return e.select(F.col("vec_id").alias("pair_id"), *[F.lit(n).alias(c) for c, n in sizes.items()], each.alias("matches"))


@query()
def verified_matches(t):
    """Which pairs a plane explains, by how many matches, and the mapping's numbers."""
    found = H.verified_pairs(match_pairs(t))
    return found.select("pair_id", "reason", "matches", "inliers", F.round("inlier_ratio", 9).alias("inlier_ratio"), F.transform("mapping", lambda x: F.round(x, 6)).alias("mapping"), "inlier_places")


@query()
def principal_coordinates(t):
    """All vectors on the four axes of largest variance."""
    e = t("embeddings")
    axes = J.principal_axes(e, "embedding", 4, spare=28)
    return J.projected(e, "vec_id", "embedding", axes).select(F.col("id").alias("vec_id"), F.transform("coordinates", lambda x: F.round(x, 5)).alias("coordinates"))
