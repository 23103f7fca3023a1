"""Queries over files: tables written and read back, images made from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import images as I
from tidemark.operators import series as T
from tidemark.operators import vectors as V
from tidemark.plans.basic import FACTS, query_into, rounded
from tidemark.sources import tables as X
from tidemark.sources.tables import facts, table

QUERIES, SQL = {}, {}
query = query_into(QUERIES, SQL)

SIDE = 8


@query("o01_read_fact_csv", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, sf):
    path = X.shared_folder(spark, "facts-csv")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    rows.write.csv(path, header=True, encoding="UTF-8")
    schema = X.T.StructType([X.T.StructField("o_orderkey", X.T.LongType()), *[X.T.StructField(c, X.T.StringType()) for c in ("o_orderstatus", "price", "day")]])
    return rounded(X.coerce_numeric(X.read_fact_csv(spark, path, schema), "price"), price=2)


@query("o03_write_table", f"WITH {FACTS} SELECT region, year::BIGINT AS year, round(sum(measure), 2) AS y FROM facts GROUP BY 1, 2")
def _(spark, sf):
    path = X.shared_folder(spark, "totals")
    X.write_table(T.total_by(facts(spark, sf), ["region", "year"], "measure"), path, ["region"])
    return rounded(X.read_table(spark, path).select("region", "year", "y"), y=2)


def picture(spark, sf) -> DataFrame:
    """(vec_id, label, pixels): every embedding as an image of 8 x 8 pixels, RGB values interleaved."""
    level = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 100 + 128), F.lit(0)), F.lit(255)).cast("int")
    rgb = F.flatten(F.transform(F.transform("embedding", level), lambda p: F.array(p, 255 - p, F.floor(p / 2).cast("int"))))
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), rgb.alias("pixels"))


_written: dict = {}


def folder(spark, sf) -> str:
    """The folder of the images of a table's embeddings, written once in a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        path = X.shared_folder(spark, "images")
        X.write_images(picture(spark, sf).select("label", F.col("vec_id").alias("name"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.col("pixels").alias("rgb")), path)
        _written[key] = path
    return _written[key]


def stored(spark, sf) -> DataFrame:
    return X.read_images(spark, folder(spark, sf))


_LEVELS = """l AS (SELECT vec_id, label, i - 1 AS i, least(greatest(floor(embedding[i]::DOUBLE * 100 + 128), 0), 255)::INT AS p FROM embeddings, range(1, 65) r(i)),
px AS (SELECT vec_id, label, i, c, CASE c WHEN 0 THEN p WHEN 1 THEN 255 - p ELSE p // 2 END AS x FROM l, range(0, 3) q(c))"""


@query("o04_image_inventory", "SELECT label::VARCHAR AS label, count(*) AS n_images, 268 / 1024 AS avg_kb FROM embeddings GROUP BY 1")  # an uncompressed file of 8 x 8 pixels has 268 bytes
def _(spark, sf):
    return X.image_inventory(spark, folder(spark, sf))


@query("o05_read_images", f"WITH {_LEVELS} SELECT vec_id, label::VARCHAR AS label, 8::BIGINT AS height, 8::BIGINT AS width, 3::BIGINT AS channels, 192::BIGINT AS n_bytes, printf('%02X%02X%02X', p // 2, 255 - p, p) AS first_bgr FROM l WHERE i = 0")
def _(spark, sf):
    df = stored(spark, sf)
    return rounded(df.select(S.frame_number("path").alias("vec_id"), "label", "height", "width", "channels", F.octet_length("bgr").alias("n_bytes"), F.hex(F.substring("bgr", 1, 3)).alias("first_bgr")))


_MARK = "('0x' || substr(md5(label || ':' || (vec_id // 20) || ':7'), 1, 8))::BIGINT % 100"
_SPLIT = f"CASE WHEN {_MARK} < 70 THEN 'train' WHEN {_MARK} < 85 THEN 'val' ELSE 'test' END"


@query("o06_write_vectors", f"SELECT vec_id, label::BIGINT AS label, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE {_SPLIT} = 'test'")
def _(spark, sf):
    path = X.shared_folder(spark, "vectors")
    X.write_vectors(V.block_split(table(spark, sf, "embeddings"), "label", "vec_id", 20), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    rows = X.read_vectors(spark, path, "test")
    return rounded(rows.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"), total.alias("total")), first=6, total=4)


_MEANS, _DEVIATIONS = (0.5, 0.45, 0.25), (0.25, 0.2, 0.125)
_PICK = "CASE c WHEN 0 THEN {0[0]} WHEN 1 THEN {0[1]} ELSE {0[2]} END::DOUBLE"


@query("o24_scale_pixels", f"WITH {_LEVELS} SELECT vec_id, i * 3 + c AS pos, round((x / 255.0::DOUBLE - {_PICK.format(_MEANS)}) / {_PICK.format(_DEVIATIONS)}, 6) AS scaled, round(x::DOUBLE, 6) AS back FROM px")
def _(spark, sf):
    df = picture(spark, sf).withColumn("scaled", S.scale_pixels("pixels", _MEANS, _DEVIATIONS)).withColumn("back", S.unscale_pixels("scaled", _MEANS, _DEVIATIONS))
    rows = df.select("vec_id", F.posexplode(F.arrays_zip("scaled", "back")).alias("pos", "x"))
    return rounded(rows.select("vec_id", "pos", "x.scaled", "x.back"), scaled=6, back=6)


@query("o25_resize_images", f"WITH {_LEVELS} SELECT vec_id, ((i // 16) * 4 + (i % 8) // 2) * 3 + c AS pos, round_even(avg(x), 0)::BIGINT AS value FROM px GROUP BY 1, 2")  # half of the size: a pixel is the mean of four
def _(spark, sf):
    small = I.resize_images(stored(spark, sf), SIDE // 2, SIDE // 2)
    return rounded(small.select(S.frame_number("path").alias("vec_id"), F.posexplode("pixels").alias("pos", "value"))).withColumn("value", F.col("value").cast("long"))


@query("o31_manifest_to_images", f"SELECT vec_id, label::VARCHAR AS label, {_SPLIT} AS split, 192::BIGINT AS n_bytes FROM embeddings WHERE {_SPLIT} <> 'train'")
def _(spark, sf):
    manifest = V.block_split(picture(spark, sf), "label", "vec_id", 20).where("split <> 'train'")
    manifest = manifest.select("label", "split", F.concat(F.lit("data/"), "label", F.lit("/"), "vec_id", F.lit(".png")).alias("path"))
    found = I.manifest_to_images(manifest, stored(spark, sf))
    return rounded(found.select(S.frame_number("path").alias("vec_id"), "label", "split", F.octet_length("bgr").alias("n_bytes")))


@query("o55_channel_stats", f"WITH {_LEVELS} SELECT c AS channel, round(avg(x / 255.0::DOUBLE), 8) AS mean, round(stddev_pop(x / 255.0::DOUBLE), 8) AS deviation FROM px WHERE {_SPLIT} = 'train' GROUP BY 1")
def _(spark, sf):
    train = V.block_split(picture(spark, sf), "label", "vec_id", 20).where("split = 'train'")
    return rounded(I.channel_stats(train), mean=8, deviation=8)


@query("o56_brightness_stats", f"""WITH {_LEVELS}, g AS (SELECT vec_id, label, i, sum(x * CASE c WHEN 0 THEN 0.299::DOUBLE WHEN 1 THEN 0.587 ELSE 0.114 END) AS g FROM px GROUP BY 1, 2, 3),
b AS (SELECT vec_id, label, avg(g) AS brightness, stddev_pop(g) AS contrast FROM g GROUP BY 1, 2), m AS (SELECT vec_id, avg(x) FILTER (c = 0) AS red, avg(x) FILTER (c = 1) AS green, avg(x) FILTER (c = 2) AS blue FROM px GROUP BY 1)
SELECT label::VARCHAR AS label, round(avg(brightness), 4) AS brightness, round(avg(contrast), 4) AS contrast, round(avg(red), 4) AS red, round(avg(green), 4) AS green, round(avg(blue), 4) AS blue FROM b JOIN m USING (vec_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(I.brightness_by_class(I.brightness_stats(stored(spark, sf))), brightness=4, contrast=4, red=4, green=4, blue=4)
