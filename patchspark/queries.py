"""The registered queries of the image and vector operators, each with the SQL it is held against.

SQL of whole sampler runs is put together by sqltext.Chain, independently of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchspark.functions import geometry as g
from patchspark.functions import schedule as n
from patchspark.operators import kernel as k
from patchspark.operators import layout as lo
from patchspark.operators import measures as m
from patchspark.operators import patches as w
from patchspark.operators import quantised as pq
from patchspark.operators import resample as r
from patchspark.operators import samplers as sm
from patchspark.plans import catalogue as c
from patchspark.sources import bands as b
from patchspark.sources import files
from patchspark.sources import steps
from patchspark.sources import tables as s
from patchspark.sqltext import Chain, levels, number

QUERIES, SQL = {}, {}

PIXELS = """v0 AS (SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
p0 AS (SELECT label AS image_id, (r % 3)::INT AS c, (r // 3)::INT AS y, unnest(range(64))::INT AS x, unnest(embedding)::DOUBLE AS e FROM v0 WHERE r // 3 < n // 3),
pixels AS (SELECT image_id, c, y, x, greatest(least(4 * e, 1.0), -1.0) AS v FROM p0),
dims AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY 1)"""
NORMAL = " * ".join(("sqrt(-2 * ln({}))", "cos(2 * pi() * {})")).format(
    *(f"((('0x' || substr(md5(concat_ws(':', {i}, vec_id, i)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)" for i in (1, 2)))
VECTORS = f"""vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
queries AS (SELECT vec_id AS query_id, list_transform(range(1, 65), lambda i: 0.6 * v[i] + 0.4 * {NORMAL}) AS x FROM vectors)"""
CATALOG = """catalog AS (SELECT o_orderkey AS image_id, (64 + (7 * o_custkey) % 4000)::INT AS height, (64 + (13 * o_orderkey) % 6000)::INT AS width,
CASE WHEN o_orderkey % 3 = 0 THEN '(' || 2 * (64 + (7 * o_custkey) % 4000) || ', ' || 3 * (64 + (13 * o_orderkey) % 6000) || ')' END AS request FROM orders),
asked AS (SELECT *, CASE WHEN request IS NULL THEN height ELSE 2 * height END AS sample_height, CASE WHEN request IS NULL THEN width ELSE 3 * width END AS sample_width FROM catalog)"""
LOG = """stage_log AS (SELECT user_id AS run_id, event_id AS seq, event_type AS label, value AS seconds, event_type = 'view' AS nested, CASE event_type WHEN 'signup' THEN 'load' WHEN 'error' THEN 'io' WHEN 'purchase' THEN 'compute' ELSE 'other' END AS kind, epoch(ts)::DOUBLE AS start FROM events),
runs AS (SELECT run_id, 1.25 * sum(seconds) AS wall FROM stage_log GROUP BY 1)"""
FLOW = "schedule AS (SELECT t, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE 0.9999::DOUBLE * (1 - (t - 1) / 9.0::DOUBLE) END AS alpha FROM (SELECT unnest(range(11))::INT AS t)), flow AS (SELECT t, alpha, 1 - alpha AS sigma FROM schedule)"


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) + 0.0 for x in cols})


def catalog(spark, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    h, w = 64 + (7 * F.col("o_custkey")) % 4000, 64 + (13 * F.col("o_orderkey")) % 6000
    request = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("(%d, %d)", (2 * h).cast("long"), (3 * w).cast("long")))
    return o.select(F.col("o_orderkey").alias("image_id"), h.cast("int").alias("height"), w.cast("int").alias("width"), request.alias("request"))


def noisy(spark, d: str) -> DataFrame:
    """All vectors, each with noise of its own."""
    x = F.transform("v", lambda e, i: 0.6 * e + 0.4 * n.keyed_normal(F.col("vec_id"), i + 1))
    return s.vectors(spark, d).select(F.col("vec_id").alias("query_id"), x.alias("x"))


def flat(df: DataFrame, key: str, v: str) -> DataFrame:
    return rounded(df.select(key, F.posexplode(v).alias("i", "e")), "e")


def log(spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "load").when(F.col("event_type") == "error", "io").when(F.col("event_type") == "purchase", "compute").otherwise("other")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("label"), F.col("value").alias("seconds"), (F.col("event_type") == "view").alias("nested"),
                    kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"))


@query("SELECT query_id, (j - 1)::INT AS i, round(sum(p * v[j]) / sum(p), 6) + 0 AS e FROM (SELECT query_id, v, exp(l - max(l) "
       "OVER (PARTITION BY query_id)) AS p FROM (SELECT query_id, v, -list_sum(list_transform(range(1, 65), lambda i: (x[i] - 0.6 "
       "* v[i]) * (x[i] - 0.6 * v[i]))) / 0.32 AS l FROM queries, vectors)), range(1, 65) t(j) GROUP BY ALL", VECTORS)
def kernel_regression(spark, d):
    return flat(k.kernel_regress(noisy(spark, d), s.vectors(spark, d).select("vec_id", "v"), 0.6, 0.4), "query_id", "x_hat")


@query("SELECT query_id, rank::INT AS rank, vec_id, round(d2, 6) + 0 AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
       "ORDER BY d2, vec_id) AS rank FROM (SELECT query_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: (x[i] - v[i]) "
       "* (x[i] - v[i]))) AS d2 FROM queries, vectors)) WHERE rank <= 5", VECTORS)
def nearest_flat(spark, d):
    return rounded(k.knn_flat(noisy(spark, d), s.vectors(spark, d), 5), "d2")


@query("SELECT query_id, (j - 1)::INT AS i, round(sum(p * v[j]) / sum(p), 6) + 0 AS e FROM (SELECT query_id, v, exp(l - max(l) "
       "OVER (PARTITION BY query_id)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank "
       "FROM (SELECT query_id, vec_id, v, list_sum(list_transform(range(1, 65), lambda i: (x[i] - v[i]) * (x[i] - v[i]))) AS d2, "
       "-list_sum(list_transform(range(1, 65), lambda i: (x[i] - 0.6 * v[i]) * (x[i] - 0.6 * v[i]))) / 0.32 AS l FROM queries, "
       "vectors)) WHERE rank <= 5), range(1, 65) t(j) GROUP BY ALL", VECTORS)
def nearest_regression(spark, d):
    q, v = noisy(spark, d), s.vectors(spark, d).select("vec_id", "v")
    return flat(k.knn_regress(q, v, k.require_k(k.knn_flat(q, v, 5), q, 5), 0.6, 0.4), "query_id", "x_hat")


#: The share of true neighbours that a search by lists must find, measured before it runs.
RECALL = 0.9


@query()
def nearest_ivf(spark, d):
    return rounded(lo.knn_ivf(noisy(spark, d), lo.lay_out(s.vectors(spark, d)), 5, 2, RECALL), "d2")


@query(SQL["nearest_flat"])
def nearest_all_lists(spark, d):
    """All lists probed: what the exact search gives."""
    return rounded(lo.knn_ivf(noisy(spark, d), lo.lay_out(s.vectors(spark, d)), 5, lo.LISTS), "d2")


@query(SQL["nearest_flat"])
def nearest_by_bounds(spark, d):
    """Exactly, from the lists that can hold a nearer row than the nearest lists gave."""
    return rounded(lo.nearest(noisy(spark, d), lo.lay_out(s.vectors(spark, d)), 5), "d2")


@query(SQL["kernel_regression"])
def regression_by_bounds(spark, d):
    """From the cells whose weights can matter."""
    return flat(lo.regress(noisy(spark, d), lo.lay_out(s.vectors(spark, d)), 0.6, 0.4), "query_id", "x_hat")


@query("SELECT 5 * count(*) AS asked, true AS reached, true AS cheap FROM queries", VECTORS)
def lists_pay(spark, d):
    """Whether audited lists give their share of all true neighbours from fewer than half of the rows."""
    q, v = steps.kept(noisy(spark, d)), steps.kept(s.vectors(spark, d).select("vec_id", "v"))
    laid = lo.lay_out(v)
    nprobe = lo.audited_probes(q, laid, 5, RECALL)
    hits = k.knn_flat(q, v, 5).select("query_id", "vec_id").join(lo.nearest(q, laid, 5, nprobe).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    seen = lo.needed(q, laid, lo.probing(nprobe)).select((2 * F.col("scanned") < F.col("rows")).alias("cheap"))
    return hits.agg(F.count(F.lit(1)).alias("asked"), (F.count("hit") >= RECALL * F.count(F.lit(1))).alias("reached")).crossJoin(seen)


@query()
def nearest_quantised(spark, d):
    return rounded(pq.knn_ivfpq(noisy(spark, d), pq.fit_ivfpq(s.vectors(spark, d).select("vec_id", "v")), 5, 4, recall=RECALL), "d2")


@query()
def quantised_regression(spark, d):
    q, v = noisy(spark, d), s.vectors(spark, d).select("vec_id", "v")
    found = pq.knn_ivfpq(k.scale_queries(q, 0.6), pq.fit_ivfpq(v), 5, 4, recall=RECALL)
    return flat(k.knn_regress(q, v, k.require_k(found, q, 5), 0.6, 0.4), "query_id", "x_hat")


@query("SELECT m AS method, 5 * count(*) AS asked, true AS reached FROM queries, (VALUES ('lists'), ('codes')) t(m) GROUP BY ALL", VECTORS)
def recalls(spark, d):
    """Whether the searches by lists find their share of all queries' true neighbours."""
    q, v = noisy(spark, d), s.vectors(spark, d).select("vec_id", "v")
    truth = steps.kept(k.knn_flat(q, v, 5).select("query_id", "vec_id"))
    found = {"lists": lo.knn_ivf(q, lo.lay_out(v), 5, 2, RECALL), "codes": pq.knn_ivfpq(q, pq.fit_ivfpq(v), 5, 4, recall=RECALL)}
    out = None
    for method, rows in found.items():
        hits = truth.join(rows.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
        one = hits.agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("hits")).select(
            F.lit(method).alias("method"), "asked", (F.col("hits") >= RECALL * F.col("asked")).alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT (j - 1)::INT AS i, round(avg(v[j]), 6) + 0 AS mean FROM vectors, range(1, 65) t(j) GROUP BY j", VECTORS)
def mean_of_vectors(spark, d):
    return rounded(k.dataset_mean(s.vectors(spark, d)), "mean")


@query("SELECT image_id, (max(y) + 1)::INT AS height, (max(x) + 1)::INT AS width, count(*) AS n, round(sum(v * (c * 10000 + y * "
       "100 + x)), 4) + 0 AS mark FROM pixels GROUP BY 1", PIXELS)
def dense_and_long(spark, d):
    px = s.to_pixels(s.to_images(s.pixels(spark, d)))
    place = F.col("c") * 10000 + F.col("y") * 100 + F.col("x")
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col("v") * place), 4) + 0.0).alias("mark"))


@query("SELECT image_id, c, y, x, trunc(greatest(least((v + 1) * 0.5 * 255, 255.0), 0.0))::INT AS u FROM pixels", PIXELS)
def eight_bit(spark, d):
    return s.pixels(spark, d).select("image_id", "c", "y", "x", s.to_uint8(g.unnormalize(F.col("v"))).alias("u"))


@query("SELECT image_id, c, y, x, trunc(greatest(least((v + 1) * 0.5 * 255, 255.0), 0.0))::INT AS u FROM pixels", PIXELS)
def image_files(spark, d):
    """Written as PNG and read again."""
    images = s.to_images(s.pixels(spark, d).withColumn("v", g.unnormalize(F.col("v"))))
    folder = steps.scratch(spark, "images")
    files.write_images(images.withColumn("path", F.format_string("%d.png", "image_id")), folder)
    px = s.to_pixels(files.read_images(spark, folder))
    return px.select(F.regexp_extract("image_id", r"(\d+)\.png$", 1).cast("int").alias("image_id"), "c", "y", "x", F.round(F.col("v") * 255).cast("int").alias("u"))


@query("SELECT image_id, c, y, x, trunc(greatest(least((v + 1) * 0.5 * 255, 255.0), 0.0))::INT AS u FROM pixels", PIXELS)
def banded_files(spark, d):
    """Written as PNG and read again, by bands of a few lines."""
    cells, folder = 4096, steps.scratch(spark, "images")
    bands = b.to_bands(s.pixels(spark, d).withColumn("v", g.unnormalize(F.col("v"))), cells)
    b.write_bands(bands.withColumn("path", F.format_string("%d.png", "image_id")), folder)
    px = b.band_pixels(b.read_bands(spark, folder, cells=cells))
    return px.select(F.regexp_extract("image_id", r"(\d+)\.png$", 1).cast("int").alias("image_id"), "c", "y", "x", F.round(F.col("v") * 255).cast("int").alias("u"))


@query("SELECT image_id, c, (y - (h - (h - h % 16)) // 2)::INT AS y, (x - (w - (w - w % 16)) // 2)::INT AS x, v FROM pixels JOIN "
       "dims USING (image_id) WHERE y >= (h % 16) // 2 AND y < (h % 16) // 2 + h - h % 16 AND x >= (w % 16) // 2 AND x < (w % 16) "
       "// 2 + w - w % 16", PIXELS)
def crop(spark, d):
    return g.crop_to_multiple(s.pixels(spark, d))


@query("SELECT image_id, c, y, x, v FROM (SELECT image_id, c, y, unnest(list_distinct([x, w - 1 - x]))::INT AS x, v FROM pixels "
       "JOIN dims USING (image_id) WHERE x <= w - 1 - x)", PIXELS)
def symmetrized(spark, d):
    return g.symmetrize(s.pixels(spark, d), "horizontal", "left")


@query("SELECT image_id, c, unnest(list_distinct([y, h - 1 - y]))::INT AS y, x, v FROM pixels "
       "JOIN dims USING (image_id) WHERE y >= h - 1 - y", PIXELS)
def symmetrized_upright(spark, d):
    """The lower half onto the upper."""
    return g.symmetrize(s.pixels(spark, d), "vertical", "bottom")


@query("SELECT image_id, c, ((y + h // 2) % h)::INT AS y, ((x + w // 2) % w)::INT AS x, v FROM pixels JOIN dims USING (image_id)", PIXELS)
def rolled(spark, d):
    return g.roll(s.pixels(spark, d), "diag")


@query("SELECT image_id, c, (y + a * h)::INT AS y, (x + b * w)::INT AS x, v FROM pixels JOIN dims USING (image_id), range(2) t(a), "
       "range(3) u(b)", PIXELS)
def tiled(spark, d):
    return g.tile_grid(s.pixels(spark, d), 2, 3)


@query("SELECT image_id, r::INT AS rows, k::INT AS cols, c, (y + a * h)::INT AS y, (x + b * w)::INT AS x, v FROM pixels JOIN dims "
       "USING (image_id), "
       "(VALUES (2, 2), (3, 3)) g(r, k), range(3) t(a), range(3) u(b) WHERE a < r AND b < k", PIXELS)
def tiled_grids(spark, d):
    return g.tile_grids(s.pixels(spark, d), "both")


@query("SELECT image_id, c, y, x, v, CASE WHEN (y >= h // 4 AND y < 3 * h // 4) AND NOT (x >= w // 4 AND x < 3 * w // 4) THEN 1.0 "
       "ELSE 0.0 END::DOUBLE AS w FROM (SELECT p.*, h, d.w AS w FROM pixels p JOIN dims d USING (image_id))", PIXELS)
def shift_mask(spark, d):
    return g.with_size(s.pixels(spark, d)).select("image_id", "c", "y", "x", "v", g.shift_weight("both", "horiz").alias("w"))


@query("SELECT a.image_id, a.c, a.y, a.x, round((a.v + 0.5 * b.v) / 1.5, 6) + 0 AS v FROM pixels a JOIN dims USING (image_id) JOIN "
       "pixels b ON a.image_id = b.image_id AND a.c = b.c AND a.y = b.y AND a.x = (b.x + w // 2) % w", PIXELS)
def blended_views(spark, d):
    px = s.pixels(spark, d)
    return rounded(g.blend_shifts(px.withColumn("w", F.lit(1.0)).unionByName(g.roll(px, "horiz").withColumn("w", F.lit(0.5)))), "v")


@query("SELECT b.image_id, b.y AS py, b.x AS px, round(sum(p.v * (p.c * 9 + (p.y - b.y) * 3 + p.x - b.x + 1)), 6) + 0 AS mark, "
       "count(*) AS n FROM pixels b JOIN dims USING (image_id) JOIN pixels p ON p.image_id = b.image_id AND p.y BETWEEN b.y AND "
       "b.y + 2 AND p.x BETWEEN b.x AND b.x + 2 WHERE b.c = 0 AND b.y <= h - 3 AND b.x <= w - 3 GROUP BY ALL", PIXELS)
def windows(spark, d):
    p = w.extract_patches(s.pixels(spark, d), 3)
    mark = F.aggregate(F.transform("v", lambda e, i: e * (i + 1)), F.lit(0.0), lambda a, e: a + e)
    return p.select("image_id", "py", "px", (F.round(mark, 6) + 0.0).alias("mark"), F.size("v").cast("long").alias("n"))


@query("SELECT b.image_id, b.y AS py, b.x AS px FROM pixels b JOIN dims USING (image_id) JOIN pixels p ON p.c = 0 AND p.image_id "
       "= b.image_id AND p.y BETWEEN b.y AND b.y + 2 AND p.x BETWEEN b.x AND b.x + 2 WHERE b.c = 0 AND b.y <= h - 3 AND b.x <= "
       "w - 3 GROUP BY ALL HAVING max(abs(p.v)) < 0.9", PIXELS)
def masked_windows(spark, d):
    px = s.pixels(spark, d)
    mask = px.where("c = 0").select("image_id", "y", "x", (F.abs("v") < 0.9).alias("ok"))
    return w.masked_patches(w.extract_patches(px, 3), mask, 3).select("image_id", "py", "px")


def chained(build: Callable[[Chain], str], *ctes: str) -> Callable:
    """A query held against the pixels that build() gives."""
    chain = Chain(*(ctes or (PIXELS,)))
    return query(chain.pixels(build(chain)))


def _changed(t: Chain) -> str:
    w = t.windows("pixels", 3, 2)
    return t.fold(t.add(f"SELECT image_id, py, px, list_transform(v, lambda e: e * (1 + py) / (2 + px)) AS v FROM {w}"), "pixels", 3, 0.5)


@chained(_changed)
def folded(spark, d):
    """Every other window, changed by its place, so that overlaps differ and the last lines may be uncovered."""
    px = s.pixels(spark, d)
    p = w.extract_patches(px, 3, 2).withColumn("v", F.transform("v", lambda e: e * (1 + F.col("py")) / (2 + F.col("px"))))
    return rounded(w.fold(p, px, 0.5, 3, 2), "v")


@chained(lambda t: t.fold(t.windows("pixels", 3), "pixels", 3, 0.5))
def folded_back(spark, d):
    px = s.pixels(spark, d)
    return rounded(w.fold(w.extract_patches(px, 3), px, 0.5, 3), "v")


@query("SELECT dy::INT AS dy, dx::INT AS dx, round(exp(-2 * pow(-1 + dy / 3.0::DOUBLE, 2)) * exp(-2 * pow(-1 + dx / 3.0::DOUBLE, "
       "2)), 9) AS w, n "
       "FROM range(7) a(dy), range(7) b(dx), (SELECT count(*) AS n FROM pixels WHERE c = 0)", PIXELS)
def window_weights(spark, d):
    """The window, beside the number of places it is laid on."""
    places = s.pixels(spark, d).where("c = 0").agg(F.count(F.lit(1)).alias("n"))
    return w.gaussian_window(spark, 7, 0.5).crossJoin(F.broadcast(places)).select("dy", "dx", F.round("w", 9).alias("w"), "n")


@query("SELECT image_id, height, width FROM catalog WHERE least(height, width) >= 15", CATALOG)
def patchable(spark, d):
    sizes = catalog(spark, d).select("image_id", F.lit(0).alias("scale"), "height", "width")
    small = sizes.where("least(height, width) < 15")
    return w.check_patchable(sizes, 15, small).join(small, "image_id", "left_anti").select("image_id", "height", "width")


@query("SELECT image_id, (greatest(height - 14, 0)::BIGINT * greatest(width - 14, 0)) AS patches FROM catalog", CATALOG)
def patch_counts(spark, d):
    return catalog(spark, d).select("image_id", w.patch_count(F.col("height"), F.col("width"), 15).alias("patches"))


@query("SELECT t, round(alpha, 9) AS alpha, round(sigma, 9) AS sigma, n FROM flow, (SELECT count(*) AS n FROM embeddings)", FLOW)
def flow_schedule(spark, d):
    f = n.flow_linear(spark).crossJoin(s.vectors(spark, d).agg(F.count(F.lit(1)).alias("n")))
    return f.select("t", F.round("alpha", 9).alias("alpha"), F.round("sigma", 9).alias("sigma"), "n")


@query("SELECT event_id, t, round(sigma, 9) AS sigma FROM events, (SELECT t, CASE WHEN t = 0 THEN 0 ELSE pow(pow(80.0::DOUBLE, "
       "1 / 7.0::DOUBLE) + (10 - t) / 9.0::DOUBLE * "
       "(pow(0.002::DOUBLE, 1 / 7.0::DOUBLE) - pow(80.0::DOUBLE, 1 / 7.0::DOUBLE)), 7) END AS sigma FROM (SELECT unnest(range(11))::INT AS t)) WHERE event_id % 11 = t")
def warped_schedule(spark, d):
    """Each event with a step of the warped schedule."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 11).cast("int").alias("t"))
    return e.join(F.broadcast(n.ve_edm(spark, 10)), "t").select("event_id", "t", F.round("sigma", 9).alias("sigma"))


@chained(lambda t: t.noise("dims", 7, 1, 10, 0.5), PIXELS)
def first_noise(spark, d):
    return rounded(sm.init_noise(g.sizes(s.pixels(spark, d)), 3, 7, 1, 0.5, 10), "v")


@query("SELECT image_id, c, y, x, round(alpha * v + sigma * v * v, 6) + 0 AS xt, t FROM pixels, flow WHERE t > 0", PIXELS, FLOW)
def noised(spark, d):
    px = s.pixels(spark, d).crossJoin(F.broadcast(n.flow_linear(spark).where("t > 0")))
    return rounded(px.select("image_id", "c", "y", "x", n.add_noise(F.col("v"), F.col("v") * F.col("v"), F.col("alpha"), F.col("sigma")).alias("xt"), "t"), "xt")


@query("SELECT event_id, CASE WHEN value IS NULL THEN 10 ELSE greatest(1, (SELECT arg_min(t, [abs(sigma / (alpha + sigma) - value "
       "/ 1000), t]) FROM flow)) END::INT AS t FROM events", FLOW)
def noise_level_index(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("value") / 1000).alias("level"))
    found = n.index_for_noise_level(e.select("level").distinct(), n.flow_linear(spark))
    return e.join(found, e["level"].eqNullSafe(found["level"])).select("event_id", "t")


@query("SELECT image_id, c, y, x, round((v - alpha * v * v) / sigma, 6) + 0 AS eps, round(a2 * v * v + s2 * (v - alpha * v * v) "
       "/ sigma, 6) + 0 AS nxt FROM pixels, (SELECT alpha, sigma FROM flow WHERE t = 5), (SELECT alpha AS a2, sigma AS s2 FROM "
       "flow WHERE t = 4)", PIXELS, FLOW)
def one_step(spark, d):
    f = n.flow_linear(spark)
    px = s.pixels(spark, d).crossJoin(F.broadcast(f.where("t = 5"))).crossJoin(F.broadcast(f.where("t = 4").select(F.col("alpha").alias("a2"), F.col("sigma").alias("s2"))))
    hat = F.col("v") * F.col("v")
    eps = n.epsilon(F.col("v"), hat, F.col("alpha"), F.col("sigma"))
    return rounded(px.select("image_id", "c", "y", "x", eps.alias("eps"), n.step(hat, eps, F.col("a2"), F.col("s2")).alias("nxt")), "eps", "nxt")


@query("SELECT image_id, round(avg(abs(a.v - b.v)) * 127.5, 6) + 0 AS asymmetry FROM pixels a JOIN dims USING (image_id) JOIN pixels "
       "b USING (image_id, c, y) WHERE b.x = w - 1 - a.x GROUP BY 1", PIXELS)
def asymmetry(spark, d):
    return rounded(m.mirror_asymmetry(s.pixels(spark, d)), "asymmetry")


@query("SELECT image_id, round(avg(abs(a.v - b.v)) * 127.5, 6) + 0 AS asymmetry FROM pixels a JOIN dims USING (image_id) JOIN pixels "
       "b USING (image_id, c, x) WHERE b.y = h - 1 - a.y GROUP BY 1", PIXELS)
def asymmetry_upright(spark, d):
    return rounded(m.mirror_asymmetry(s.pixels(spark, d), "vertical"), "asymmetry")


@query("SELECT image_id, round(greatest(0, avg(CASE WHEN x = w - 1 THEN abs(v - f) END) - quantile_disc(gap, 0.5)) * 127.5, 6) "
       "+ 0 AS seam FROM (SELECT p.*, d.w, abs(v - lag(v) OVER l) AS gap, first(v) OVER l AS f FROM pixels p JOIN dims d USING "
       "(image_id) WINDOW l AS (PARTITION BY image_id, c, y ORDER BY x)) GROUP BY 1", PIXELS)
def seams(spark, d):
    return rounded(m.seam_error(s.pixels(spark, d)), "seam")


def _seam(at: str, other: str, side: str) -> str:
    return (f"SELECT image_id, greatest(0, avg(CASE WHEN {at} = {side} - 1 THEN abs(v - f) END) - quantile_disc(gap, 0.5)) * 127.5 AS seam FROM (SELECT p.*, d.h, d.w, "
            f"abs(v - lag(v) OVER l) AS gap, first(v) OVER l AS f FROM pixels p JOIN dims d USING (image_id) WINDOW l AS (PARTITION BY image_id, c, {other} ORDER BY {at})) GROUP BY 1")


@query(f"SELECT image_id, round(max(seam), 6) + 0 AS seam FROM ({_seam('x', 'y', 'w')} UNION ALL {_seam('y', 'x', 'h')}) GROUP BY 1", PIXELS)
def seams_both_ways(spark, d):
    return rounded(m.seam_error(s.pixels(spark, d), "both"), "seam")


@query("SELECT image_id, y, x, round(sqrt(sum(v * v)), 6) AS energy FROM pixels GROUP BY ALL", PIXELS)
def energy(spark, d):
    return rounded(m.grad_energy(s.pixels(spark, d)), "energy")


QUANTILE = ("e AS (SELECT image_id, y, x, sqrt(sum(v * v)) AS energy FROM pixels GROUP BY ALL)",
            "qs AS (SELECT image_id, energy AS q FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY energy) - 1 AS r, "
            "count(*) OVER (PARTITION BY image_id) AS n FROM e) WHERE r = round_even((n - 1) * 0.8::DOUBLE, 0))",
            "thin AS (SELECT image_id, c, y, x, energy > q AS mask, CASE WHEN energy > q THEN (energy - q) * v / energy ELSE 0 END AS g "
            "FROM pixels JOIN e USING (image_id, y, x) JOIN qs USING (image_id))")


@query("SELECT image_id, c, y, x, round(g, 6) + 0 AS v, mask FROM thin", PIXELS, *QUANTILE)
def thresholded(spark, d):
    return rounded(m.thresholded_grad(s.pixels(spark, d)), "v")


@query("SELECT image_id, c, y, x, round(greatest(least(v + 0.3 * CASE WHEN mask THEN ratio * g ELSE 0 END, 1), -1), 6) + 0 AS v "
       "FROM pixels JOIN thin USING (image_id, c, y, x) "
       "JOIN (SELECT image_id, sqrt(sum(v * v) / sum(g * g)) AS ratio FROM pixels JOIN thin USING (image_id, c, y, x) WHERE mask GROUP BY 1) USING (image_id)", PIXELS, *QUANTILE)
def guidance(spark, d):
    px = s.pixels(spark, d)
    return rounded(sm.guidance_step(px, px, 0.3), "v")


def _listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(f"SELECT flag, text, replace(t, '{{}}', text) AS prompt FROM (SELECT DISTINCT p_name AS text FROM part), (SELECT 'hr' AS flag, unnest([{_listed(m.TEMPLATES['hr'])}]) AS t "
       f"UNION ALL SELECT 'lr', unnest([{_listed(m.TEMPLATES['lr'])}]))")
def prompts(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("text")).distinct()
    sets = [m.compose_prompts(names, m.templates(flag)).withColumn("flag", F.lit(flag)) for flag in ("hr", "lr")]
    return sets[0].unionByName(sets[1])


@query("SELECT label, (j - 1)::INT AS i, round(avg(embedding[j]::DOUBLE), 6) + 0 AS mean FROM embeddings, range(1, 65) t(j) GROUP "
       "BY ALL")
def label_means(spark, d):
    return rounded(m.average_embeddings(s.vectors(spark, d), "label"), "mean")


@query("SELECT label, round(1.2 * (1 - avg(list_cosine_similarity(x, v))), 6) + 0 AS loss FROM queries JOIN vectors ON vec_id = "
       "query_id JOIN embeddings USING (vec_id) GROUP BY 1", VECTORS)
def text_loss(spark, d):
    v = s.vectors(spark, d)
    pairs = noisy(spark, d).join(v, F.col("query_id") == F.col("vec_id")).select("label", "x", F.col("v").alias("y"))
    return rounded(m.cosine_loss(pairs, "label"), "loss")


PLAN = """sides AS (SELECT *, least(height, width, sample_height, sample_width) AS short FROM asked),
depths AS (SELECT *, (SELECT min(k) FROM range(1, 41) t(k) WHERE 12 * pow(2, k - 1) >= short)::INT AS num_scales FROM sides),
each AS (SELECT *, unnest(range(num_scales))::INT AS scale FROM depths),
sized AS (SELECT image_id, num_scales, scale, ceil(height * pow(0.5, scale))::INT AS height, ceil(width * pow(0.5, scale))::INT AS width,
    ceil(sample_height * pow(0.5, scale))::INT AS sample_height, ceil(sample_width * pow(0.5, scale))::INT AS sample_width FROM each),
counted AS (SELECT *, greatest(height - 6, 0)::BIGINT * greatest(width - 6, 0)::BIGINT AS n, greatest(sample_height - 6, 0)::BIGINT * greatest(sample_width - 6, 0)::BIGINT AS a,
    greatest((height - 7) // 2 + 1, 0)::BIGINT * greatest((width - 7) // 2 + 1, 0)::BIGINT AS kept FROM sized),
plan AS (SELECT image_id, num_scales, scale, height, width, sample_height, sample_width, 2::INT AS dataset_stride, 20::INT AS steps, 0.5::DOUBLE AS rho, kept AS patches,
    round(least(height, width) / 7, 6) AS short_in_patches, CASE WHEN n > 250000 THEN 'ann' ELSE 'exact' END AS backend, CASE WHEN a > 8000000 THEN 2 ELSE 1 END::INT AS stride,
    greatest(1, round_even(a / 7500, 0))::INT AS chunks FROM counted)"""


def planned(spark, d: str) -> DataFrame:
    return rounded(c.sampling_plan(g.sample_sizes(catalog(spark, d)), None, 7, 20, 0.5, 2), "short_in_patches")


@query("SELECT * FROM plan", CATALOG, PLAN)
def plan(spark, d):
    """Each image with its own depth, from its own and the asked size."""
    return planned(spark, d)


@query("SELECT image_id, scale::INT AS scale, [20, 10, 10][scale + 1]::INT AS steps, CASE WHEN scale = 2 AND least(h, w) < 15 THEN "
       "least(ceil(height * 15 / least(height, width)), "
       "ceil(height * 0.5)) ELSE h END::INT AS height FROM (SELECT *, ceil(height * pow(0.5, scale)) AS h, ceil(width * pow(0.5, scale)) AS w FROM catalog, range(3) t(scale))", CATALOG)
def plan_by_scale(spark, d):
    return c.sampling_plan(catalog(spark, d), 3, 7, [20, 10, 10], min_short=15).select("image_id", "scale", "steps", "height")


@query("SELECT image_id, field AS column, min(value) AS value FROM (SELECT image_id, unnest(['backend', 'stride', 'chunks']) AS "
       "field, "
       "unnest([backend, stride::VARCHAR, chunks::VARCHAR]) AS value FROM plan) GROUP BY ALL HAVING count(DISTINCT value) = 1", CATALOG, PLAN)
def same_at_all_scales(spark, d):
    return c.uniform_columns(planned(spark, d), ["backend", "stride", "chunks"])


@query("SELECT image_id, sample_height, sample_width, ((sample_height // 16) * 16 // 8)::INT AS latent_height, ((sample_width // "
       "16) * 16 // 8)::INT AS latent_width FROM asked", CATALOG)
def sizes_asked_for(spark, d):
    """Sizes asked for in pixels and in cells of an encoder."""
    rows = catalog(spark, d)
    cells = g.sample_sizes(rows, latent=True).select("image_id", F.col("sample_height").alias("latent_height"), F.col("sample_width").alias("latent_width"))
    return g.sample_sizes(rows).join(cells, "image_id").select("image_id", "sample_height", "sample_width", "latent_height", "latent_width")


@query("SELECT image_id, (SELECT min(k) FROM range(1, 41) t(k) WHERE 12 * pow(2, k - 1) >= least(height, width))::INT AS num_scales "
       "FROM catalog", CATALOG)
def depth(spark, d):
    return catalog(spark, d).select("image_id", c.auto_num_scales(F.least("height", "width"), F.lit(12)).alias("num_scales"))


@query("SELECT run_id, label, round(sum(seconds), 6) AS total, count(*) AS count, round(avg(seconds), 6) AS mean, min(seq) AS first_seq, "
       "arg_min(nested, seq) AS nested FROM stage_log GROUP BY ALL", LOG)
def stages(spark, d):
    return rounded(c.collapse_stages(log(spark, d)), "total", "mean")


@query("SELECT run_id, round(counted, 6) + 0 AS counted, round(core, 6) + 0 AS core, round(wall - counted, 6) + 0 AS residual, "
       "round(100 * core / wall, 6) + 0 AS core_percent FROM (SELECT run_id, coalesce(sum(seconds) FILTER (NOT nested), 0) AS counted, "
       "coalesce(sum(seconds) FILTER (NOT nested AND kind <> 'load'), 0) AS core FROM stage_log GROUP BY 1) JOIN runs USING (run_id)", LOG)
def breakdown(spark, d):
    rows = log(spark, d)
    return rounded(c.run_breakdown(rows, rows.groupBy("run_id").agg((1.25 * F.sum("seconds")).alias("wall"))), "counted", "core", "residual", "core_percent")


@query("SELECT a.run_id, a.seq, round(a.seconds - coalesce(sum(b.seconds), 0), 6) + 0 AS net FROM stage_log a LEFT JOIN stage_log "
       "b ON b.kind = 'io' AND b.run_id = a.run_id AND b.start >= a.start AND b.start < a.start + a.seconds WHERE a.kind <> 'io' "
       "GROUP BY a.run_id, a.seq, a.seconds", LOG)
def without_io(spark, d):
    rows = log(spark, d)
    return rounded(c.net_of_io(rows.where("kind <> 'io'"), rows.where("kind = 'io'")), "net")


@query("SELECT seq, CASE WHEN nested THEN 'inside sampling' WHEN label IN (SELECT label FROM stage_log WHERE kind = 'compute') "
       "THEN 'sampling' ELSE 'setup' END AS phase FROM stage_log", LOG)
def phases(spark, d):
    return c.mark_phase(log(spark, d)).select("seq", "phase")


@query("SELECT image_id, round(sum(v), 4) + 0 AS total, count(*) AS n FROM pixels GROUP BY 1", PIXELS)
def resize_identity(spark, d):
    px = s.pixels(spark, d)
    return r.resize(px, g.sizes(px)).groupBy("image_id").agg((F.round(F.sum("v"), 4) + 0.0).alias("total"), F.count(F.lit(1)).alias("n"))


def _kernels(t: Chain) -> str:
    """Weights of all kernels, by their formulas."""
    z = "(3.141592653589793::DOUBLE * d)"
    lanczos = lambda a: f"CASE WHEN abs(d) < {a} THEN (sin({z}) * sin({z} / {a}) + {number(r.EPS)}) / ({z} * {z} / {a} + {number(r.EPS)}) ELSE 0 END"
    cubic = "CASE WHEN abs(d) <= 1 THEN 1.5 * abs(d * d * d) - 2.5 * d * d + 1 WHEN abs(d) <= 2 THEN -0.5 * abs(d * d * d) + 2.5 * d * d - 4 * abs(d) + 2 ELSE 0 END"
    forms = {None: cubic, "cubic": cubic, "lanczos2": lanczos(2), "lanczos3": lanczos(3), "box": "CASE WHEN d >= -0.5 AND d < 0.5 THEN 1 ELSE 0 END", "linear": "greatest(1 - abs(d), 0)"}
    pairs = t.add("SELECT DISTINCT h AS n_in, unnest([(2 * h) // 3, (5 * h) // 3]) AS n_out FROM dims")
    out = []
    for name, form in forms.items():
        width = r.WIDTHS[name]
        out.append(f"""SELECT '{name or "default"}' AS kernel, n_in, n_out, spot, CASE WHEN i < n_in THEN i ELSE 2 * n_in - 1 - i END AS i, {form} AS w FROM (
            SELECT n_in, n_out, o - 1 AS spot, k * (m - j - 1) AS d, ((j % (2 * n_in)) + 2 * n_in) % (2 * n_in) AS i FROM (
                SELECT *, unnest(range(floor(m - {width / 2} / k)::BIGINT - 1, floor(m - {width / 2} / k)::BIGINT + ceil({width} / k)::BIGINT + 1)) AS j FROM (
                    SELECT *, (o - (n_out - n_in * s) / 2) / s + 0.5 * (1 - 1 / s) AS m FROM (
                        SELECT *, n_out / n_in::DOUBLE AS s, least(1.0::DOUBLE, n_out / n_in::DOUBLE) AS k, unnest(range(1, n_out + 1)) AS o FROM {pairs}))))""")
    return t.add(" UNION ALL ".join(out))


def _weights_sql() -> str:
    t = Chain(PIXELS)
    raw = _kernels(t)
    return t.text(f"SELECT kernel, n_in::INT AS n_in, n_out::INT AS n_out, spot::INT AS out_idx, i::INT AS in_idx, round(w, 6) + 0 AS w FROM (SELECT kernel, n_in, n_out, spot, i, "
                  f"sum(w) / sum(sum(w)) OVER (PARTITION BY kernel, n_in, n_out, spot) AS w FROM {raw} GROUP BY kernel, n_in, n_out, spot, i) WHERE abs(w) > 1e-5")


@query(_weights_sql())
def resample_weights(spark, d):
    """What every kernel gives for the images' heights, shrunk to two thirds and grown to five."""
    pairs = g.sizes(s.pixels(spark, d)).select(F.col("height").alias("n_in"), F.explode(F.array(F.floor(2 * F.col("height") / 3).cast("int"), F.floor(5 * F.col("height") / 3).cast("int"))).alias("n_out")).distinct()
    pairs = pairs.select(F.struct("n_in", "n_out").alias("pair"), "n_in", "n_out")
    out = None
    for name in r.WIDTHS:
        one = r.contributions(pairs, name).select(F.lit(name or "default").alias("kernel"), "pair.*", "out_idx", "in_idx", "w")
        out = one if out is None else out.unionByName(one)
    return rounded(out.where("abs(w) > 1e-5"), "w")


@chained(lambda t: t.resize("pixels", t.add("SELECT image_id, 2 * h // 3 AS h, 3 * w // 2 AS w FROM dims")))
def resized(spark, d):
    """Lower and wider."""
    px = s.pixels(spark, d)
    to = g.sizes(px).select("image_id", F.floor(2 * F.col("height") / 3).cast("int").alias("height"), F.floor(3 * F.col("width") / 2).cast("int").alias("width"))
    return rounded(r.resize(px, to), "v")


def _pyramid_sql() -> str:
    t = Chain(PIXELS)
    one = t.resize("pixels", t.scaled("dims", 0.5))
    two = t.resize(one, t.scaled("dims", 0.25))
    return t.text(" UNION ALL ".join(f"SELECT image_id, c, y, x, round(v, 6) + 0 AS v, {i}::INT AS scale FROM {px}" for i, px in enumerate(("pixels", one, two))))


@query(_pyramid_sql())
def pyramid(spark, d):
    px = s.pixels(spark, d)
    return rounded(r.gaussian_pyramid(px, r.pyramid_shapes(g.sizes(px), 3), 3), "v")


@query(_pyramid_sql())
def traced(spark, d):
    """The scales of a pyramid, written one by one and read again."""
    px, path = s.pixels(spark, d), steps.scratch(spark, "trace")
    shapes = r.pyramid_shapes(g.sizes(px), 3)
    for scale in range(3):
        s.write_table(r.gaussian_pyramid(px, shapes, scale + 1).where(F.col("scale") == scale), path)
    return rounded(s.read_table(spark, path), "v")


@chained(lambda t: t.blend("pixels", t.resize("pixels", t.scaled("dims", 0.5))))
def two_scale_blend(spark, d):
    px = s.pixels(spark, d)
    small = r.resize(px, r.pyramid_shapes(g.sizes(px), 2).where("scale = 1"))
    return rounded(r.blend_two_scale(px, small), "v")


@query("SELECT image_id, round_even(height * (100.0::DOUBLE / least(height, width)), 0)::INT AS height, round_even(width * (100.0::DOUBLE "
       "/ least(height, width)), 0)::INT AS width FROM catalog", CATALOG)
def short_sides(spark, d):
    return r.short_side_sizes(catalog(spark, d), 100)


@query("SELECT image_id, greatest(1, round_even(height * f, 0))::INT AS height, greatest(1, round_even(width * f, 0))::INT AS width "
       "FROM (SELECT *, CASE WHEN greatest(height, width) > 1024 THEN 1024.0::DOUBLE / greatest(height, width) ELSE 1.0::DOUBLE "
       "END AS f FROM catalog)", CATALOG)
def previews(spark, d):
    return r.preview_sizes(catalog(spark, d), 1024)


@query("SELECT image_id, scale::INT AS scale, CASE WHEN scale = 2 AND least(h, w) < 20 THEN least(ceil(height * 20 / least(height, "
       "width)), ceil(height * 0.5)) ELSE h END::INT AS height, CASE WHEN scale = 2 AND least(h, w) < 20 THEN least(ceil(width "
       "* 20 / least(height, width)), ceil(width * 0.5)) ELSE w END::INT AS width FROM (SELECT *, ceil(height * pow(0.5, scale)) "
       "AS h, ceil(width * pow(0.5, scale)) AS w FROM catalog, range(3) t(scale))", CATALOG)
def raised_scales(spark, d):
    return r.pyramid_shapes(catalog(spark, d), 3, least=20)


def _sized(factor: str) -> Callable[[Chain], str]:
    side = lambda c: f"greatest(1, round_even({c} * {factor}, 0))::INT AS {c}"
    return lambda t: t.resize("pixels", t.add(f"SELECT image_id, {side('h')}, {side('w')} FROM dims"))


@chained(_sized("least(1.0::DOUBLE, 48.0::DOUBLE / greatest(h, w))"))
def shrunk(spark, d):
    return rounded(r.preview(s.pixels(spark, d), 48), "v")


@chained(_sized("(16.0::DOUBLE / least(h, w))"))
def to_short_side(spark, d):
    return rounded(r.resize_to_short_side(s.pixels(spark, d), 16), "v")


MANIFEST = """manifest AS (SELECT source AS set_name, doc_id::VARCHAR AS asset, source || '/' || doc_id AS target, doc_id % 10 = 0 AS archive FROM documents),
listing AS (SELECT d.source || '/' || doc_id AS target, d.n_chars AS expected, d.n_chars - (doc_id % 7 = 0)::INT AS written FROM documents d JOIN labels USING (doc_id)),
pending AS (SELECT * FROM manifest m WHERE CASE WHEN archive THEN NOT EXISTS (SELECT 1 FROM listing l WHERE split_part(l.target, '/', 1) = m.set_name) ELSE NOT EXISTS (SELECT 1 FROM listing l WHERE l.target = m.target) END)"""


def inventory(spark, d: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    target = F.concat_ws("/", "source", "doc_id").alias("target")
    return (docs.select(F.col("source").alias("set_name"), F.col("doc_id").cast("string").alias("asset"), target, (F.col("doc_id") % 10 == 0).alias("archive")),
            docs.join(labels, "doc_id").select(target, F.col("n_chars").alias("expected"), (F.col("n_chars") - (F.col("doc_id") % 7 == 0).cast("int")).alias("written")))


@query("SELECT set_name, count(*) AS assets, sum(gone)::BIGINT AS missing, CASE WHEN sum(gone) = 0 THEN 'in place' ELSE sum(gone)::BIGINT "
       "|| ' of ' || count(*) || ' missing' END AS state FROM (SELECT set_name, (asset IN (SELECT asset FROM pending))::INT AS "
       "gone FROM manifest) GROUP BY 1", MANIFEST)
def asset_status(spark, d):
    manifest, listing = inventory(spark, d)
    return s.set_status(manifest, s.pending_assets(manifest, listing))


@query("SELECT target, expected, written FROM listing WHERE written <> expected", MANIFEST)
def short_transfers(spark, d):
    return s.short_transfers(inventory(spark, d)[1]).select("target", "expected", "written")


@query("SELECT label AS image_id, i::INT AS sample_id, 100 + label + i AS seed, CASE WHEN label % 2 = 0 THEN 'out/' || label || "
       "'.png' ELSE 'out/' || label || '_00' || i || '.png' END AS path FROM (SELECT DISTINCT label FROM embeddings), range(3) "
       "t(i) WHERE i < CASE WHEN label % 2 = 0 THEN 1 ELSE 3 END")
def samples(spark, d):
    images = s.vectors(spark, d).select("label").distinct().select(F.col("label").alias("image_id"), F.when(F.col("label") % 2 == 0, 1).otherwise(3).alias("n"), (100 + F.col("label")).cast("long").alias("seed"),
                                                                   F.format_string("out/%d.png", "label").alias("path"))
    return s.sample_plan(images)


#: Patch and steps of the registered samplers: with the defaults (7 and 10) their SQL, all pairs of patches of all steps, runs for hours.
P, STEPS, RHO = 3, 2, 0.2


def process(spark, **more) -> sm.Process:
    return sm.Process(spark, p=P, num_steps=STEPS, rho=RHO, **more)


@chained(lambda t: t.denoise("pixels", t.windows("pixels", P), 0.7, 0.5, P, RHO, stride=2))
def denoised(spark, d):
    px, p = s.pixels(spark, d), process(spark)
    return rounded(sm.denoise(px, p.prior(px), sm._same(px), P, 0.7, 0.5, 2, RHO), "v")


@chained(lambda t: t.roll(t.denoise(t.roll("pixels", 1, 1), t.windows("pixels", P), 0.7, 0.5, P, RHO), 1, 1, True))
def denoised_shifted(spark, d):
    px, p = s.pixels(spark, d), process(spark)
    return rounded(sm.denoise_shifted(px, "diag", p.prior(px), sm._same(px), P, 0.7, 0.5, rho=RHO), "v")


@chained(lambda t: t.denoise("pixels", t.windows("pixels", P), 0.7, 0.5, P, RHO, nearest=5))
def denoised_by_lists(spark, d):
    """By the five nearest patches of all lists."""
    px, p = s.pixels(spark, d), process(spark, backend="ann")
    return rounded(sm.denoise(px, p.prior(px), sm._same(px), P, 0.7, 0.5, 1, RHO, 5, 1 << 20), "v")


@chained(lambda t: t.sample("pixels", 2, STEPS, P, RHO))
def sampled(spark, d):
    return rounded(sm.sample_uncond(process(spark), s.pixels(spark, d), 2), "v")


@chained(lambda t: t.sample("pixels", 2, STEPS, P, RHO, seed="seed", who="prior_id", of="runs"), PIXELS,
         "runs AS (SELECT image_id || '_00' || i AS image_id, image_id AS prior_id, 100 + image_id + i AS seed FROM dims, range(2) t(i) WHERE i < 1 + image_id % 2)")
def sampled_often(spark, d):
    """Two samples of images with odd numbers, one of the others, each by its own seed."""
    px = s.pixels(spark, d)
    plan = px.select("image_id").distinct().select("image_id", (1 + F.col("image_id") % 2).alias("n"), (100 + F.col("image_id")).alias("seed"), F.lit(None).cast("string").alias("path"))
    return rounded(sm.sample_uncond(process(spark), px, 2, s.sample_plan(plan)), "v")


def _wide(t: Chain) -> str:
    wide = t.add("SELECT image_id, h, ceil(w * 1.25::DOUBLE)::INT AS w FROM dims")
    shapes = lambda scale: t.scaled(wide, 0.5**scale)
    return t.sample("pixels", 2, STEPS, P, RHO, shapes=shapes, coarsest=t.resize("pixels", shapes(1)))


@chained(_wide)
def retargeted(spark, d):
    px = s.pixels(spark, d)
    wide = g.sizes(px).withColumn("width", F.ceil(F.col("width") * 1.25).cast("int"))
    return rounded(sm.sample_retarget(process(spark), px, 2, wide), "v")


@chained(lambda t: t.sample("pixels", 2, STEPS, P, RHO, after=t.mirrored))
def sampled_symmetric(spark, d):
    return rounded(sm.sample_symmetric(process(spark), s.pixels(spark, d), 2), "v")


@chained(lambda t: t.sample("pixels", 2, STEPS, P, RHO, tile=True))
def sampled_tileable(spark, d):
    return rounded(sm.sample_tileable(process(spark), s.pixels(spark, d), 2, "horizontal"), "v")


def _back(t: Chain) -> str:
    prior = t.windows("pixels", P)
    noisy = t.invert("pixels", prior, STEPS, P, RHO)
    return t.fill(noisy, lambda now, a, b: t.denoise(now, prior, a, b, P, RHO), levels(STEPS), STEPS, None)


@chained(_back)
def inverted_and_back(spark, d):
    px, p = s.pixels(spark, d), process(spark)
    prior, priors = p.prior(px), sm._same(px)
    return rounded(sm.reconstruct(p, sm.invert(p, px, prior, priors), prior, priors), "v")


def _analogy(t: Chain) -> str:
    """The layout of the next image, the patches of the own one; two scales."""
    layout = t.add("SELECT ((image_id + n - 1) % n)::INT AS image_id, c, y, x, v FROM pixels, (SELECT max(image_id) + 1 AS n FROM pixels)")
    size, half = t.dims(layout), 0.5
    low = t.resize(layout, t.scaled(size, half))
    noisy = t.invert(low, t.windows(low, P), STEPS, P, RHO, 1)
    style = t.windows(t.resize("pixels", t.scaled("dims", half)), P)
    coarsest = t.fill(noisy, lambda now, a, b: t.denoise(now, style, a, b, P, RHO), levels(STEPS), STEPS, None)
    return t.sample("pixels", 2, STEPS, P, RHO, shapes=lambda scale: t.scaled(size, half**scale), coarsest=coarsest)


@chained(_analogy)
def analogies(spark, d):
    px = s.pixels(spark, d)
    count = px.agg(F.max("image_id") + 1).first()[0]
    pairs = px.select("image_id").distinct().select("image_id", F.col("image_id").alias("style_id"), F.pmod(F.col("image_id") + 1, F.lit(count)).alias("structure_id"))
    return rounded(sm.sample_analogy(process(spark), px, pairs, 2), "v")


def _guided(t: Chain) -> str:
    """Against the own values, from the second of three steps, where estimates aren't flat yet."""
    prior, steps, previous = t.windows("pixels", P), levels(3), None
    now = t.invert("pixels", prior, 3, P, RHO, stop=2)
    for i in range(2, 0, -1):
        hat = t.denoise(now, prior, *steps[i], P, RHO)
        at = t.add(f"SELECT image_id, c, y, x, 0.8::DOUBLE * b.v + 0.2::DOUBLE * a.v AS v FROM {hat} a JOIN {previous} b USING (image_id, c, y, x)") if previous else hat
        energy = t.add(f"SELECT image_id, y, x, sqrt(sum(v * v)) AS energy FROM {at} GROUP BY ALL")
        q = t.add(f"SELECT image_id, energy AS q FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY energy) - 1 AS r, count(*) OVER (PARTITION BY image_id) AS n "
                  f"FROM {energy}) WHERE r = round_even((n - 1) * 0.8::DOUBLE, 0)")
        thin = t.add(f"SELECT image_id, c, y, x, v, CASE WHEN energy > q THEN (energy - q) * -v / energy END AS g FROM {at} JOIN {energy} USING (image_id, y, x) JOIN {q} USING (image_id)")
        ratio = t.add(f"SELECT image_id, sqrt(sum(v * v) / nullif(sum(g * g), 0)) AS ratio FROM {thin} WHERE g IS NOT NULL GROUP BY 1")
        previous = t.add(f"SELECT image_id, c, y, x, greatest(least(v + coalesce({number(0.1 * steps[i][1] / steps[2][1])} * ratio * g, 0), 1), -1) AS v "
                         f"FROM {thin} LEFT JOIN {ratio} USING (image_id)")
        now = t.moved(now, previous, previous, steps[i], steps[i - 1])
    return now


@chained(_guided)
def guided(spark, d):
    px = s.pixels(spark, d)
    slope = lambda now: now.withColumn("v", -F.col("v"))
    return rounded(sm.guided_reconstruct(sm.Process(spark, p=P, num_steps=3, rho=RHO), px, slope, 0.1, 0.5), "v")
