"""Iterated samplers: images made from noise, or from other images, by denoising with the patches of a prior image.

Each step is one job over all images and samples at once; its result is a written table, so that the plan does not grow
with the steps and a lost executor costs one step. Pixels are (image_id, c, y, x, v). A table (image_id, prior_id, seed)
tells whose patches each image is made from, and by which seed; several samples of one image are rows of that table, and
runs_of() makes it from a plan of samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchspark.functions import geometry as g
from patchspark.functions import schedule as n
from patchspark.operators import kernel as k
from patchspark.operators import layout as lo
from patchspark.operators.measures import thresholded_grad
from patchspark.operators.patches import check_patchable, extract_patches, fold, packed_patches
from patchspark.operators.resample import blend_two_scale, enlarged, gaussian_pyramid, pyramid_shapes, resize
from patchspark.plans.catalogue import expand_per_scale
from patchspark.sources.steps import kept
from patchspark.sources.tables import read_scale, whole_scales, write_scale

KEYS = ["image_id", "c", "y", "x"]
PLACE = ("image_id", "py", "px")
PRIOR = ("prior_id",)
#: Rows of a list of patches that are only met all together.
EXACT_ROWS = 64


def grid(shapes: DataFrame, channels: int, *more: str) -> DataFrame:
    """All places (image_id, c, y, x, more columns) of (image_id, height, width, more columns)."""
    upto = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    places = shapes.withColumn("c", upto(F.lit(channels))).withColumn("y", upto(F.col("height"))).withColumn("x", upto(F.col("width")))
    return places.select(*KEYS, *more)


def init_noise(shapes: DataFrame, channels: int, seed: int, scale: int, sigma: float, t: int = 0) -> DataFrame:
    """sigma times a standard normal by place, from the seed, scale, step, image and place alone.

    Where shapes have columns seed and prior_id (or noise_id), these stand for the seed and the image: a sample is what a
    run with its own seed alone would give.
    """
    more = [c for c in ("seed", "prior_id", "noise_id") if c in shapes.columns]
    who = F.col(next((c for c in ("noise_id", "prior_id") if c in more), "image_id"))
    z = n.keyed_normal(F.col("seed") if "seed" in more else F.lit(seed), F.lit(scale), F.lit(t), who, *KEYS[1:])
    return grid(shapes, channels, *more).select(*KEYS, (sigma * z).alias("v"))


def runs_of(plan: DataFrame) -> DataFrame:
    """(image_id, prior_id, seed) of a plan (image_id, sample_id, seed): each sample is an image of its own."""
    name = F.format_string("%s_%03d", F.col("image_id").cast("string"), F.col("sample_id"))
    return plan.select(name.alias("image_id"), F.col("image_id").alias("prior_id"), "seed")


class Prior:
    """The patches of the prior images of a scale, laid out once: every step's queries go to them, and they stay where they are.

    searched: the images (prior_id) that are searched by k nearest neighbours, if any. probes: lists to look into by noise
    level, as an audit found.
    """

    def __init__(self, layout: lo.Layout, searched: DataFrame | None = None):
        self.layout, self.searched = layout, searched
        self.probes: dict[tuple[float, float], int] = {}


class Process:
    """A schedule with the patch size, window and backend of the denoiser.

    num_steps, rho, stride, dataset_stride and backend are one value, or a list with one for each scale. backend: exact,
    ann (k nearest neighbours by inverted lists), or auto (ann for images with more than `switch` patches at a scale).
    schedule: flow or ve. recall: the share of neighbours that a search must find, audited once a scale and noise level, from nprobe
    lists up; None takes nprobe as it is.
    """

    def __init__(self, spark, p: int = 7, num_steps=10, rho=0.2, eta: float = 0.0, sigma_min: float | None = None, seed: int = 0, stride=1,
                 dataset_stride=1, backend="exact", switch: int = 250_000, k: int = 5, nprobe: int = 2, nlist: int | None = None,
                 schedule: str = "flow", least: int | None = None, recall: float | None = 0.9):
        self.spark, self.p, self.eta, self.seed, self.switch, self.least = spark, p, eta, seed, switch, least
        self.k, self.nprobe, self.nlist, self.schedule, self.sigma_min, self.recall = k, nprobe, nlist, schedule, sigma_min, recall
        self.by_scale = {"num_steps": num_steps, "rho": rho, "stride": stride, "dataset_stride": dataset_stride, "backend": backend}
        self._levels: dict[int, dict[int, tuple[float, float]]] = {}

    def at(self, name: str, scale: int):
        """A setting at a scale."""
        value = self.by_scale[name]
        return value[scale] if isinstance(value, list | tuple) else value

    def check(self, num_scales: int) -> None:
        for value in self.by_scale.values():
            expand_per_scale(value, num_scales)

    def table(self, num_steps: int) -> DataFrame:
        """The schedule of so many steps."""
        make = {"flow": n.flow_linear, "ve": n.ve_edm}[self.schedule]
        return make(self.spark, num_steps) if self.sigma_min is None else make(self.spark, num_steps, self.sigma_min)

    def levels(self, scale: int) -> dict[int, tuple[float, float]]:
        """(alpha, sigma) by step; one more than num_steps rows come to the driver."""
        steps = self.at("num_steps", scale)
        if steps not in self._levels:
            self._levels[steps] = {r["t"]: (r["alpha"], r["sigma"]) for r in self.table(steps).collect()}
        return self._levels[steps]

    def index(self, level: float | None, scale: int = 0) -> int:
        """The step of a noise level; the last for None."""
        asked = self.spark.createDataFrame([(level,)], "level double")
        return n.index_for_noise_level(asked, self.table(self.at("num_steps", scale))).first()["t"]

    def prior(self, px: DataFrame, scale: int = 0, asked: DataFrame | None = None) -> Prior:
        """The patches of px, laid out with their lists once a scale. asked: (prior_id, n), the queries that each image's patches will meet a step."""
        own = lambda i, py, px: {"vec_id": py.astype("int64") * (1 << 31) + px}
        patches = packed_patches(px, self.p, self.at("dataset_stride", scale), keys=own).withColumnRenamed("image_id", "prior_id")
        backend = self.at("backend", scale)
        if backend not in ("exact", "ann", "auto"):
            raise ValueError(f"no backend: {backend}")
        searched = None
        if backend != "exact":
            patches = kept(patches)
            searched = kept(patches.groupBy("prior_id").agg(F.sum("n").alias("count")).where(F.col("count") > (self.switch if backend == "auto" else 0)).select("prior_id"))
            if not searched.limit(1).count():
                searched = None
        if searched is None:
            return Prior(lo.lay_out_blocks(patches, PRIOR, rounds=0, queries=asked, list_rows=EXACT_ROWS))
        return Prior(lo.lay_out_blocks(patches, PRIOR, self.nlist, queries=asked), searched)

    def estimate(self, px: DataFrame, prior: Prior, priors: DataFrame, t: int, scale: int = 0) -> DataFrame:
        return denoise(px, prior, priors, self.p, *self.levels(scale)[t], self.at("stride", scale), self.at("rho", scale), self.k, self.nprobe, self.recall)

    def moved(self, px: DataFrame, x_hat: DataFrame, target: DataFrame, priors: DataFrame, t: int, to: int, scale: int, eta: float) -> DataFrame:
        """One step from t: the noise is told from x_hat, the way on starts at target (x_hat, or a blend with it)."""
        (alpha, sigma), (a2, s2) = self.levels(scale)[t], self.levels(scale)[to]
        # flat estimates are small files but as many rows as any: they must not be broadcast for their size
        rows, fresh = px.join(x_hat.withColumnRenamed("v", "hat").hint("merge"), KEYS).join(target.withColumnRenamed("v", "to").hint("merge"), KEYS), None
        if eta:
            rows = g.of_image(rows, self.seeded(priors))
            fresh = n.keyed_normal(F.col("seed"), F.lit(scale), F.lit(t - 1), F.col("noise_id"), *KEYS[1:])
        eps = n.epsilon(F.col("v"), F.col("hat"), F.lit(alpha), F.lit(sigma))
        return kept(rows.select(*KEYS, n.step(F.col("to"), eps, F.lit(a2), F.lit(s2), eta, fresh).alias("v")))

    def seeded(self, priors: DataFrame) -> DataFrame:
        """priors with the seed, and what noise is drawn for: the prior image if nothing else is named."""
        priors = priors if "seed" in priors.columns else priors.withColumn("seed", F.lit(self.seed))
        return priors if "noise_id" in priors.columns else priors.withColumn("noise_id", F.col("prior_id"))


def denoise(px: DataFrame, prior: Prior, priors: DataFrame, p: int, alpha: float, sigma: float, stride: int = 1, rho: float = float("inf"),
            neighbours: int = 5, nprobe: int = 2, recall: float | None = None) -> DataFrame:
    """Pixels denoised: windows out, kernel regression over the prior's patches (or their nearest), windows averaged back.

    priors: (image_id, prior_id), whose patches serve which image. At alpha 0 all weights are equal: the mean patch. recall: if
    given, the lists of a search grow from nprobe on until an audit finds this share of the neighbours, once a noise level.
    """
    if sigma <= 0:
        raise ValueError("sigma must be above 0")
    of = kept(priors.select("image_id", "prior_id"))
    types = of.select("image_id", F.lit(0).alias("py"), F.lit(0).alias("px"), "prior_id")
    if alpha == 0:
        means = of.join(lo.group_means(prior.layout), "prior_id").hint("merge")
        out = extract_patches(px, p, stride).select(*PLACE).join(means, "image_id").select(*PLACE, F.col("mean").alias("x_hat"))
    else:
        blocks = lo.beside(packed_patches(px, p, stride), of, ["image_id"]).select("prior_id", "id", "data")
        exact = blocks if prior.searched is None else blocks.join(prior.searched, "prior_id", "left_anti")
        out = lo.regress_blocks(exact, types, prior.layout, alpha, sigma, PLACE)
        if prior.searched is not None:
            if recall is not None:
                if (alpha, sigma) not in prior.probes:
                    some = extract_patches(px, p, stride).withColumnRenamed("v", "x").join(of.join(prior.searched, "prior_id", "left_semi"), "image_id")
                    prior.probes[alpha, sigma] = lo.audited_probes(k.scale_queries(some, alpha), prior.layout, neighbours, recall, nprobe, keys=PLACE)
                nprobe = prior.probes[alpha, sigma]
            near = kept(lo.knn_regress_blocks(blocks.join(prior.searched, "prior_id", "left_semi"), types, prior.layout, neighbours, nprobe, alpha, sigma, PLACE))
            if few := near.where("x_hat is null").count():
                raise ValueError(f"{few} queries have fewer than {neighbours} neighbours")
            out = out.unionByName(near)
    return fold(out.withColumnRenamed("x_hat", "v"), px, rho, p, stride)


def denoise_shifted(px: DataFrame, shift: str, prior: Prior, priors: DataFrame, p: int, alpha: float, sigma: float, **more) -> DataFrame:
    """denoise() of the image rolled by half its sides, rolled back."""
    return g.roll(denoise(g.roll(px, shift), prior, priors, p, alpha, sigma, **more), shift, back=True)


def asked(shapes: DataFrame, priors: DataFrame, scale: int) -> DataFrame:
    """(prior_id, n): the places of all images of a scale that ask a prior image's patches."""
    of = shapes.where(F.col("scale") == scale).select("image_id", "height", "width").join(priors.select("image_id", "prior_id"), "image_id")
    return of.groupBy("prior_id").agg(F.sum(F.col("height").cast("long") * F.col("width")).alias("n"))


def _same(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.col("image_id").alias("prior_id")).distinct()


def _fill(process: Process, px: DataFrame, prior: Prior, priors: DataFrame, scale: int, coarser: DataFrame | None,
          estimate: Callable[[DataFrame, int], DataFrame] | None = None, start: int | None = None, eta: float | None = None) -> DataFrame:
    """A scale from step `start` down to 0; all steps but the last are blended with the scale below."""
    estimate = estimate or (lambda now, t: process.estimate(now, prior, priors, t, scale))
    steps = start or process.at("num_steps", scale)
    up = kept(enlarged(coarser, px)) if coarser is not None and steps > 1 else None
    for t in range(steps, 0, -1):
        x_hat = target = kept(estimate(px, t))
        if up is not None and t > 1:
            target = kept(blend_two_scale(x_hat, coarser, least=process.least, up=up))
        px = process.moved(px, x_hat, target, priors, t, t - 1, scale, process.eta if eta is None else eta)
    return px


def sample(process: Process, images: DataFrame, num_scales: int, shapes: DataFrame | None = None, coarsest: DataFrame | None = None,
           after: Callable[[DataFrame], DataFrame] | None = None, tile: str | None = None, num_shifts: int = 4,
           priors: DataFrame | None = None, trace: str | None = None, resume: bool = False) -> DataFrame:
    """Pixels made from noise, coarsest scale first, with the patches of `images` at each scale.

    shapes: (image_id, scale, height, width) of the output, the prior images' own if None. coarsest: pixels that stand at
    the coarsest scale and are not denoised. after: what is done to every estimate. tile: the direction of a seamless
    result, whose estimates are blends of shifted views. priors: (image_id, prior_id, seed) where they differ from the
    images and the process's seed. trace: a folder to which the result of each scale is written; with resume, a run begins
    below the last scale that stands there whole, so it must be one of the same process, images and shapes.
    """
    process.check(num_scales)
    own = pyramid_shapes(g.sizes(images), num_scales, least=process.least)
    priors = kept(process.seeded(_same(images) if priors is None else priors))
    if shapes is None:
        shapes = own.withColumnRenamed("image_id", "prior_id").join(priors, "prior_id").select("image_id", "scale", "height", "width")
    check_patchable(shapes, process.p, shapes.where(F.col("scale") == num_scales - 1).select("image_id", "scale") if coarsest is not None else None)
    scales, out = kept(gaussian_pyramid(images, own, num_scales)), coarsest
    channels = images.agg(F.max("c")).first()[0] + 1
    top = num_scales - 1 if coarsest is None else num_scales - 2
    done = whole_scales(process.spark, trace) if resume and trace is not None else set()
    for scale in range(top, -1, -1):
        if scale in done and all(s in done for s in range(scale, top + 1)):
            out = read_scale(process.spark, trace, scale)
            continue
        prior = process.prior(scales.where(F.col("scale") == scale).drop("scale"), scale, asked(shapes, priors, scale))
        steps = process.at("num_steps", scale)
        noise = kept(init_noise(shapes.where(F.col("scale") == scale).join(priors, "image_id"), channels, process.seed, scale, process.levels(scale)[steps][1], steps))

        def estimate(now: DataFrame, t: int, prior: Prior = prior, scale: int = scale) -> DataFrame:
            made = _shifted(process, now, prior, priors, t, scale, tile, num_shifts) if tile else process.estimate(now, prior, priors, t, scale)
            return after(made) if after else made

        out = _fill(process, noise, prior, priors, scale, out, estimate)
        if trace is not None:
            write_scale(out, trace, scale)
    return out


def _shifted(process: Process, px: DataFrame, prior: Prior, priors: DataFrame, t: int, scale: int, direction: str, num_shifts: int) -> DataFrame:
    """The blend of the estimates of views rolled by half, each rolled back."""
    names = {"horizontal": ["no", "horiz"], "vertical": ["no", "vert"], "both": ["no", "horiz", "vert", "diag"]}.get(direction)
    if names is None:
        raise ValueError(f"no direction: {direction}")
    views = None
    for shift in names[:3] if direction == "both" and num_shifts != 4 else names:
        view = g.roll(process.estimate(g.roll(px, shift), prior, priors, t, scale), shift, back=True)
        view = g.with_size(view).select(*KEYS, "v", g.shift_weight(direction, shift, num_shifts).alias("w"))
        views = view if views is None else views.unionByName(view)
    return g.blend_shifts(views)


def sample_uncond(process: Process, images: DataFrame, num_scales: int, samples: DataFrame | None = None, trace: str | None = None, resume: bool = False) -> DataFrame:
    """New images of the same sizes; of each image as many as `samples` (image_id, sample_id, seed) lists, or one."""
    return sample(process, images, num_scales, priors=None if samples is None else runs_of(samples), trace=trace, resume=resume)


def sample_retarget(process: Process, images: DataFrame, num_scales: int, output: DataFrame) -> DataFrame:
    """Images of the sizes in `output` (image_id, height, width), laid out as the resized input at the coarsest scale."""
    shapes = pyramid_shapes(output, num_scales, least=process.least)
    return sample(process, images, num_scales, shapes, kept(resize(images, shapes.where(F.col("scale") == num_scales - 1))))


def sample_symmetric(process: Process, images: DataFrame, num_scales: int, axis: str = "horizontal", source: str | None = None) -> DataFrame:
    """Images that mirror themselves: every estimate is mirrored before its noise is told."""
    return sample(process, images, num_scales, after=lambda px: g.symmetrize(px, axis, source))


def sample_tileable(process: Process, images: DataFrame, num_scales: int, direction: str = "both", num_shifts: int = 4) -> DataFrame:
    """Images without seams when repeated in the direction."""
    return sample(process, images, num_scales, tile=direction, num_shifts=num_shifts)


def invert(process: Process, px: DataFrame, prior: Prior, priors: DataFrame, level: float | None = None, scale: int = 0) -> DataFrame:
    """Pixels taken up to the step of the noise level, along the noise that the denoiser tells."""
    alpha, sigma = process.levels(scale)[1]
    eps = n.keyed_normal(F.col("seed"), F.lit(scale), F.lit(1), F.col("noise_id"), *KEYS[1:])
    now = g.of_image(px, process.seeded(priors))
    now = kept(now.select(*KEYS, n.add_noise(F.col("v"), eps, F.lit(alpha), F.lit(sigma)).alias("v")))
    for t in range(1, process.index(level, scale)):
        x_hat = kept(process.estimate(now, prior, priors, t, scale))
        now = process.moved(now, x_hat, x_hat, priors, t, t + 1, scale, 0.0)
    return now


def reconstruct(process: Process, noisy: DataFrame, prior: Prior, priors: DataFrame, level: float | None = None, scale: int = 0) -> DataFrame:
    """From the step of the noise level down to 0, without fresh noise; the prior may be another image's."""
    return _fill(process, noisy, prior, priors, scale, None, start=process.index(level, scale), eta=0.0)


def sample_analogy(process: Process, images: DataFrame, pairs: DataFrame, num_scales: int, level: float | None = None) -> DataFrame:
    """Images with the layout of structure_id and the patches of style_id, one for each row of pairs.

    image_id of the result is the pair's: pairs (image_id, style_id, structure_id). A style is cut into patches and laid out once,
    however many pairs ask it.
    """
    chosen = lambda key: images.join(pairs.select(F.col(key).alias("image_id")).distinct(), "image_id", "left_semi")
    each = lambda px: px.withColumnRenamed("image_id", "structure_id").join(pairs.select("image_id", "structure_id"), "structure_id").select(*KEYS, "v")
    style, structure, low = kept(chosen("style_id")), kept(chosen("structure_id")), num_scales - 1
    at = lambda px: kept(gaussian_pyramid(px, pyramid_shapes(g.sizes(px), num_scales, least=process.least), num_scales).where(F.col("scale") == low).drop("scale"))
    # the pair's own number is what noise is drawn for, whoever's patches are asked
    by = lambda key: pairs.select("image_id", F.col(key).alias("prior_id"), F.col("image_id").alias("noise_id"))
    shapes = pyramid_shapes(g.sizes(structure), num_scales, least=process.least).withColumnRenamed("image_id", "structure_id")
    shapes = kept(shapes.join(pairs.select("image_id", "structure_id"), "structure_id").drop("structure_id"))
    base, of_structure, of_style = at(structure), by("structure_id"), by("style_id")
    noisy = invert(process, kept(each(base)), process.prior(base, low, asked(shapes, of_structure, low)), of_structure, level, low)
    coarsest = reconstruct(process, noisy, process.prior(at(style), low, asked(shapes, of_style, low)), of_style, level, low)
    return sample(process, style, num_scales, shapes, coarsest, priors=of_style) if num_scales > 1 else coarsest


def drawn_to(x_hat: DataFrame, previous: DataFrame | None, momentum: float = 0.2) -> DataFrame:
    """(1 - momentum) * previous + momentum * x_hat; x_hat where there is no previous estimate."""
    if previous is None:
        return x_hat
    return x_hat.join(previous.withColumnRenamed("v", "was").hint("merge"), KEYS).select(*KEYS, ((1 - momentum) * F.col("was") + momentum * F.col("v")).alias("v"))


def guidance_step(x_hat: DataFrame, grad: DataFrame, strength: float, quantile: float = 0.8) -> DataFrame:
    """x_hat moved along the thresholded gradient by strength times its own norm where that is not 0, within -1 and 1."""
    rows = x_hat.join(thresholded_grad(grad, quantile).where("mask").select(*KEYS, F.col("v").alias("g")).hint("merge"), KEYS, "left")
    norms = rows.where("g is not null").groupBy("image_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / F.nullif(F.sum(F.col("g") * F.col("g")), F.lit(0.0))).alias("ratio"))
    moved = F.col("v") + F.coalesce(strength * F.col("ratio") * F.col("g"), F.lit(0.0))
    return g.of_image(rows, norms, "left").select(*KEYS, F.greatest(F.least(moved, F.lit(1.0)), F.lit(-1.0)).alias("v"))


def guided_reconstruct(process: Process, content: DataFrame, gradient: Callable[[DataFrame], DataFrame], strength: float, level: float | None = None,
                       quantile: float = 0.8, momentum: float = 0.2, iters: int = 1) -> DataFrame:
    """Content inverted to the noise level and taken down again, each estimate moved along gradient(pixels).

    The gradient is taken where the estimate has been drawn to the one before; gradient gives pixels (image_id, c, y, x, v)
    for pixels. The strength falls with the step's noise.
    """
    priors, prior, start = _same(content), process.prior(content), process.index(level)
    now, previous, levels = invert(process, content, prior, priors, level), None, process.levels(0)
    for t in range(start, 0, -1):
        x_hat = kept(process.estimate(now, prior, priors, t))
        for _ in range(iters):
            at = kept(drawn_to(x_hat, previous, momentum))
            x_hat = previous = kept(guidance_step(at, gradient(at), strength * levels[t][1] / levels[start][1], quantile))
        now = process.moved(now, x_hat, x_hat, priors, t, t - 1, 0, 0.0)
    return now
