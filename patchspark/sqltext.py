"""SQL of whole runs of the image operators, as chains of common tables, for engines that the queries are held against.

Tables of pixels are (image_id, c, y, x, v), of patches (image_id, py, px, v list). Each method adds a table and returns
its name.
"""

from __future__ import annotations

from collections.abc import Callable


def levels(num_steps: int, sigma_min: float = 1e-4) -> list[tuple[float, float]]:
    """(alpha, sigma) of the linear schedule, step 0 first."""
    alpha = [(1 - sigma_min) * (1 - t / max(1, num_steps - 1)) for t in range(num_steps)]
    return [(1.0, 0.0), *((a, 1 - a) for a in alpha)]


def number(x: float) -> str:
    return f"({x!r})::DOUBLE"


class Chain:
    def __init__(self, *ctes: str):
        self.ctes, self.n = list(ctes), 0

    def add(self, sql: str) -> str:
        self.n += 1
        self.ctes.append(f"t{self.n} AS MATERIALIZED ({sql})")
        return f"t{self.n}"

    def text(self, select: str) -> str:
        return "WITH " + ",\n".join(self.ctes) + "\n" + select

    def pixels(self, table: str, places: int = 6) -> str:
        return self.text(f"SELECT image_id, c, y, x, round(v, {places}) + 0 AS v FROM {table}")

    def dims(self, px: str) -> str:
        return self.add(f"SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM {px} GROUP BY 1")

    def scaled(self, dims: str, factor: float) -> str:
        return self.add(f"SELECT image_id, ceil(h * {number(factor)})::INT AS h, ceil(w * {number(factor)})::INT AS w FROM {dims}")

    def resize(self, px: str, to: str) -> str:
        """Cubic, antialiased, lines first."""
        of = self.dims(px)
        sides = self.add(f"SELECT DISTINCT unnest([a.h, a.w]) AS n_in, unnest([b.h, b.w]) AS n_out FROM {of} a JOIN {to} b USING (image_id)")
        taps = self.add(f"""SELECT n_in, n_out, o - 1 AS spot, k, m, unnest(range(floor(m - 3 / k)::BIGINT - 1, floor(m - 3 / k)::BIGINT + ceil(6 / k)::BIGINT + 1)) AS j
            FROM (SELECT *, (o - (n_out - n_in * s) / 2) / s + 0.5 * (1 - 1 / s) AS m
                  FROM (SELECT *, n_out / n_in::DOUBLE AS s, least(1.0::DOUBLE, n_out / n_in::DOUBLE) AS k, unnest(range(1, n_out + 1)) AS o FROM {sides}))""")
        weighed = self.add(f"""SELECT n_in, n_out, spot, CASE WHEN i < n_in THEN i ELSE 2 * n_in - 1 - i END AS i, sum(w) / sum(sum(w)) OVER (PARTITION BY n_in, n_out, spot) AS w
            FROM (SELECT *, ((j % (2 * n_in)) + 2 * n_in) % (2 * n_in) AS i,
                  CASE WHEN d <= 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d <= 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END AS w
                  FROM (SELECT *, abs(k * (m - j - 1)) AS d FROM {taps})) GROUP BY n_in, n_out, spot, i""")
        lines = self.add(f"""SELECT p.image_id, c, t.spot AS y, x, sum(t.w * v) AS v FROM {px} p JOIN {of} a USING (image_id) JOIN {to} b USING (image_id)
            JOIN {weighed} t ON t.n_in = a.h AND t.n_out = b.h AND t.i = p.y GROUP BY ALL""")
        return self.add(f"""SELECT p.image_id, c, y::INT AS y, t.spot::INT AS x, sum(t.w * v) AS v FROM {lines} p JOIN {of} a USING (image_id) JOIN {to} b USING (image_id)
            JOIN {weighed} t ON t.n_in = a.w AND t.n_out = b.w AND t.i = p.x GROUP BY ALL""")

    def windows(self, px: str, p: int, stride: int = 1) -> str:
        whole = f"y - dy >= 0 AND x - dx >= 0 AND y - dy <= h - {p} AND x - dx <= w - {p} AND (y - dy) % {stride} = 0 AND (x - dx) % {stride} = 0"
        return self.add(f"""SELECT image_id, (y - dy)::INT AS py, (x - dx)::INT AS px, list(v ORDER BY c, dy, dx) AS v
            FROM {px} JOIN {self.dims(px)} USING (image_id), range({p}) a(dy), range({p}) b(dx) WHERE {whole} GROUP BY ALL""")

    def fold(self, patches: str, px: str, p: int, rho: float, channels: int = 3) -> str:
        g = lambda c: f"(-1 + 2.0::DOUBLE * {c} / {max(1, p - 1)})"
        weight = f"exp(-0.5 * pow({g('dy')} / {number(rho)}, 2)) * exp(-0.5 * pow({g('dx')} / {number(rho)}, 2))"
        flat = self.add(f"SELECT image_id, c, py + dy AS y, px + dx AS x, {weight} AS w, v[c * {p * p} + dy * {p} + dx + 1] AS v "
                        f"FROM {patches}, range({channels}) k(c), range({p}) a(dy), range({p}) b(dx)")
        return self.add(f"""SELECT image_id, c, y, x, coalesce(f.v, 0) AS v FROM (SELECT image_id, c, y, x FROM {px}) LEFT JOIN
            (SELECT image_id, c, y, x, sum(w * v) / sum(w) AS v FROM {flat} GROUP BY ALL) f USING (image_id, c, y, x)""")

    def denoise(self, px: str, prior: str, alpha: float, sigma: float, p: int, rho: float, of: str | None = None, stride: int = 1,
                nearest: int | None = None) -> str:
        """of: (image_id, prior_id), if the patches are another image's. nearest: how many patches count, all if None."""
        queries, d = self.windows(px, p, stride), 3 * p * p
        aimed = f"(SELECT image_id AS prior_id, * FROM {queries})" if of is None else f"(SELECT * FROM {queries} JOIN {of} USING (image_id))"
        scaled = self.add(f"SELECT image_id AS prior_id, v, list_transform(v, lambda e: {number(alpha)} * e) AS av FROM {prior}")
        logits = self.add(f"SELECT q.image_id, py, px, s.v, -pow(list_distance(q.v, av), 2) / (2 * {number(sigma)} * {number(sigma)}) AS l FROM {aimed} q JOIN {scaled} s USING (prior_id)"
                          + (f" QUALIFY row_number() OVER (PARTITION BY q.image_id, py, px ORDER BY l DESC) <= {nearest}" if nearest else ""))
        top = self.add(f"SELECT image_id, py, px, max(l) AS top FROM {logits} GROUP BY ALL")
        sums = ", ".join(f"sum(e * v[{i}]) / sum(e)" for i in range(1, d + 1))
        mean = self.add(f"SELECT image_id, py, px, [{sums}] AS v FROM (SELECT image_id, py, px, v, exp(l - top) AS e FROM {logits} JOIN {top} USING (image_id, py, px)) GROUP BY ALL")
        return self.fold(mean, px, p, rho)

    def roll(self, px: str, dy: int, dx: int, back: bool = False) -> str:
        sign = "-" if back else "+"
        return self.add(f"""SELECT image_id, c, ((y {sign} {dy} * (h // 2) + h) % h)::INT AS y, ((x {sign} {dx} * (w // 2) + w) % w)::INT AS x, v
            FROM {px} JOIN {self.dims(px)} USING (image_id)""")

    def normal(self, seed: int, scale: int, t: int, who: str = "image_id") -> str:
        u = lambda i: (f"((('0x' || substr(md5(concat_ws(':', {i}, {seed}, {scale}, {t}, {who}, c, y, x)), 1, 13))::BIGINT::DOUBLE + 0.5) "  # noqa: E731
                       "/ 4503599627370496.0::DOUBLE)")
        return f"sqrt(-2 * ln({u(1)})) * cos(2 * pi() * {u(2)})"

    def noise(self, dims: str, seed: int, scale: int, t: int, sigma: float, who: str = "image_id") -> str:
        places = self.add(f"SELECT *, unnest(range(w))::INT AS x FROM (SELECT *, unnest(range(h))::INT AS y FROM (SELECT *, unnest(range(3))::INT AS c FROM {dims}))")
        return self.add(f"SELECT image_id, c, y, x, {number(sigma)} * {self.normal(seed, scale, t, who)} AS v FROM {places}")

    def moved(self, px: str, hat: str, target: str, here: tuple[float, float], there: tuple[float, float]) -> str:
        if there[1] == 0:
            return target
        eps = f"(a.v - {number(here[0])} * b.v) / {number(here[1])}"
        return self.add(f"SELECT image_id, c, y, x, {number(there[0])} * d.v + {number(there[1])} * {eps} AS v FROM {px} a "
                        f"JOIN {hat} b USING (image_id, c, y, x) JOIN {target} d USING (image_id, c, y, x)")

    def blend(self, fine: str, coarser: str) -> str:
        full = self.dims(fine)
        up, low = self.resize(coarser, full), self.resize(self.resize(fine, self.scaled(full, 0.5)), full)
        return self.add(f"SELECT image_id, c, y, x, a.v + b.v - d.v AS v FROM {up} a JOIN {fine} b USING (image_id, c, y, x) JOIN {low} d USING (image_id, c, y, x)")

    def mirrored(self, px: str) -> str:
        """The left half onto the right."""
        return self.add(f"SELECT image_id, c, y, unnest(list_distinct([x, w - 1 - x]))::INT AS x, v FROM {px} JOIN {self.dims(px)} USING (image_id) WHERE x <= w - 1 - x")

    def seamless(self, px: str, estimate: Callable[[str], str]) -> str:
        """The blend of the plain view and the one rolled sideways."""
        plain, view = estimate(px), self.roll(estimate(self.roll(px, 0, 1)), 0, 1, True)
        return self.add(f"SELECT image_id, c, y, x, CASE WHEN x >= w // 4 AND x < 3 * w // 4 THEN a.v ELSE b.v END AS v FROM {plain} a JOIN {view} b USING (image_id, c, y, x) JOIN {self.dims(px)} USING (image_id)")

    def fill(self, px: str, estimate: Callable[[str, float, float], str], steps: list[tuple[float, float]], start: int, coarser: str | None) -> str:
        for t in range(start, 0, -1):
            hat = estimate(px, *steps[t])
            target = self.blend(hat, coarser) if coarser and t > 1 else hat
            px = self.moved(px, hat, target, steps[t], steps[t - 1])
        return px

    def sample(self, px: str, num_scales: int, num_steps: int, p: int, rho: float, seed: int = 0, shapes: Callable[[int], str] | None = None,
               coarsest: str | None = None, after: Callable[[str], str] | None = None, tile: bool = False, of: str | None = None, who: str = "image_id") -> str:
        """of: (image_id, prior_id) and the columns that `who` names, if runs are not the images themselves."""
        steps, base = levels(num_steps), self.dims(px)
        scales, out = [px], coarsest
        for s in range(1, num_scales):
            scales.append(self.resize(scales[-1], self.scaled(base, 0.5**s)))
        for s in range(num_scales - (2 if coarsest else 1), -1, -1):
            prior = self.windows(scales[s], p)
            dims = shapes(s) if shapes else self.dims(scales[s])
            if of:
                dims = self.add(f"SELECT o.*, h, w FROM {of} o JOIN {dims} d ON d.image_id = o.prior_id")

            def estimate(now: str, alpha: float, sigma: float, prior: str = prior) -> str:
                one = lambda view: self.denoise(view, prior, alpha, sigma, p, rho, of)
                made = self.seamless(now, one) if tile else one(now)
                return after(made) if after else made

            out = self.fill(self.noise(dims, seed, s, num_steps, steps[-1][1], who), estimate, steps, num_steps, out)
        return out

    def invert(self, px: str, prior: str, num_steps: int, p: int, rho: float, scale: int = 0, seed: int = 0, stop: int | None = None) -> str:
        steps = levels(num_steps)
        now = self.add(f"SELECT image_id, c, y, x, {number(steps[1][0])} * v + {number(steps[1][1])} * {self.normal(seed, scale, 1)} AS v FROM {px}")
        for t in range(1, stop or num_steps):
            hat = self.denoise(now, prior, *steps[t], p, rho)
            now = self.moved(now, hat, hat, steps[t], steps[t + 1])
        return now
