"""Array-of-float columns as vectors. Elements are widened to double before anything is summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def interpolate(x0: Column, x1: Column, t: Column) -> Column:
    """t * x1 + (1 - t) * x0 by element (PRJ-09)."""
    return F.zip_with(wide(x0), wide(x1), lambda a, b: t * b + (F.lit(1.0) - t) * a)


def minus(x1: Column, x0: Column) -> Column:
    """x1 - x0 by element: the velocity of a straight path (PRJ-11)."""
    return F.zip_with(wide(x1), wide(x0), lambda a, b: a - b)


def scaled(v: Column, factor: float) -> Column:
    """Every element times a factor, such as the latent scale 0.18215 (PRJ-42)."""
    return F.transform(wide(v), lambda x: x * F.lit(factor))


def total(v: Column) -> Column:
    return F.aggregate(wide(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def gated(g: Column, a: Column, b: Column) -> Column:
    """g * a + (1 - g) * b with a gate for each element (PRJ-20)."""
    both = F.zip_with(wide(a), wide(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.zip_with(wide(g), both, lambda w, p: w * p["x"] + (F.lit(1.0) - w) * p["y"])


def euler(x0: Column, velocity, steps: int) -> Column:
    """Fixed-step Euler integration of dx/dt = velocity(x, t) from 0 to 1 (PRJ-39); velocity maps columns to a column."""
    h = 1.0 / steps
    times = F.array(*[F.lit(i * h) for i in range(steps)])
    return F.aggregate(times, wide(x0), lambda x, t: F.zip_with(x, velocity(x, t), lambda a, v: a + F.lit(h) * v))


def midpoint(x0: Column, velocity, steps: int) -> Column:
    """The same by the midpoint rule."""
    h = 1.0 / steps
    times = F.array(*[F.lit(i * h) for i in range(steps)])

    def step(x, t):
        half = F.zip_with(x, velocity(x, t), lambda a, v: a + F.lit(h / 2) * v)
        return F.zip_with(x, velocity(half, t + F.lit(h / 2)), lambda a, v: a + F.lit(h) * v)

    return F.aggregate(times, wide(x0), step)


def rk4(x0: Column, velocity, steps: int) -> Column:
    """The same by the classical Runge-Kutta rule (PRJ-39)."""
    h = 1.0 / steps
    times = F.array(*[F.lit(i * h) for i in range(steps)])
    along = lambda x, v, by: F.zip_with(x, v, lambda a, b: a + F.lit(by) * b)

    def step(x, t):
        one = velocity(x, t)
        two = velocity(along(x, one, h / 2), t + F.lit(h / 2))
        three = velocity(along(x, two, h / 2), t + F.lit(h / 2))
        four = velocity(along(x, three, h), t + F.lit(h))
        return along(along(along(along(x, one, h / 6), two, h / 3), three, h / 3), four, h / 6)

    return F.aggregate(times, wide(x0), step)


def sinusoidal(t: Column, size: int, base: float = 10_000.0) -> Column:
    """Sine and cosine time embedding (PRJ-13); the frequency base is our choice."""
    rate = [base ** (-i / (size // 2)) for i in range(size // 2)]
    return F.concat(F.array(*[F.sin(t * r) for r in rate]), F.array(*[F.cos(t * r) for r in rate]))


def recurrence(v: Column, decay: float) -> Column:
    """The states s = decay * s + (1 - decay) * x along an array (WIN-03, WIN-05), starting at its first element."""
    start = F.struct(F.element_at(wide(v), 1).alias("s"), F.array(F.element_at(wide(v), 1)).alias("all"))

    def step(state, x):
        s = F.lit(decay) * state["s"] + F.lit(1 - decay) * x
        return F.struct(s.alias("s"), F.concat(state["all"], F.array(s)).alias("all"))

    rest = F.slice(wide(v), F.lit(2), F.size(v))
    return F.when(F.size(v) > 0, F.aggregate(rest, start, step, lambda state: state["all"])).otherwise(F.array().cast("array<double>"))
