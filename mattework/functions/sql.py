"""Column formulas as SQL text. Catalyst gets plain expressions that it can put into generated code; the
few functions that engines name or round differently come from a dialect, so the same relation can be
stated for another engine and compared with it pixel by pixel."""

from __future__ import annotations

from dataclasses import dataclass


def num(x: float) -> str:
    """A double literal in any dialect."""
    return f"{float(x):.17g}e0" if "e" not in f"{float(x):.17g}" else f"{float(x):.17g}"


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def rint(self, x: str) -> str:
        """Half to even, as int."""
        return f"cast(rint({x}) as int)" if self.spark else f"cast(round_even({x}, 0) as int)"

    def trunc(self, x: str) -> str:
        return f"cast({x} as int)" if self.spark else f"cast(trunc({x}) as int)"

    def q(self, x: str, digits: int = 6) -> str:
        """Rounded for a comparison between engines."""
        return f"round({x}, {digits})"

    def table(self, name: str) -> str:
        return f"mattework_{name}" if self.spark else name

    def series(self, n: str, alias: str) -> str:
        """A relation alias(i) of 0..n-1."""
        return f"(SELECT explode(sequence(0, {n} - 1)) AS i) AS {alias}" if self.spark else f"(SELECT unnest(range(cast({n} as bigint))) AS i) AS {alias}"

    def count(self, n: str, name: str) -> str:
        """To stand after a FROM item: each of its rows for every name = 0..n-1, without a join in Spark."""
        return f"LATERAL VIEW explode(sequence(0, {n} - 1)) v_{name} AS {name}" if self.spark else f"CROSS JOIN (SELECT unnest(range(cast({n} as bigint))) AS {name}) v_{name}"

    def each(self, values: list, name: str) -> str:
        """To stand after a FROM item: each of its rows for every name of a few literals."""
        told = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
        return f"LATERAL VIEW explode(array({told})) v_{name} AS {name}" if self.spark else f"CROSS JOIN (SELECT unnest([{told}]) AS {name}) v_{name}"

    def merged(self, *aliases: str) -> str:
        """To stand after SELECT: Spark joins these relations by merge. Its estimate of what is made from a table is of the
        table's compressed files, so it would send millions of pixels to all by way of the driver."""
        return f"/*+ MERGE({', '.join(aliases)}) */ " if self.spark else ""

    def without(self, *columns: str) -> str:
        """All columns but these."""
        return f"* {'EXCEPT' if self.spark else 'EXCLUDE'} ({', '.join(columns)})"

    def unpack(self, array: str, alias: str) -> str:
        """(pos, val) of an array column, positions from 0."""
        return f"LATERAL VIEW posexplode({array}) {alias} AS pos, val" if self.spark else f", LATERAL (SELECT unnest(range(len({array}))) AS pos, unnest({array}) AS val) {alias}"

    def lut(self, index: str, values: list[float]) -> str:
        told = ", ".join(repr(v) + ("" if "e" in repr(v) else "e0") for v in values)
        return f"element_at(array({told}), cast({index} as int) + 1)" if self.spark else f"([{told}]::DOUBLE[])[cast({index} as int) + 1]"

    def median(self, x: str, where: str = "true") -> str:
        return f"median(cast({x} as double)) FILTER (WHERE {where})"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {num(p)})" if self.spark else f"quantile_cont({x}, {num(p)})"

    def sha(self, parts: str, order: str) -> str:
        if self.spark:
            return f"sha2(array_join(transform(array_sort(collect_list(struct({order}, {parts} AS v))), s -> s.v), ';'), 256)"
        return f"sha256(string_agg({parts}, ';' ORDER BY {order}))"

    def concat(self, *xs: str) -> str:
        return f"concat_ws(',', {', '.join(f'cast({x} as string)' if self.spark else f'cast({x} as varchar)' for x in xs)})"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def clip(x: str, low: float = 0, high: float = 1) -> str:
    return f"greatest({num(low)}, least({num(high)}, {x}))"


def u8(x: str) -> str:
    return f"greatest(0, least(255, {x}))"


def smoothstep(e0: str, e1: str, x: str) -> str:
    """3t^2 - 2t^3 between the edges; a step at e1 where they do not rise."""
    t = f"greatest(0e0, least(1e0, (({x}) - ({e0})) / greatest(({e1}) - ({e0}), 1e-12)))"
    return f"(CASE WHEN ({e1}) <= ({e0}) THEN (CASE WHEN ({x}) >= ({e1}) THEN 1e0 ELSE 0e0 END) ELSE {t} * {t} * (3e0 - 2e0 * {t}) END)"


def ss(e0: float, e1: float, x: str) -> str:
    return smoothstep(num(e0), num(e1), x)


def lerp(a: str, b: str, w: str) -> str:
    return f"(({a}) + (({b}) - ({a})) * ({w}))"


def second(a: str, b: str, c: str) -> str:
    """The middle one of three: the larger of the two that are not the maximum."""
    return f"greatest(least({a}, {b}), least({a}, {c}), least({b}, {c}))"


def of_key(star: str, a: str, b: str, c: str) -> str:
    return f"(CASE {star} WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END)"


def others(star: str, a: str, b: str, c: str) -> str:
    return f"(CASE {star} WHEN 0 THEN greatest({b}, {c}) WHEN 1 THEN greatest({a}, {c}) ELSE greatest({a}, {b}) END)"


def to_linear(v: int) -> float:
    c = v / 255.0
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


LINEAR = [to_linear(v) for v in range(256)]


def linear(d: Dialect, u: str) -> str:
    return d.lut(u, LINEAR)


def to_srgb(d: Dialect, x: str) -> str:
    c = clip(x)
    return d.rint(f"255e0 * (CASE WHEN {c} <= 0.0031308e0 THEN {c} * 12.92e0 ELSE 1.055e0 * power({c}, {num(1 / 2.4)}) - 0.055e0 END)")


def luma(a: str, b: str, c: str) -> str:
    return f"(0.2126e0 * {a} + 0.7152e0 * {b} + 0.0722e0 * {c})"


def hsv(d: Dialect, r: str, g: str, b: str) -> tuple[str, str, str]:
    """8-bit hue 0..179, saturation, value."""
    high, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    delta = f"cast({high} - {low} as double)"
    safe = f"greatest({delta}, 1e0)"
    degrees = f"(CASE WHEN {delta} = 0e0 THEN 0e0 WHEN {high} = {r} THEN 60e0 * ({g} - {b}) / {safe} WHEN {high} = {g} THEN 120e0 + 60e0 * ({b} - {r}) / {safe} ELSE 240e0 + 60e0 * ({r} - {g}) / {safe} END)"
    return f"({d.rint(f'(CASE WHEN {degrees} < 0e0 THEN {degrees} + 360e0 ELSE {degrees} END) / 2e0')} % 180)", d.rint(f"255e0 * {delta} / greatest(cast({high} as double), 1e0)"), high
