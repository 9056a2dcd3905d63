"""Scalar expressions: transforms, rounding, text, JSON and hashing, all of them Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """Not null, NaN or infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def arcsinh(x: Column | str, cofactor: float = 5.0) -> Column:
    if cofactor <= 0:
        raise ValueError("cofactor must be positive")
    return F.asinh(col(x) / cofactor)


def signed_log1p(x: Column | str) -> Column:
    x = col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column | str, low, high) -> Column:
    """Null stays null; least() and greatest() alone would skip it."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, _c(low)), _c(high)))


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def zscore(x: Column | str, mean, std) -> Column:
    """A std under 1e-12 counts as 1."""
    return (col(x) - _c(mean)) / F.when(_c(std) < 1e-12, 1.0).otherwise(_c(std))


def impute(x: Column | str, value) -> Column:
    x = col(x)
    return F.when(finite(x), x).otherwise(_c(value))


def to_uint8(x: Column | str, low, high) -> Column:
    """Linear to 0..255, truncated; NaN is 0, infinities are the ends."""
    x = col(x)
    scaled = (x - _c(low)) * 255.0 / (_c(high) - _c(low))
    whole = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled))).cast("int")
    return F.when(x.isNull() | F.isnan(x), 0).when(x == INF, 255).when(x == -INF, 0).otherwise(whole)


def rescale_uint8(x: Column | str, low, high) -> Column:
    """Min-max to 0..255, half to even; a constant or non-finite value gives 0."""
    x, low, high = col(x), _c(low), _c(high)
    return F.when((high > low) & finite(x), F.rint((x - low) / (high - low) * 255.0)).otherwise(0.0).cast("int")


def round_half_up(x: Column | str) -> Column:
    return F.floor(col(x) + 0.5)


def round_half_even(x: Column | str) -> Column:
    return F.rint(col(x)).cast("long")


def tone(x: Column | str, low: float, high: float, gamma: float = 1.0, opacity: float = 1.0) -> Column:
    """Contrast, gamma and opacity of a channel: 0..opacity."""
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(x) - low) / (high - low)))
    return F.pow(unit, F.lit(1.0 / gamma)) * opacity


def progress(done: Column | str, total: Column | str, empty: float = 0.0) -> Column:
    """Share of total, within 0..1; `empty` where there is nothing to do."""
    d, t = col(done), col(total)
    return F.when(t <= 0, F.lit(empty)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), d / t)))


def clean_label(x: Column | str, default: str = "channel") -> Column:
    """White space collapsed and trimmed; the default where nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(col(x), r"\s+", " ")), F.lit("")), F.lit(default))


#: Suffixes a file name is freed from, the first that fits.
IMAGE_SUFFIXES = (".ome.tiff", ".ome.tif", ".qptiff", ".btf", ".tf8", ".tiff", ".tif", ".zarr")


def safe_stem(x: Column | str, default: str = "image") -> Column:
    """A file name's stem, with other characters than letters, digits, `_`, `.` and `-` as one `_`, none of `_.` at its ends."""
    x = col(x)
    out = None
    for s in IMAGE_SUFFIXES:
        fits, cut = F.lower(x).endswith(s), F.expr("1") * 0 + F.length(x) - len(s)
        out = F.when(fits, F.substring(x, F.lit(1), cut)) if out is None else out.when(fits, F.substring(x, F.lit(1), cut))
    stem = F.regexp_replace(out.otherwise(x), "[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(stem, "^[_.]+|[_.]+$", ""), F.lit("")), F.lit(default))


def strip_namespace(x: Column | str) -> Column:
    """{namespace}tag to tag."""
    return F.substring_index(col(x), "}", -1)


def strip_first_word(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"^\S+ ", "")


def canonical_json(**items: Column) -> Column:
    """An object with keys in order and no spaces."""
    return F.to_json(F.struct(*[items[k].alias(k) for k in sorted(items)]))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def lookup(positions: Column, index: Column, name: Column, default) -> Column:
    """A map's value by index, by the index as text, by name, or the default."""
    get = lambda k: F.try_element_at(positions, k.cast("string"))
    return F.coalesce(get(index), get(name), _c(default))


def popcount(x: Column | str) -> Column:
    return F.bit_count(col(x))


def bit(x: Column | str, k) -> Column:
    """Little-endian bit k of an integer."""
    return F.getbit(col(x), _c(k))


def within(actual: Column, expected: Column, tolerance: Column) -> Column:
    """A metric check: what is missing or not finite fails."""
    return F.coalesce(finite(actual) & (F.abs(actual - expected) <= tolerance), F.lit(False))


def class_weight(count: Column | str, power: float) -> Column:
    return F.pow(col(count).cast("double"), F.lit(power))


def shortest_edge(height: Column, width: Column, size: int, longest: int) -> tuple[Column, Column]:
    """Height and width after the shorter side becomes `size`, unless the longer one would pass `longest`; half rounds up."""
    h, w = height.cast("double"), width.cast("double")
    scale = size / F.least(h, w)
    h1, w1 = h * scale, w * scale
    again = F.least(F.lit(1.0), longest / F.greatest(h1, w1))
    return F.floor(h1 * again + 0.5).cast("int"), F.floor(w1 * again + 0.5).cast("int")
