"""Scalar vector functions as pure Column builders: distances, norms, arithmetic, bits, paths.

All take array columns of numbers; elements are widened to double first, so results do not depend on float summation.
A null array, or a null element, gives a null result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: ColumnLike) -> Column:
    return col(v).cast("array<double>")


def _zip(x: ColumnLike, y: ColumnLike, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(doubles(x), doubles(y), f)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


# ---- distances


def l2sq(x: ColumnLike, y: ColumnLike) -> Column:
    return total(_zip(x, y, lambda a, b: (a - b) * (a - b)))


def l2(x: ColumnLike, y: ColumnLike) -> Column:
    return F.sqrt(l2sq(x, y))


def inner_product(x: ColumnLike, y: ColumnLike) -> Column:
    return total(_zip(x, y, lambda a, b: a * b))


def l1(x: ColumnLike, y: ColumnLike) -> Column:
    return total(_zip(x, y, lambda a, b: F.abs(a - b)))


def linf(x: ColumnLike, y: ColumnLike) -> Column:
    return F.array_max(_zip(x, y, lambda a, b: F.abs(a - b)))


def lp(x: ColumnLike, y: ColumnLike, p: float) -> Column:
    """Sum of p-th powers, without the root."""
    return total(_zip(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))))


def canberra(x: ColumnLike, y: ColumnLike) -> Column:
    """Terms of two zeros count as zero."""
    return total(_zip(x, y, lambda a, b: F.coalesce(F.abs(a - b) / F.nullif(F.abs(a) + F.abs(b), F.lit(0.0)), F.lit(0.0))))


def braycurtis(x: ColumnLike, y: ColumnLike) -> Column:
    return l1(x, y) / F.nullif(total(_zip(x, y, lambda a, b: F.abs(a + b))), F.lit(0.0))


def jensenshannon(x: ColumnLike, y: ColumnLike) -> Column:
    """Of positive components."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return -a * F.ln(m / a) - b * F.ln(m / b)

    return total(_zip(x, y, term)) / 2


def jaccard(x: ColumnLike, y: ColumnLike) -> Column:
    """Weighted Jaccard similarity of positive components; larger is nearer."""
    return total(_zip(x, y, lambda a, b: F.least(a, b))) / F.nullif(total(_zip(x, y, lambda a, b: F.greatest(a, b))), F.lit(0.0))


def cosine(x: ColumnLike, y: ColumnLike) -> Column:
    return inner_product(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))


def hamming(x: ColumnLike, y: ColumnLike) -> Column:
    """Differing bits of two arrays of words."""
    bits = F.zip_with(col(x), col(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def generalized_hamming(x: ColumnLike, y: ColumnLike) -> Column:
    """Positions at which two arrays differ."""
    return F.aggregate(F.zip_with(col(x), col(y), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, b: a + b)


#: name -> (function, whether larger is nearer)
METRICS: dict[str, tuple[Callable[[ColumnLike, ColumnLike], Column], bool]] = {
    "l2sq": (l2sq, False), "l2": (l2, False), "ip": (inner_product, True), "cosine": (cosine, True), "l1": (l1, False), "linf": (linf, False),
    "canberra": (canberra, False), "braycurtis": (braycurtis, False), "jensenshannon": (jensenshannon, False), "jaccard": (jaccard, True),
    "hamming": (hamming, False), "generalized_hamming": (generalized_hamming, False),
}


def metric(name: str) -> tuple[Callable[[ColumnLike, ColumnLike], Column], bool]:
    if name.startswith("lp:"):
        p = float(name[3:])
        return (lambda x, y: lp(x, y, p)), False
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}, lp:<p>")
    return METRICS[name]


# ---- norms and arithmetic


def norm_sq(x: ColumnLike) -> Column:
    return total(F.transform(doubles(x), lambda a: a * a))


def norm(x: ColumnLike) -> Column:
    return F.sqrt(norm_sq(x))


def normalize(x: ColumnLike) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(x)
    return F.when(n > 0, F.transform(doubles(x), lambda a: a / n)).otherwise(doubles(x))


def add(x: ColumnLike, y: ColumnLike) -> Column:
    return _zip(x, y, lambda a, b: a + b)


def sub(x: ColumnLike, y: ColumnLike) -> Column:
    return _zip(x, y, lambda a, b: a - b)


def add_scalar(x: ColumnLike, s: float) -> Column:
    return F.transform(doubles(x), lambda a: a + F.lit(float(s)))


def madd(x: ColumnLike, factor: float, y: ColumnLike) -> Column:
    """x + factor * y"""
    return _zip(x, y, lambda a, b: a + F.lit(float(factor)) * b)


def argmin(x: ColumnLike) -> Column:
    """Zero-based position of the first smallest element."""
    return (F.array_position(col(x), F.array_min(col(x))) - 1).cast("int")


def ip_to_l2sq(norm_sq_x: Column, norm_sq_y: Column, ip: Column) -> Column:
    return norm_sq_x + norm_sq_y - 2 * ip


def to_literal(x: ColumnLike, digits: int = 6) -> Column:
    """Text form, as in '[0.100000,...]'."""
    return F.concat(F.lit("["), F.array_join(F.transform(doubles(x), lambda a: F.format_string(f"%.{digits}f", a)), ","), F.lit("]"))


def rescale_u8(x: ColumnLike) -> Column:
    """Bytes 0..255 to -0.5..0.5."""
    return F.transform(doubles(x), lambda a: a / 255 - 0.5)


def masked_mean(rows: ColumnLike, mask: ColumnLike) -> Column:
    """Mean over the vectors of ``rows`` whose mask is 1."""
    kept = F.filter(F.arrays_zip(rows, mask), lambda z: z["1"] > 0)
    return F.transform(F.sequence(F.lit(0), F.size(F.element_at(col(rows), 1)) - 1), lambda i: total(F.transform(kept, lambda z: F.get(z["0"], i).cast("double"))) / F.size(kept))


# ---- bits and codes


def pack_signs(x: ColumnLike, thresholds: list[float] | None = None) -> Column:
    """Bit i of word i / 64 is set where component i exceeds 0, or its threshold."""
    v = doubles(x)
    t = F.array(*map(F.lit, thresholds)) if thresholds else None
    bit = lambda i: F.when(F.get(v, i) > (F.get(t, i) if t is not None else F.lit(0.0)), F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.sequence(w * 64, F.least(w * 64 + 63, F.size(v) - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), word)


def unpack_signs(words: ColumnLike, d: int) -> Column:
    """+1 and -1 of each of the first d bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.call_function("shiftrightunsigned", F.get(col(words), (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long")) == 1, 1.0).otherwise(-1.0))


def remap(x: ColumnLike, positions: list[int]) -> Column:
    """Component positions[i] at i; -1 gives 0."""
    return F.array(*(F.lit(0.0) if p < 0 else F.coalesce(F.get(doubles(x), F.lit(p)), F.lit(0.0)) for p in positions))


def pad(x: ColumnLike, d: int) -> Column:
    v = doubles(x)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(d) - F.size(v))))


def linear(x: ColumnLike, rows: list[list[float]], bias: list[float] | None = None) -> Column:
    """A x + b"""
    v = doubles(x)
    a = F.array(*(F.array(*map(F.lit, map(float, r))) for r in rows))
    y = F.transform(a, lambda r: total(F.zip_with(r, v, lambda p, q: p * q)))
    return F.zip_with(y, F.array(*map(F.lit, map(float, bias))), lambda p, q: p + q) if bias else y


def path_code(children: list[Column]) -> Column:
    """Child numbers, from the root down, in six bits each from the top of a long (four levels at most here in use: nine)."""
    code = F.lit(0).cast("long")
    for level, c in enumerate(children):
        code = code.bitwiseOR(F.call_function("shiftleft", c.cast("long"), F.lit(58 - 6 * level)))
    return code


def path_child(code: ColumnLike, level: int) -> Column:
    return F.call_function("shiftrightunsigned", col(code), F.lit(58 - 6 * level)).bitwiseAND(F.lit(63).cast("long")).cast("int")
