"""Boolean formulas over labels in prefix order: ``AND 1 OR NOT 0 2``.

A formula is compiled once, on the driver, to a Column over a ``labels`` array, to SQL text, or to the state that a
cluster's label counts give it. Vectors without labels never satisfy a formula in the default universe ("labelled");
in the universe "all" they satisfy what the formula says of no labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARITY = {"AND": 2, "OR": 2, "NOT": 1}


def tokenize(formula: str) -> list[str]:
    return formula.split()


def parse(formula: str) -> tuple:
    """('AND' | 'OR', a, b), ('NOT', a) or ('LABEL', n). Leftover or missing operands are errors."""
    tokens = tokenize(formula)

    def take(at: int) -> tuple[tuple, int]:
        if at >= len(tokens):
            raise ValueError(f"{formula!r}: an operand is missing")
        t = tokens[at]
        if t in ARITY:
            parts, at = [], at + 1
            for _ in range(ARITY[t]):
                p, at = take(at)
                parts.append(p)
            return (t, *parts), at
        try:
            return ("LABEL", int(t)), at + 1
        except ValueError:
            raise ValueError(f"{formula!r}: {t!r} is neither an operator nor a label") from None

    tree, end = take(0)
    if end != len(tokens):
        raise ValueError(f"{formula!r}: {' '.join(tokens[end:])!r} is left over")
    return tree


def fold(tree: tuple, label, conj, disj, neg):
    op, *args = tree
    if op == "LABEL":
        return label(args[0])
    parts = [fold(a, label, conj, disj, neg) for a in args]
    return neg(parts[0]) if op == "NOT" else (conj if op == "AND" else disj)(*parts)


def _guard(labels: Column, universe: str) -> Column:
    if universe not in ("labelled", "all"):
        raise ValueError("universe is 'labelled' or 'all'")
    return F.size(labels) > 0 if universe == "labelled" else F.lit(True)


def to_column(formula: str, labels: Column | str = "labels", universe: str = "labelled") -> Column:
    c = F.col(labels) if isinstance(labels, str) else labels
    own = F.coalesce(c, F.array().cast("array<int>"))
    return fold(parse(formula), lambda n: F.array_contains(own, F.lit(n)), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a) & _guard(own, universe)


def to_sql(formula: str, labels: str = "labels", contains: str = "array_contains", universe: str = "labelled") -> str:
    text = fold(parse(formula), lambda n: f"{contains}({labels}, {n})", lambda a, b: f"({a} AND {b})", lambda a, b: f"({a} OR {b})", lambda a: f"(NOT {a})")
    size = "size" if contains == "array_contains" else "len"
    return f"({text} AND {size}({labels}) > 0)" if universe == "labelled" else text


def labels_of(formula: str) -> set[int]:
    return fold(parse(formula), lambda n: {n}, lambda a, b: a | b, lambda a, b: a | b, lambda a: a)


def evaluate(formula: str, labels: set[int] | list[int], universe: str = "labelled") -> bool:
    own = set(labels)
    return (bool(own) or universe == "all") and fold(parse(formula), lambda n: n in own, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def evaluate_table(frame: DataFrame, labels: str = "labels", formula: str = "formula") -> Column:
    """The formula column of each row on the labels of the same row: a stack machine from right to left."""
    tokens = F.reverse(F.split(F.trim(F.col(formula)), r"\s+"))
    own = F.col(labels)

    def step(stack: Column, t: Column) -> Column:
        a, b, rest1, rest2 = F.get(stack, F.lit(0)), F.get(stack, F.lit(1)), F.slice(stack, 2, F.greatest(F.size(stack), F.lit(1))), F.slice(stack, 3, F.greatest(F.size(stack), F.lit(1)))
        return (
            F.when(t == "AND", F.concat(F.array(a & b), rest2)).when(t == "OR", F.concat(F.array(a | b), rest2)).when(t == "NOT", F.concat(F.array(~a), rest1))
            .otherwise(F.concat(F.array(F.array_contains(own, F.when(t.rlike("^-?[0-9]+$"), t).cast("int"))), stack))
        )

    return (F.size(own) > 0) & F.get(F.aggregate(tokens, F.array().cast("array<boolean>"), step), F.lit(0))


# ---- states of a cluster


@dataclass(frozen=True)
class State:
    """What is known of a formula on a cluster's vectors: NONE, ALL, UNKNOWN, SOME (these ids) or MOST (all but these)."""

    kind: str
    ids: frozenset = frozenset()

    @staticmethod
    def make(kind: str, ids=()) -> State:
        ids = frozenset(ids)
        if kind == "SOME" and not ids:
            return State("NONE")
        if kind == "MOST" and not ids:
            return State("ALL")
        return State(kind, ids if kind in ("SOME", "MOST") else frozenset())

    def __invert__(self) -> State:
        flip = {"NONE": "ALL", "ALL": "NONE", "SOME": "MOST", "MOST": "SOME", "UNKNOWN": "UNKNOWN"}
        return State.make(flip[self.kind], self.ids)

    def __and__(self, other: State) -> State:
        kinds = {self.kind, other.kind}
        if "NONE" in kinds:
            return State("NONE")
        if self.kind == "ALL" or other.kind == "ALL":
            return other if self.kind == "ALL" else self
        if "UNKNOWN" in kinds:
            return State("UNKNOWN")
        if kinds == {"SOME"}:
            return State.make("SOME", self.ids & other.ids)
        if kinds == {"MOST"}:
            return State.make("MOST", self.ids | other.ids)
        some, most = (self, other) if self.kind == "SOME" else (other, self)
        return State.make("SOME", some.ids - most.ids)

    def __or__(self, other: State) -> State:
        return ~(~self & ~other)


def cluster_state(formula: str, count: dict[int, Column], size: Column) -> tuple[Column, Column]:
    """Bounds (least, most) on how many of ``size`` vectors satisfy the formula, from counts by label: prunes whole clusters."""
    zero = F.lit(0).cast("long")
    leaf = lambda n: (count.get(n, zero), count.get(n, zero))
    return fold(
        parse(formula), leaf,
        lambda a, b: (F.greatest(zero, a[0] + b[0] - size), F.least(a[1], b[1])),
        lambda a, b: (F.greatest(a[0], b[0]), F.least(size, a[1] + b[1])),
        lambda a: (size - a[1], size - a[0]),
    )


def state_name(least: Column, most: Column, size: Column) -> Column:
    return F.when(most <= 0, "NONE").when(least >= size, "ALL").otherwise("SOME")


# ---- selectors over ids


def in_range(c: Column, low, high) -> Column:
    """Half open."""
    return (c >= low) & (c < high)


def in_bitmap(c: Column, bitmap: bytes) -> Column:
    """Bit id % 8 of byte id / 8."""
    packed = F.array(*(F.lit(b) for b in bitmap)) if bitmap else F.array().cast("array<int>")
    byte = F.get(packed, (c / 8).cast("int"))
    return F.coalesce(F.call_function("shiftrightunsigned", byte, (c % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & (c >= 0)


def fill_templates(templates: list[str], labels: list[int], count: int, seed: int = 42) -> list[str]:
    """``count`` formulas for each template, with distinct labels in its slots."""
    import random

    rng = random.Random(seed)
    out = []
    for t in templates:
        seen: set[str] = set()
        slots = len({p for p in t.replace("{", " {").split() if p.startswith("{")})
        for _ in range(count * 20):
            if len(seen) == count:
                break
            seen.add(t.format(*rng.sample(labels, slots)))
        out += sorted(seen)
    return out


def template_of(formula: str) -> str:
    """The formula with its labels as slots."""
    return " ".join(t if t in ("AND", "OR", "NOT") else "{}" for t in tokenize(formula))
