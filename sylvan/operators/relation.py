"""The relation that every operation returns: candidates keyed by path, closed under set algebra.

Rows are ordered, though no position is stored: the order is (_side, _rank, path), where
_rank comes from a sort by score and _side puts what a union adds behind its left side.
Ordering is done when rows are shown or limited, never by a global window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions import paths as P
from sylvan.functions.shipping import ship
from sylvan.schema import CANDIDATE, DEFAULTS, FIELDS, missing

HIDDEN = ("_side", "_rank")


def conform(df: DataFrame) -> DataFrame:
    """The candidate columns, absent ones null, with the hidden order."""
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else missing(f.name) for f in CANDIDATE]
    hidden = [F.col("_side") if "_side" in have else F.lit(0).alias("_side"), F.col("_rank") if "_rank" in have else F.lit(0.0).alias("_rank")]
    return df.select(*cols, *hidden)


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    function: str = ""
    errors: tuple[str, ...] = ()
    sides: int = 1
    fields: tuple[str, ...] = field(default=("path",))
    #: Whether no path is known to stand twice.
    keyed: bool = False

    @classmethod
    def of(cls, df: DataFrame, function: str = "", errors: Iterable[str] = ()) -> Relation:
        """Rows from anywhere, in which paths may repeat."""
        return cls(conform(df), function, tuple(errors), 1, tuple(f for f in FIELDS if f in df.columns))

    @classmethod
    def by_path(cls, df: DataFrame, function: str = "", errors: Iterable[str] = ()) -> Relation:
        """Rows of which each has a path of its own, as all operators give them."""
        return replace(cls.of(df, function, errors), keyed=True)

    @property
    def success(self) -> bool:
        return not self.errors

    @property
    def order(self) -> list[Column]:
        return [F.col("_side").asc(), F.col("_rank").asc(), F.col("path").asc()]

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order)

    def select(self, *names: str) -> DataFrame:
        return self.df.select(*names)

    def _with(self, df: DataFrame, **more: object) -> Relation:
        return replace(self, df=df, **more)

    def _named(self, other: Relation) -> str:
        if self.function == other.function or not other.function:
            return self.function
        return other.function if not self.function else "hybrid"

    def _paired(self, other: Relation, how: str) -> DataFrame:
        a, b = self.unique().df.alias("a"), other.unique().df.alias("b")
        both = a.join(b, F.col("a.path") == F.col("b.path"), how)
        side = F.when(F.col("a.path").isNotNull(), F.col("a._side")).otherwise(F.col("b._side") + self.sides)
        rank = F.when(F.col("a.path").isNotNull(), F.col("a._rank")).otherwise(F.col("b._rank"))
        return both.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in FIELDS], side.alias("_side"), rank.alias("_rank"))

    def _merged(self, other: Relation, how: str, sides: int) -> Relation:
        known = tuple(f for f in FIELDS if f in self.fields or f in other.fields)
        return Relation(self._paired(other, how), self._named(other), self.errors + other.errors, sides, known, True)

    def __and__(self, other: Relation) -> Relation:
        """Paths that both have; the left value of a column wins where it is set."""
        return self._merged(other, "inner", self.sides)

    def __or__(self, other: Relation) -> Relation:
        """Paths that either has, the left ones first."""
        return self._merged(other, "full_outer", self.sides + other.sides)

    def __sub__(self, other: Relation) -> Relation:
        return self._with(self.unique().df.join(other.df.select("path"), "path", "left_anti").select(*FIELDS, *HIDDEN), keyed=True)

    def unique(self) -> Relation:
        """One row a path: of repeated ones the last in the order of the rows."""
        if self.keyed:
            return self
        placed = self.df.withColumn("_at", F.monotonically_increasing_id())
        last = F.max_by(F.struct(*[c for c in FIELDS if c != "path"], *HIDDEN), F.struct(*HIDDEN, "_at"))
        return self._with(placed.groupBy("path").agg(last.alias("x")).select("path", "x.*").select(*FIELDS, *HIDDEN), keyed=True)

    def sort(self, reverse: bool = True) -> Relation:
        """Stable, by score, the highest first; an unset score is the lowest."""
        score = F.coalesce("score", F.lit(float("-inf")))
        return self._with(self.df.withColumn("_rank", -score if reverse else score).withColumn("_side", F.lit(0)), sides=1)

    def top(self, k: int) -> Relation:
        if k < 1:
            raise ValueError("k must be at least 1")
        best = self.sort()
        return best._with(best.df.orderBy(*best.order).limit(k))

    def limit(self, k: int | None) -> Relation:
        return self if k is None else self._with(self.df.orderBy(*self.order).limit(k))

    def kinds(self, *kinds: str) -> Relation:
        return self._with(self.df.where(F.col("kind").isin(*kinds)))

    def filter(self, test: Column | Callable) -> Relation:
        """By a Column, or by a function of one row (its values by name), which runs in Arrow batches."""
        if isinstance(test, Column):
            return self._with(self.df.where(test))

        ship()

        def run(batches):
            for pdf in batches:
                yield pdf[[bool(test(r)) for r in pdf.to_dict("records")]] if len(pdf) else pdf

        return self._with(self.df.mapInPandas(run, self.df.schema))

    def visible(self, *kinds: str, every: bool = False) -> Relation:
        if every:
            return self
        return self._with(self.df.where(F.coalesce("kind", P.kind_col(F.col("path"))).isin(*kinds)))

    def hydrate(self, entries: DataFrame, names: Iterable[str]) -> Relation:
        """Entry columns that no row has are filled from the entries by one join; others stay as they are."""
        wanted = [n for n in names if n in ("kind", "content", "size_bytes", "updated_at")]
        if not wanted:
            return self
        have = self.df.agg(*[F.count(n).alias(n) for n in wanted]).first()
        empty = [n for n in wanted if not have[n]]
        if not empty:
            return self
        live = entries.where("deleted_at is null").select("path", *[F.col(n).alias(f"_{n}") for n in empty])
        both = self.df.join(live, "path", "left")
        return self._with(both.select(*[F.col(f"_{c}").alias(c) if c in empty else F.col(c) for c in FIELDS], *HIDDEN), fields=(*self.fields, *empty))

    def add_prefix(self, prefix: str) -> Relation:
        """Paths below a mount; both ends of edge paths move."""
        e = P.split_edge_col(F.col("path"))
        moved = F.when(F.col("path") == "/", prefix).when(e.isNotNull(), F.when(e["outgoing"], P.edge_out_col(F.concat(F.lit(prefix), e["source"]), F.concat(F.lit(prefix), e["target"]), e["type"])).otherwise(P.edge_in_col(F.concat(F.lit(prefix), e["source"]), F.concat(F.lit(prefix), e["target"]), e["type"])))
        moved = moved.when(F.col("path").startswith(P.META + "/"), F.concat(F.lit(P.META + prefix), F.substr("path", F.lit(len(P.META) + 1)))).otherwise(F.concat(F.lit(prefix), F.col("path")))
        return self._with(self.df.withColumn("path", moved))

    def strip_scope(self, user: str) -> Relation:
        lead = f"/{user}"
        cut = lambda c: F.when(c == lead, "/").when(c.startswith(lead + "/"), F.substr(c, F.lit(len(lead) + 1))).otherwise(c)
        e = P.split_edge_col(F.col("path"))
        back = F.when(e.isNotNull(), F.when(e["outgoing"], P.edge_out_col(cut(e["source"]), cut(e["target"]), e["type"])).otherwise(P.edge_in_col(cut(e["source"]), cut(e["target"]), e["type"])))
        back = back.when(F.col("path").startswith(P.META + "/"), F.concat(F.lit(P.META), cut(F.substr("path", F.lit(len(P.META) + 1))))).otherwise(cut(F.col("path")))
        return self._with(self.df.withColumn("path", back))

    def project(self, names: Iterable[str] | None = None) -> tuple[str, ...]:
        """Column names for an output list with the words default and all."""
        out: list[str] = []
        for n in names or ("default",):
            if n == "default":
                out += DEFAULTS.get(self.function, self.fields)
            elif n == "all":
                seen = self.df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in FIELDS]).first()
                out += [c for c in FIELDS if seen[c]]
            elif n in FIELDS:
                out.append(n)
            else:
                raise ValueError(f"unknown field {n!r}; fields are {', '.join(FIELDS)}")
        return tuple(dict.fromkeys(["path", *out]))
