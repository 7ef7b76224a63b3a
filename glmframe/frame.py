"""FeatureFrame: a labelled numeric matrix with named features, as a DataFrame.

Two physical layouts, both with one ``label DOUBLE`` column plus optional
pass-through columns (row keys, input-order keys):

* **wide** (the default): one ``f_<i> DOUBLE``
  column per feature, so Catalyst prunes unused features and every
  expression is whole-stage code generated;
* **packed** (on request, for hundreds of features or more): one ``features ARRAY<DOUBLE>`` column. Plans
  stay small however many features there are (a wide plan with thousands of
  columns compiles slowly and a thousand-term sum overflows the code
  generator), and profiles run through vector aggregates.

Logical feature names live in ``feature_names`` and may repeat, which the
physical names never do. Every operator returns a new frame over a lazy
plan; only ``without_constant_features`` runs a job (one aggregate pass).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glmframe.functions.numeric import lenient_number

LABEL = "label"
FEATURE_PREFIX = "f_"
PACKED = "features"


def qcol(name: str) -> Column:
    """A column by its exact name (dots and spaces are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fcol(i: int) -> str:
    """Physical column name of the i-th feature."""
    return f"{FEATURE_PREFIX}{i}"


def name_positions(names: Sequence[str]) -> dict[str, int]:
    """Name -> position; for a repeated name the last position wins."""
    return {n: i for i, n in enumerate(names)}


def split_roles(
    all_names: Sequence[str],
    target: str | None,
    ignore: Iterable[str] = (),
    max_features: int | None = None,
) -> tuple[int | None, list[str], list[int]]:
    """Label position, feature names and their source positions.

    Features are all names that are neither ignored nor the target, in order,
    cut to the first ``max_features`` *after* that removal. A feature name
    that occurs more than once reads the last column of that name.
    """
    pos = name_positions(all_names)
    if target is not None and target not in pos:
        raise KeyError(f"target column {target!r} not found among {list(all_names)}")
    label_pos = pos[target] if target is not None else None
    skip = set(ignore)
    names = [n for n in all_names if n not in skip and n != target]
    if max_features is not None and max_features > 0:
        names = names[:max_features]
    return label_pos, names, [pos[n] for n in names]


def parse_option_list(text: str | Iterable[str] | None) -> set[str]:
    """Comma separated option text -> set of trimmed, non-empty names."""
    if text is None:
        return set()
    parts = text.split(",") if isinstance(text, str) else list(text)
    return {p.strip() for p in parts if p.strip()}


def _as_double(df: DataFrame, name: str, on_error: str) -> Column:
    dtype = df.schema[name].dataType
    c = qcol(name)
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit(1.0)).when(~c, F.lit(0.0))
    if isinstance(dtype, T.StringType):
        return lenient_number(c, on_error=on_error, what=f"column {name}")
    raise TypeError(f"column {name!r} of type {dtype.simpleString()} is not numeric")


def build_frame(
    df: DataFrame,
    label: Column,
    features: Sequence[Column],
    names: Sequence[str],
    carry: Sequence[Column | str] = (),
    packed: bool = False,
) -> "FeatureFrame":
    """Select label + features (+ carry) from ``df`` in the chosen layout."""
    names = tuple(names)
    carry_cols = [qcol(c) if isinstance(c, str) else c for c in carry]
    if packed:
        arr = F.array(*[e.cast("double") for e in features]) if features else F.array().cast("array<double>")
        out = df.select(label.cast("double").alias(LABEL), arr.alias(PACKED), *carry_cols)
    else:
        out = df.select(
            label.cast("double").alias(LABEL),
            *[e.cast("double").alias(fcol(i)) for i, e in enumerate(features)],
            *carry_cols,
        )
    carry_names = tuple(out.columns[len(out.columns) - len(carry_cols):]) if carry_cols else ()
    return FeatureFrame(out, names, carry_names, packed)


@dataclass(frozen=True)
class FeatureFrame:
    df: DataFrame
    feature_names: tuple[str, ...]
    carry: tuple[str, ...] = field(default=())
    packed: bool = False

    # ------------------------------------------------------------------ build
    @classmethod
    def from_columns(
        cls,
        df: DataFrame,
        features: Mapping[str, Column | str] | Sequence[str],
        label: Column | str | None = None,
        carry: Sequence[str] = (),
        packed: bool = False,
    ) -> "FeatureFrame":
        """Frame from column expressions: ``features`` maps name -> expression."""
        if isinstance(features, Mapping):
            items = list(features.items())
        else:
            items = [(n, n) for n in features]
        label_expr = F.lit(0.0) if label is None else (qcol(label) if isinstance(label, str) else label)
        exprs = [qcol(e) if isinstance(e, str) else e for _, e in items]
        return build_frame(df, label_expr, exprs, [n for n, _ in items], list(carry), packed)

    @classmethod
    def from_array(
        cls,
        df: DataFrame,
        array_col: str,
        names: Sequence[str],
        label: Column | str | None = None,
        carry: Sequence[str] = (),
    ) -> "FeatureFrame":
        """Packed frame straight from a numeric array column (no unpacking).

        An array whose length isn't that of ``names`` fails the job; a NULL array
        is a row without features.
        """
        label_expr = F.lit(0.0) if label is None else (qcol(label) if isinstance(label, str) else label)
        array_col_expr = qcol(array_col).cast("array<double>")
        out = df.select(
            label_expr.cast("double").alias(LABEL),
            F.when(
                F.size(array_col_expr) == len(names), array_col_expr
            ).when(
                array_col_expr.isNotNull(),
                F.raise_error(F.concat(F.lit(f"{array_col}: not {len(names)} long but "), F.size(array_col_expr)))
                .cast("array<double>"),
            ).alias(PACKED),
            *[qcol(c) for c in carry],
        )
        return cls(out, tuple(names), tuple(carry), True)

    @classmethod
    def from_table(
        cls,
        df: DataFrame,
        target: str | None = "Y",
        ignore: str | Iterable[str] = (),
        max_features: int | None = None,
        carry: Sequence[str] = (),
        on_error: str = "raise",
        packed: bool = False,
    ) -> "FeatureFrame":
        """Frame from a typed table, with the same role rules as the CSV scan.

        Numeric columns are cast, booleans become 1.0/0.0 and text columns go
        through the lenient number parser. Columns listed in ``carry`` are kept
        as pass-through columns and are never features.
        """
        ignore_set = parse_option_list(ignore) | set(carry)
        all_names = df.columns
        label_pos, names, positions = split_roles(all_names, target or None, ignore_set, max_features)
        label = _as_double(df, all_names[label_pos], on_error) if label_pos is not None else F.lit(0.0)
        exprs = [_as_double(df, all_names[p], on_error) for p in positions]
        return build_frame(df, label, exprs, names, list(carry), packed)

    # ------------------------------------------------------------ accessors
    @property
    def width(self) -> int:
        return len(self.feature_names)

    @property
    def feature_cols(self) -> list[str]:
        """Physical feature columns of the wide layout."""
        if self.packed:
            raise ValueError("a packed frame has one array column; use feature_col(i) / feature_array()")
        return [fcol(i) for i in range(self.width)]

    def feature_col(self, i: int) -> Column:
        """The i-th feature as a column expression (either layout)."""
        return F.col(PACKED)[i] if self.packed else F.col(fcol(i))

    def feature_array(self) -> Column:
        """All features as one ``ARRAY<DOUBLE>`` expression (either layout)."""
        if self.packed:
            return F.col(PACKED)
        if not self.width:
            return F.array().cast("array<double>")
        return F.array(*[F.col(c) for c in self.feature_cols])

    def to_packed(self) -> "FeatureFrame":
        if self.packed:
            return self
        out = self.df.select(F.col(LABEL), self.feature_array().alias(PACKED), *[qcol(c) for c in self.carry])
        return FeatureFrame(out, self.feature_names, self.carry, True)

    def to_wide(self) -> "FeatureFrame":
        if not self.packed:
            return self
        cols = [F.col(LABEL)] + [F.col(PACKED)[i].alias(fcol(i)) for i in range(self.width)]
        out = self.df.select(*cols, *[qcol(c) for c in self.carry])
        return FeatureFrame(out, self.feature_names, self.carry, False)

    def name_positions(self) -> dict[str, int]:
        return name_positions(self.feature_names)

    def with_df(self, df: DataFrame) -> "FeatureFrame":
        return FeatureFrame(df, self.feature_names, self.carry, self.packed)

    def to_df(self, named: bool = True, label: str = LABEL) -> DataFrame:
        """Plain DataFrame; with ``named`` the feature columns carry their names.

        Repeated names cannot be column names, so ``named`` requires unique ones.
        """
        if not named:
            return self.df
        if len(set(self.feature_names)) != self.width:
            raise ValueError("feature names repeat; use named=False")
        cols = [F.col(LABEL).alias(label)]
        cols += [self.feature_col(i).alias(n) for i, n in enumerate(self.feature_names)]
        cols += [qcol(c) for c in self.carry]
        return self.df.select(*cols)

    def checkpoint(self, eager: bool = True) -> "FeatureFrame":
        """Cut the lineage: write the frame to the shared checkpoint folder
        (``spark.checkpoint.dir``) and continue from the written copy, which
        survives executor loss (unlike a local checkpoint)."""
        from glmframe.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(self.df.sparkSession)
        return self.with_df(self.df.checkpoint(eager=eager))

    # ---------------------------------------------------------- projections
    def project_by_index(self, indices: Sequence[int]) -> "FeatureFrame":
        """Keep (reorder, repeat) features by position.

        Returns ``self`` when the resulting *name list* equals the current one,
        even if the positions differ (names are compared, not indices).
        """
        indices = list(indices)
        for i in indices:
            if not 0 <= i < self.width:
                raise IndexError(f"feature index {i} out of range 0..{self.width - 1}")
        new_names = tuple(self.feature_names[i] for i in indices)
        if new_names == self.feature_names:
            return self
        if self.packed:
            # one lambda over a literal index array: plan size independent of width
            idx = F.from_json(F.lit(json.dumps(indices)), "array<int>")
            arr = F.transform(idx, lambda i: F.col(PACKED)[i])
            out = self.df.select(F.col(LABEL), arr.alias(PACKED), *[qcol(c) for c in self.carry])
            return FeatureFrame(out, new_names, self.carry, True)
        cols = [F.col(LABEL)] + [F.col(fcol(i)).alias(fcol(j)) for j, i in enumerate(indices)]
        cols += [qcol(c) for c in self.carry]
        return FeatureFrame(self.df.select(*cols), new_names, self.carry)

    def project(self, names: Sequence[str]) -> "FeatureFrame":
        """Keep features by name (a repeated name resolves to its last position)."""
        pos = self.name_positions()
        missing = [n for n in names if n not in pos]
        if missing:
            raise KeyError(f"unknown feature names: {missing}")
        return self.project_by_index([pos[n] for n in names])

    def select_features(self, ignore: str | Iterable[str] = (), max_features: int | None = None) -> "FeatureFrame":
        """Drop ignored names, then keep the first ``max_features``."""
        _, names, positions = split_roles(self.feature_names, None, parse_option_list(ignore), max_features)
        return self.project_by_index(positions)

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> "FeatureFrame":
        """Apply a DataFrame -> DataFrame function that keeps the layout."""
        out = fn(self.df)
        expected = [LABEL, PACKED] if self.packed else [LABEL, *self.feature_cols]
        if [c for c in out.columns if c not in self.carry] != expected:
            raise ValueError(f"transform changed the layout: {out.columns} vs {expected + list(self.carry)}")
        return self.with_df(out)

    # -------------------------------------------------------------- profile
    def without_constant_features(self) -> "FeatureFrame":
        from glmframe.operators.profile import drop_constant_features

        return drop_constant_features(self)

    def assembled(self, out: str = "features") -> DataFrame:
        """``label`` + one ML vector column (only for fitting)."""
        if self.packed:
            from pyspark.ml.functions import array_to_vector

            return self.df.select(LABEL, array_to_vector(F.col(PACKED)).alias(out), *self.carry)
        from pyspark.ml.feature import VectorAssembler

        assembler = VectorAssembler(inputCols=self.feature_cols, outputCol=out, handleInvalid="error")
        return assembler.transform(self.df).select(LABEL, out, *self.carry)

