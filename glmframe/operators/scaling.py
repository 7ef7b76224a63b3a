"""Scaling as part of a model: a fitted affine transform of the features.

``Scaler.fit`` takes the moments of a training frame (one aggregate job, one
row per feature reaches the driver). ``apply`` scales any frame by them, also
one that the scaler never saw. ``fold`` turns a model of scaled features into
one of raw features, so that scoring needs no scaling at all: with
``z = (x - mean) / deviation``, ``w * z`` is ``(w / deviation) * x`` and a
constant, which goes into the intercept. The moments stay with the folded
model, and ``unfold`` gives back the weights per deviation, whose sizes can be
compared.

A feature without a deviation (constant, or fewer than two values) is scaled
to 0.0 and folds to the weight 0.0. A NULL cell stays NULL everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from glmframe.frame import LABEL, PACKED, FeatureFrame, qcol
from glmframe.functions.numeric import double_array
from glmframe.operators.profile import column_moments
from glmframe.sources.model_store import LinearModel, Scaling


@dataclass(frozen=True)
class Scaler:
    """Per feature, in order: what is subtracted, and what it is divided by then (0.0: becomes 0.0)."""

    names: tuple[str, ...]
    shifts: tuple[float, ...]
    divisors: tuple[float, ...]

    # ------------------------------------------------------------------ build
    @classmethod
    def fit(cls, frame: FeatureFrame, center: bool = True, scale: bool = True) -> Scaler:
        """Means and sample deviations of a frame's features."""
        moments = column_moments(frame)
        return cls(
            frame.feature_names,
            tuple(float(m) if center and m is not None else 0.0 for m, _ in moments),
            tuple(float(d or 0.0) if scale else 1.0 for _, d in moments),
        )

    @classmethod
    def of(cls, model: LinearModel) -> Scaler | None:
        """The scaler that a model was folded with."""
        if model.scaling is None:
            return None
        return cls(model.names, tuple(s.shift for s in model.scaling), tuple(s.divisor for s in model.scaling))

    # -------------------------------------------------------------------- use
    def _check(self, names: Sequence[str], what: str) -> None:
        if tuple(names) != self.names:
            raise ValueError(f"the scaler's features {list(self.names)} aren't those of the {what}: {list(names)}")

    def apply(self, frame: FeatureFrame) -> FeatureFrame:
        """Every feature scaled; the frame must have the scaler's features in their order.

        A lazy projection with literals, no job.
        """
        self._check(frame.feature_names, "frame")
        carried = [qcol(c) for c in frame.carry]
        if frame.packed:
            moved = F.zip_with(F.col(PACKED), double_array(self.shifts), lambda x, m: x - m)
            out = F.zip_with(
                moved,
                double_array(self.divisors),
                lambda x, d: F.when(x.isNotNull(), F.when(d == 0.0, F.lit(0.0)).otherwise(x / d)),
            )
            return frame.with_df(frame.df.select(F.col(LABEL), out.alias(PACKED), *carried))
        cols = []
        for c, shift, divisor in zip(frame.feature_cols, self.shifts, self.divisors, strict=True):
            x = F.col(c)
            if divisor == 0.0:
                cols.append(F.when(x.isNotNull(), F.lit(0.0)).alias(c))
                continue
            x = x - F.lit(shift) if shift else x
            cols.append((x / F.lit(divisor) if divisor != 1.0 else x).alias(c))
        return frame.with_df(frame.df.select(F.col(LABEL), *cols, *carried))

    def fold(self, model: LinearModel) -> LinearModel:
        """The same predictions from raw features; the moments are kept in ``model.scaling``."""
        self._check(model.names, "model")
        pairs = list(zip(model.weights, self.shifts, self.divisors, strict=True))
        return replace(
            model,
            weights=tuple(w / d if d else 0.0 for w, _, d in pairs),
            intercept=model.intercept - math.fsum(w * s / d for w, s, d in pairs if d),
            scaling=tuple(Scaling(s, d) for _, s, d in pairs),
        )

    @staticmethod
    def unfold(model: LinearModel) -> LinearModel:
        """The model of scaled features that was folded (weights of features without a deviation are 0.0)."""
        scaler = Scaler.of(model)
        if scaler is None:
            raise ValueError("the model was not folded with a scaler")
        pairs = list(zip(model.weights, scaler.shifts, scaler.divisors, strict=True))
        return replace(
            model,
            weights=tuple(w * d for w, _, d in pairs),
            intercept=model.intercept + math.fsum(w * s for w, s, _ in pairs),
            scaling=None,
        )


def standardize(frame: FeatureFrame, center: bool = True, scale: bool = True) -> FeatureFrame:
    """A frame scaled by its own moments; keep a :class:`Scaler` to scale other data alike."""
    return Scaler.fit(frame, center, scale).apply(frame)
