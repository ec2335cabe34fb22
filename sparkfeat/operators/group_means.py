"""Group means written back to the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkfeat.operators.lookups import is_small, lookup
from sparkfeat.operators.profile import grouped_means
from sparkfeat.sources.staging import stage


def with_group_mean(df: DataFrame, cats: Sequence[str], value: str) -> DataFrame:
    """Add ``{cat}_mean``: the mean ``value`` of the row's category; NULL category, NULL mean.

    A window by category would send a whole category to one task. Here the means of all
    categories come from one aggregation pass and are looked up map-side.
    """
    means = stage(grouped_means(df, cats, [value]))
    small = is_small(means)
    result = df
    for cat in cats:
        result = lookup(result, means, cat, {f"mean_{value}": f"{cat}_mean"},
                        mapping_key=f"level_{cat}", small=small)
    return result


def mean_encode(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                mix_cols: Sequence[str]) -> list[DataFrame]:
    """Add ``{col}_{mix}``, the training mean of each ``mix`` per level of each ``col``.

    Fitted on ``train`` only, added to ``train`` and every frame of ``others``; a level that
    training never saw gives NULL. One pass fits all columns and mixes.
    """
    means = stage(grouped_means(train, cols, mix_cols))
    small = is_small(means)
    encoded = []
    for frame in [train, *others]:
        result = frame
        for col in cols:
            names = {f"mean_{mix}": f"{col}_{mix}" for mix in mix_cols}
            result = lookup(result, means, col, names, mapping_key=f"level_{col}", small=small)
        encoded.append(result)
    return encoded
