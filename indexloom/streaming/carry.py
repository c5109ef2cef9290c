"""The carry-over of a basis as a stream: each arriving date's distances choose with the basis before.

``applyInPandasWithState`` keeps the last basis of every portfolio; dates of one micro-batch are
taken in order.  A date that is not later than the last one taken is late and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from indexloom.functions.stats import square
from indexloom.operators.selection import scaled, spread_order, tree_distances


def carried_basis(stream: DataFrame, k: int, alpha: float = 0.5, stickiness: float = 0.2) -> DataFrame:
    """``stream``: portfolio, dt (string, ISO), u, v, dist.  Returns portfolio, dt, pos, asset."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def choose(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, prev = (state.get if state.exists else ("", ""))
        out, names_before = [], [x for x in prev.split(";") if x]
        for dt, day in sorted(pd.concat(list(batches)).groupby("dt")):
            if dt <= last:
                continue
            names, m = square(day, "u", "v", "dist")
            picks = spread_order(tree_distances(m), scaled(None, names), k, alpha, stickiness, [names.index(x) for x in names_before if x in names])
            names_before, last = [names[i] for i, _ in picks], dt
            out += [(key[0], dt, p, x) for p, x in enumerate(names_before)]
        state.update((last, ";".join(names_before)))
        yield pd.DataFrame(out, columns=["portfolio", "dt", "pos", "asset"])

    return stream.groupBy("portfolio").applyInPandasWithState(choose, "portfolio string, dt string, pos int, asset string", "last string, basis string", "append", GroupStateTimeout.NoTimeout)
