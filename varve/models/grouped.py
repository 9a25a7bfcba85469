"""Many iterative fits that share their passes: each step of all of them is one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(rows: DataFrame, keys, fits: dict, parts: dict, read: Callable, what: str, most_passes=500, must=True) -> dict:
    """{(key, name): fit} once every fit is `done`.

    `fits[key, name]` has `done`, `sums(x, t)` for some rows and `advance(sums)` for all of them. `parts[key, name]` names the rows
    of the key's group that the fit sees; `read(pdf, parts)` yields (part, x, t) for rows of one group. Rows are never copied for a
    fit, and only the sums reach the driver. Fits that have not ended after `most_passes` raise an error if they
    `must`. `rows` is read once per step: stage it.
    When all fits that are left are `close`, a pass takes the few rows that `split` names to one task per fit, where `finish` works on them.
    """
    keys = list(keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["fit string, i int, value double"])

    def reader(current):
        by_key: dict = {}
        for (key, name), fit in current.items():
            by_key.setdefault(key, {}).setdefault(parts[key, name], []).append((name, fit))

        def fits_and_rows(batches):
            for pdf in batches:
                for key, mine in pdf.groupby(keys, sort=False):
                    key = key if isinstance(key, tuple) else (key,)
                    wanted = by_key.get(key, {})
                    for part, x, t in read(mine, list(wanted)) if wanted else ():
                        for name, fit in wanted[part] if len(t) else ():
                            yield key, name, fit, x, t

        return fits_and_rows

    def one_pass(current):
        fits_and_rows = reader(current)

        def partial(batches):
            sums: dict = {}
            for key, name, fit, x, t in fits_and_rows(batches):
                sums[key, name] = sums.get((key, name), 0.0) + fit.sums(x, t)
            for (key, name), block in sums.items():
                frame = pd.DataFrame({"fit": name, "i": np.arange(len(block), dtype="int32"), "value": block})
                for column, value in zip(keys, key):
                    frame[column] = value
                yield frame[[*keys, "fit", "i", "value"]]

        return rows.mapInPandas(partial, schema).groupBy(*keys, "fit", "i").agg(F.sum("value").alias("value")).toPandas()

    def last_rows(current):
        fits_and_rows = reader(current)

        def partial(batches):
            found: dict = {}
            for key, name, fit, x, t in fits_and_rows(batches):
                lines, top, near = fit.split(x, t)
                mine = found.setdefault((key, name), [0.0, 0.0, 0, []])
                mine[0], mine[1], mine[2] = mine[0] + lines, np.maximum(mine[1], top), mine[2] + len(near)
                # Too many near rows end the attempt, so none need be held.
                mine[3] = [*mine[3], near] if mine[2] <= 2 * fit.most_near else []
            for (key, name), (lines, top, n, near) in found.items():
                held = np.concatenate(near).ravel() if near else np.zeros(0)
                yield pd.DataFrame([[*key, name, n, lines, top, held]], columns=[*keys, "fit", "n", "lines", "top", "near"])

        def finish(pdf):
            key, name = tuple(pdf[k].iloc[0] for k in keys), pdf["fit"].iloc[0]
            fit, b, reached = current[key, name], None, float("inf")
            if pdf["n"].sum() <= 2 * fit.most_near:
                near = np.concatenate(list(pdf["near"])).reshape(int(pdf["n"].sum()), -1 if pdf["n"].sum() else len(fit.b) + 1)
                b, reached = fit.finish(np.sum(list(pdf["lines"]), axis=0), np.max(list(pdf["top"]), axis=0), near, most_passes)
            return pd.DataFrame([[*key, name, b, reached]], columns=[*keys, "fit", "b", "reached"])

        named = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["fit string"])
        few = rows.mapInPandas(partial, f"{named}, n long, lines array<double>, top array<double>, near array<double>")
        return few.groupBy(*keys, "fit").applyInPandas(finish, f"{named}, b array<double>, reached double").toPandas()

    for _ in range(most_passes):
        current = {k: f for k, f in fits.items() if not f.done}
        if not current:
            break
        if all(f.close for f in current.values()):
            for *key, name, b, reached in last_rows(current)[[*keys, "fit", "b", "reached"]].itertuples(index=False, name=None):
                fits[tuple(key), name].move(None if b is None else np.array(b), reached)
            continue
        current = {k: f for k, f in current.items() if not f.close}
        for (*key, name), block in one_pass(current).groupby([*keys, "fit"], sort=False):
            fits[tuple(key), name].advance(block.sort_values("i")["value"].to_numpy())
    late = [k for k, f in fits.items() if not f.done]
    if late and must:
        raise RuntimeError(f"{what} did not settle after {most_passes} passes: {late}")
    return fits
