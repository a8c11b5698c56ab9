"""Prediction tables: long to wide and back, joined targets, and decoders fitted per fold."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wayfield.session import cut_lineage, stored


def column_suffixes(rooms: Sequence[str]) -> dict[str, str]:
    """Column suffix per room. Spark ignores case in column names, so of ``A`` and ``a`` the later becomes ``a2``."""
    seen: dict[str, int] = {}
    out = {}
    for r in rooms:
        seen[r.lower()] = seen.get(r.lower(), 0) + 1
        out[r] = r if seen[r.lower()] == 1 else f"{r}{seen[r.lower()]}"
    return out


def prediction_columns(columns: Sequence[str], suffix: str = "pred") -> list[str]:
    return [f"{c}_{suffix}" for c in columns]


def best_prediction(df: DataFrame, column: str, room: str) -> Column:
    """The room's own prediction column where the table has it, else the shared one."""
    options = [c for c in (f"{column}_pred_{room}", f"{column}_pred") if c in df.columns]
    if not options:
        raise ValueError(f"no prediction column for {column}")
    return F.coalesce(*[F.col(c) for c in options])


def melt_predictions(df: DataFrame, ids: Sequence[str], predictions: Sequence[str]) -> DataFrame:
    """Wide to long over the prediction columns, keeping the id columns that exist."""
    return df.unpivot([c for c in ids if c in df.columns], list(predictions), "pred_col", "value")


def pivot_predictions(
    df: DataFrame, keys: Sequence[str], rooms: Sequence[str], order: str,
    predictions: Sequence[str] = ("x_pred", "y_pred"), predicted_room: str = "predicted_room",
) -> DataFrame:
    """Long to wide: ``<prediction>_<room>`` holds the value of the last row in ``order``.

    The rooms are given, so no extra job looks for them, and the numeric buffers keep the aggregate hash-based with a
    partial step before the shuffle.
    """
    suffix = column_suffixes(rooms)
    picks = [
        F.max_by(F.when(F.col(predicted_room) == r, F.col(p)), F.when(F.col(predicted_room) == r, F.col(order))).alias(f"{p}_{suffix[r]}")
        for r in rooms
        for p in predictions
    ]
    return df.groupBy(*keys).agg(*picks)


def first_targets(df: DataFrame, keys: Sequence[str], targets: Sequence[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.min_by(t, order).alias(t) for t in targets])


def target_pred_join(targets: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    return targets.join(wide, list(keys), "full")


def test_rows(df: DataFrame, set_name: str = "set_name", room: str = "actual_room") -> DataFrame:
    """Test rows only if the table says which rows are test rows; never the room ``All``."""
    out = df.filter(F.col(set_name) == "test") if set_name in df.columns else df
    return out.filter(F.col(room) != "All") if room in out.columns else out


#: Numbers in one piece of a packed matrix, and numbers that a task holds before it hands its sums on.
PIECE, HELD = 4096, 1 << 23


def _design(rows: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """(1, features) of each row; a missing feature is NaN."""
    packed = [*names] == ["_f"]
    return np.column_stack([np.ones(len(rows)), np.stack([np.asarray(f, dtype=float) for f in rows["_f"]]) if packed else rows[[*names]].to_numpy(float)])


def _inputs(features: str | Sequence[str]) -> tuple[list[Column], list[str]]:
    """The features as one array ``_f``, or as columns ``_f0``, ``_f1``…, and these names."""
    if isinstance(features, str):
        return [F.col(features).cast("array<double>").alias("_f")], ["_f"]
    names = [f"_f{i}" for i in range(len(features))]
    return [F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)], names


def _gram_pieces(by: Sequence[str], names: Sequence[str], targets: Sequence[str]):
    """Sums of products of one task's rows by group, packed and cut into pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for key, packed in held.items():
                pieces = [packed[i : i + PIECE] for i in range(0, len(packed), PIECE)]
                table = pd.DataFrame([key] * len(pieces), columns=list(by))
                yield table.assign(_piece=range(len(pieces)), _sums=pieces)
            held.clear()

        for pdf in batches:
            # rows sorted by group once: a group's products are then those of a slice
            code = pdf.groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            x = _design(pdf, names)[order]
            both = np.column_stack([x, pdf[list(targets)].to_numpy(float)[order]])
            whole, d = np.isfinite(x).all(axis=1), x.shape[1]
            upper = np.triu_indices(d)
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            heads = pdf[list(by)].iloc[order[starts]].astype(object).itertuples(index=False, name=None)
            for key, a, b in zip(heads, starts, [*starts[1:], len(pdf)], strict=True):
                rows = both[a:b][whole[a:b]]
                products = rows[:, :d].T @ rows
                packed = np.concatenate([products[:, :d][upper], products[:, d:].ravel()])
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = held[key] + packed if key in held else packed
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    return run


def _added(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pieces of equal ``by`` added up, as a stream: a task holds one sum, however many there are to add."""
    names = [*by, "_sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, done = None, None, []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*[(*k, v) for k, v in done], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

        kinds: list[pa.Field] = []
        for batch in batches:
            kinds = [pa.field(n, batch.schema.field(n).type) for n in by] + [pa.field("_sums", pa.list_(pa.float64()))]
            sums, keys = batch.column("_sums"), list(zip(*(batch.column(n).to_pylist() for n in by), strict=True))
            for i, k in enumerate(keys):
                values = sums[i].values.to_numpy(zero_copy_only=False)
                if k == key:
                    total += values
                    continue
                if key is not None:
                    done.append((key, total))
                key, total = k, values.copy()
                if len(done) >= 64:
                    yield packed()
                    done.clear()
        if key is not None:
            done.append((key, total))
            yield packed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*by).schema) + ", _sums array<double>"
    return pieces.select(*names).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def gram_sums(df: DataFrame, by: Sequence[str], features: str | Sequence[str], targets: Sequence[str]) -> DataFrame:
    """by…, _piece, _sums: the products of (1, features) with (1, features, targets) summed over each group.

    A task adds up matrix products per Arrow batch and hands on one packed matrix per group, cut into pieces. Pieces of
    a group are added in two steps, first by the task's salt, so a group that every task holds meets in many tasks.
    """
    inputs, names = _inputs(features)
    data = df.select(*by, *inputs, *targets).dropna(subset=[*(names if isinstance(features, str) else []), *targets])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*by).schema) + ", _piece int, _sums array<double>"
    pieces = data.mapInPandas(_gram_pieces(by, names, targets), schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    return _added(_added(pieces, [*by, "_piece", "_salt"]), [*by, "_piece"])


def solve_ridge(packed: np.ndarray, d: int, m: int, ridge: float) -> np.ndarray:
    """Weights (d by m) from packed sums, by Cholesky; a matrix that is not positive definite is solved by least squares."""
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = packed[: d * (d + 1) // 2]
    gram = gram + np.triu(gram, 1).T + ridge * np.eye(d)
    rhs = packed[d * (d + 1) // 2 :].reshape(d, m)
    try:
        low = np.linalg.cholesky(gram)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gram, rhs, rcond=None)[0]
    return np.linalg.solve(low.T, np.linalg.solve(low, rhs))


def fold_decoder(
    df: DataFrame, keys: Sequence[str], features: str | Sequence[str], targets: Sequence[str], room: str = "room",
    fold: str = "fold", row: str = "row_id", ridge: float = 1e-3, rows_per_chunk: int = 50_000,
) -> DataFrame:
    """Train and predict: a ridge decoder per (keys, held-out fold, room), applied to the fold's rows of every room.

    Normal equations are sums of products, so a decoder for "all folds but f" is the total minus fold f: one pass over
    the data gives every decoder, however large a room or fold is, for hundreds of features. A decoder's matrix is
    gathered in one task, and is as large as the square of the features. Rows to predict join their fold's decoders, a
    small table that Spark sends to them, and a prediction is a sum over a row's own columns: rows stay where they are,
    and ``rows_per_chunk`` has nothing to bound any more.

    ``features`` names the feature columns, or one array column with all of them, as long in every row.

    Result: keys, fold, row, actual_room, predicted_room, targets, ``<target>_pred``. Rows that miss a feature are not
    learned from and have missing predictions; a room without rows in a fold trains on all its rows.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("give at least one key, such as the session or the offset")
    m = len(targets)
    by_fold = cut_lineage(gram_sums(df, [*keys, room, fold], features, targets))
    total = _added(by_fold, [*keys, room, "_piece"]).withColumnRenamed("_sums", "_total")
    folds = by_fold.select(*keys, fold).distinct()
    grid = total.join(folds, keys).join(by_fold, [*keys, room, fold, "_piece"], "left")
    rest = F.when(F.col("_sums").isNull(), F.col("_total")).otherwise(F.zip_with("_total", "_sums", lambda a, b: a - b))
    train = grid.select(*keys, F.col(room).alias("predicted_room"), fold, "_piece", rest.alias("_sums"))
    which = [*keys, "predicted_room", fold]
    head = train.select(*which).schema.add("_w", ArrayType(DoubleType()))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packed = np.concatenate([np.asarray(v) for v in pdf.sort_values("_piece")["_sums"]])
        # d (d + 1) / 2 + d m numbers
        d = round((math.sqrt((1 + 2 * m) ** 2 + 8 * len(packed)) - 1 - 2 * m) / 2)
        return pd.DataFrame([[*key, solve_ridge(packed, d, m, ridge).ravel()]], columns=[*which, "_w"])

    # a table whose size Spark knows: it is sent to the rows, unless it is too large for that
    decoders = stored(train.groupBy(*which).applyInPandas(solve, head))
    on = [*keys, fold]
    inputs, names = _inputs(features)
    test = df.select(*on, row, F.col(room).alias("actual_room"), *inputs, *targets)

    def predicted(t: int) -> Column:
        def weight(i: Column | int) -> Column:
            return F.get("_w", i * m + t)

        if isinstance(features, str):
            parts = F.transform(names[0], lambda v, i: v * weight(i + 1))
            return F.aggregate(parts, weight(F.lit(0)), lambda acc, v: acc + v)
        return sum((F.col(n) * weight(F.lit(i)) for i, n in enumerate(names, 1)), weight(F.lit(0)))

    def known(c: Column) -> Column:
        return F.when(~F.isnan(c), c)

    truth = [known(F.col(t)).alias(t) if test.schema[t].dataType.typeName() in ("double", "float") else F.col(t) for t in targets]
    made = [known(predicted(i)).alias(f"{t}_pred") for i, t in enumerate(targets)]
    return test.join(decoders, on).select(*on, row, "actual_room", "predicted_room", *truth, *made)
