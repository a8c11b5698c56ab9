"""Affine maps between point sets: fitting, applying, decomposing and describing them.

A map is six columns ``a b tx c d ty``: ``x' = a x + b y + tx``, ``y' = c x + d y + ty``. Fitting needs only means and
covariances, so any number of maps is fitted by one aggregate and the fit's R2 and RMSE come from the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.numeric import r2, ratio

MAP = ("a", "b", "tx", "c", "d", "ty")


def moment_aggs(sx: Column, sy: Column, tx: Column, ty: Column, where: Column | None = None) -> list[Column]:
    """Aggregates an affine fit needs, over complete rows that satisfy ``where``."""
    ok = sx.isNotNull() & sy.isNotNull() & tx.isNotNull() & ty.isNotNull()
    if where is not None:
        ok = ok & where
    sx, sy, tx, ty = (F.when(ok, c.cast("double")) for c in (sx, sy, tx, ty))
    named = {"sx": sx, "sy": sy, "tx": tx, "ty": ty}
    out = [F.count(sx).alias("n")]
    out += [F.avg(c).alias(f"_m_{k}") for k, c in named.items()]
    out += [F.var_pop(c).alias(f"_v_{k}") for k, c in named.items()]
    out += [
        F.covar_pop(named[p], named[q]).alias(f"_c_{p}_{q}")
        for p, q in (("sx", "sy"), ("sx", "tx"), ("sy", "tx"), ("sx", "ty"), ("sy", "ty"))
    ]
    return out


def solve_moments(df: DataFrame) -> DataFrame:
    """Replace the moment columns by the fitted map, its sums of squares, pooled ``r2`` and ``rmse``.

    A degenerate source (all points on a line) has no unique map: its columns are NULL.
    """
    vx, vy, cxy = F.col("_v_sx"), F.col("_v_sy"), F.col("_c_sx_sy")
    det = vx * vy - cxy * cxy
    det = F.when(det > 1e-12 * F.greatest(vx * vy, F.lit(1e-300)), det)

    def row(t: str) -> tuple[Column, Column, Column]:
        cx, cy = F.col(f"_c_sx_{t}"), F.col(f"_c_sy_{t}")
        p, q = F.try_divide(cx * vy - cy * cxy, det), F.try_divide(cy * vx - cx * cxy, det)
        return p, q, F.col(f"_m_{t}") - p * F.col("_m_sx") - q * F.col("_m_sy")

    cols = dict(zip(MAP, (*row("tx"), *row("ty"))))
    fitted = df.withColumns(cols)

    def left(p: str, q: str, t: str) -> Column:
        explained = F.col(p) * F.col(f"_c_sx_{t}") + F.col(q) * F.col(f"_c_sy_{t}")
        return F.col("n") * F.greatest(F.col(f"_v_{t}") - explained, F.lit(0.0))

    sse = left("a", "b", "tx") + left("c", "d", "ty")
    sst = F.col("n") * (F.col("_v_tx") + F.col("_v_ty"))
    fitted = fitted.withColumns(
        {
            "r2": F.when(F.col("a").isNotNull(), r2(sse, sst)),
            "rmse": F.sqrt(ratio(sse, "n")),
        }
    )
    return fitted.drop(*[c for c in df.columns if c.startswith("_")])


def fit_affine(
    df: DataFrame, keys: Sequence[str], source: tuple[str, str], target: tuple[str, str]
) -> DataFrame:
    """Least-squares map from source to target points per group."""
    aggs = moment_aggs(F.col(source[0]), F.col(source[1]), F.col(target[0]), F.col(target[1]))
    return solve_moments(df.groupBy(*keys).agg(*aggs))


def apply_affine(df: DataFrame, x: str = "x", y: str = "y", out: tuple[str, str] = ("x_map", "y_map"), inverse: bool = False) -> DataFrame:
    """Apply the row's map (or its inverse) to the row's point. NULL where the inverse does not exist."""
    px, py = F.col(x), F.col(y)
    a, b, tx, c, d, ty = (F.col(m) for m in MAP)
    if not inverse:
        return df.withColumns({out[0]: a * px + b * py + tx, out[1]: c * px + d * py + ty})
    det = a * d - b * c
    qx, qy = px - tx, py - ty
    return df.withColumns(
        {out[0]: F.try_divide(d * qx - b * qy, det), out[1]: F.try_divide(a * qy - c * qx, det)}
    )


def decompose_affine(df: DataFrame) -> DataFrame:
    """Left polar decomposition ``A = S U``: eigenvalues of S, reflection, and U's rotation angle or mirror axis."""
    a, b, c, d = (F.col(m) for m in ("a", "b", "c", "d"))
    turn = F.sqrt((a + d) * (a + d) + (c - b) * (c - b))
    flip = F.sqrt((a - d) * (a - d) + (b + c) * (b + c))
    det = a * d - b * c
    rotation = F.pmod(F.degrees(F.atan2(c - b, a + d)), F.lit(360.0))
    mirror = F.pmod(F.degrees(F.atan2(b + c, a - d)) / 2, F.lit(180.0))
    return df.withColumns(
        {
            "reflection": det < 0,
            "angle_deg": F.when(det < 0, mirror).otherwise(rotation),
            "max_eigenvalue": (turn + flip) / 2,
            "min_eigenvalue": F.abs(turn - flip) / 2,
        }
    )


def fixed_set(df: DataFrame, tolerance: float = 1e-6, rank_tolerance: float = 1e-12) -> DataFrame:
    """Classify the fixed points of each map: ``unique``, ``line``, ``none``, ``all`` or ``translation``.

    With M = I - A the fixed points solve M x = b. Adds rank, condition, residual, the point (the minimum-norm one of
    a line) and the direction of a line.
    """
    m11, m12, m21, m22 = 1 - F.col("a"), -F.col("b"), -F.col("c"), 1 - F.col("d")
    b1, b2 = F.col("tx"), F.col("ty")
    turn = F.sqrt((m11 + m22) * (m11 + m22) + (m21 - m12) * (m21 - m12))
    flip = F.sqrt((m11 - m22) * (m11 - m22) + (m12 + m21) * (m12 + m21))
    s1, det = (turn + flip) / 2, m11 * m22 - m12 * m21
    # |det| = s1 * s2; dividing is far more exact than (turn - flip) / 2 near rank 1
    out = df.withColumns({"_s1": s1, "_det": det})
    out = out.withColumn("_s2", F.coalesce(F.try_divide(F.abs("_det"), "_s1"), F.lit(0.0)))
    rank = F.when(F.col("_s1").isNull(), F.lit(None)).when(F.col("_s1") <= 0, 0).when(F.col("_s2") > rank_tolerance * F.col("_s1"), 2).otherwise(1)
    out = out.withColumn("rank", rank.cast("int"))
    sq = F.when(F.col("_s1") > 0, F.col("_s1") * F.col("_s1"))
    unique_x = F.try_divide(m22 * b1 - m12 * b2, F.col("_det"))
    unique_y = F.try_divide(m11 * b2 - m21 * b1, F.col("_det"))
    # rank 1: pseudo-inverse is M^T / s1^2
    line_x, line_y = F.try_divide(m11 * b1 + m21 * b2, sq), F.try_divide(m12 * b1 + m22 * b2, sq)
    out = out.withColumns(
        {
            "_px": F.when(F.col("rank") == 2, unique_x).when(F.col("rank") == 1, line_x),
            "_py": F.when(F.col("rank") == 2, unique_y).when(F.col("rank") == 1, line_y),
        }
    )
    rx, ry = m11 * F.col("_px") + m12 * F.col("_py") - b1, m21 * F.col("_px") + m22 * F.col("_py") - b2
    shift = F.sqrt(b1 * b1 + b2 * b2)
    out = out.withColumn(
        "residual",
        F.when(F.col("rank") == 0, F.when(shift < tolerance, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(
            F.sqrt(rx * rx + ry * ry)
        ),
    )
    case = (
        F.when(F.col("rank") == 2, "unique")
        .when((F.col("rank") == 1) & (F.col("residual") < tolerance), "line")
        .when(F.col("rank") == 1, "none")
        .when(F.col("residual") == 0, "all")
        .when(F.col("rank") == 0, "translation")
    )
    out = out.withColumns(
        {
            "fixed_case": case,
            "condition": F.when(F.col("_s2") > 0, F.col("_s1") / F.col("_s2")).when(F.col("rank").isNotNull(), F.lit(float("inf"))),
        }
    )
    has_point = F.col("fixed_case").isin("unique", "line")
    # null direction of a rank-1 M is orthogonal to its larger row
    first = m11 * m11 + m12 * m12 >= m21 * m21 + m22 * m22
    ux, uy = F.when(first, -m12).otherwise(-m22), F.when(first, m11).otherwise(m21)
    norm = F.sqrt(ux * ux + uy * uy)
    on_line = F.col("fixed_case") == "line"
    out = out.withColumns(
        {
            "fixed_x": F.when(has_point, F.col("_px")),
            "fixed_y": F.when(has_point, F.col("_py")),
            "dir_x": F.when(on_line, F.try_divide(ux, norm)),
            "dir_y": F.when(on_line, F.try_divide(uy, norm)),
            "is_valid": F.col("fixed_case").isin("line", "all")
            | ((F.col("fixed_case") == "unique") & (F.col("residual") < tolerance) & (F.col("condition") < 1e10)),
        }
    )
    return out.drop("_s1", "_s2", "_det", "_px", "_py")


def is_identity(tol_linear: float = 0.1, tol_shift: float = 0.1) -> Column:
    a, b, tx, c, d, ty = (F.col(m) for m in MAP)
    linear = F.sqrt((a - 1) * (a - 1) + b * b + c * c + (d - 1) * (d - 1))
    return (linear < tol_linear) & (F.sqrt(tx * tx + ty * ty) < tol_shift)


# The sentence that goes with each outcome.
MESSAGES = {
    "identity": "No remapping beyond noise.",
    "all": "No remapping.",
    "unique": "Remapping pivots around a stationary point.",
    "reflection_axis": "Mirror remapping: axis is fixed pointwise.",
    "stationary_line": "Stationary line exists, but not a mirror flip.",
    "none": "No simple invariant structure detected.",
}


def affine_report(df: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Identity check, fixed set, mirror-axis label, area scale, anisotropy, translation size and a sentence."""
    out = fixed_set(decompose_affine(df), tolerance).withColumn("is_identity", is_identity())
    axis = F.radians("angle_deg")
    along = F.abs(F.col("dir_x") * F.cos(axis) + F.col("dir_y") * F.sin(axis))
    kind = F.when((F.col("fixed_case") == "line") & F.col("reflection") & (along > 0.99), "reflection_axis").when(
        F.col("fixed_case") == "line", "stationary_line"
    )
    out = out.withColumns(
        {
            "fixed_case": F.when(F.col("is_identity"), "all").otherwise(F.col("fixed_case")),
            "line_type": F.when(~F.col("is_identity"), kind),
            "area_scale": F.col("max_eigenvalue") * F.col("min_eigenvalue"),
            "anisotropy": ratio("max_eigenvalue", "min_eigenvalue"),
            "translation": F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty")),
        }
    )
    label = (
        F.when(F.col("is_identity"), "identity")
        .when(F.col("line_type").isNotNull(), F.col("line_type"))
        .when(F.col("fixed_case").isin("all", "unique"), F.col("fixed_case"))
        .otherwise("none")
    )
    message = F.create_map(*[F.lit(v) for kv in MESSAGES.items() for v in kv])
    return out.withColumn("message", F.element_at(message, label))


def rotate_points(df: DataFrame, degrees: float, reflect: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Rotate counter-clockwise about the origin after an optional flip of x."""
    r = F.radians(F.lit(float(degrees)))
    px = -F.col(x) if reflect else F.col(x)
    py = F.col(y)
    return df.withColumns({"x_rot": F.cos(r) * px - F.sin(r) * py, "y_rot": F.sin(r) * px + F.cos(r) * py})


def to_physical(df: DataFrame, source_centroid: tuple[Column, Column], target_centroid: tuple[Column, Column]) -> DataFrame:
    """Turn a map between centred frames into one between physical frames: ``t' = c_t + t - A c_s``."""
    (sx, sy), (cx, cy) = source_centroid, target_centroid
    a, b, tx, c, d, ty = (F.col(m) for m in MAP)
    return df.withColumns({"tx": cx + tx - (a * sx + b * sy), "ty": cy + ty - (c * sx + d * sy)})


def median_residual(points: DataFrame, maps: DataFrame, keys: Sequence[str], source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """Median distance between mapped source and target points per group."""
    from wayfield.plans.ordered import quantiles

    joined = apply_affine(points.join(maps.select(*keys, *MAP), list(keys)), *source)
    dx, dy = F.col("x_map") - F.col(target[0]), F.col("y_map") - F.col(target[1])
    return quantiles(joined.select(*keys, F.sqrt(dx * dx + dy * dy).alias("_r")), keys, {"residual_median": ("_r", 0.5)})
