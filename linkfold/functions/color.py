"""Colour difference as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cie_lab(l8: Column, a8: Column, b8: Column) -> tuple[Column, Column, Column]:
    """Bytes of a Lab image as CIE values."""
    return l8 * 100 / 255, a8 - 128, b8 - 128


def with_ciede2000(rows: DataFrame, name: str = "delta") -> DataFrame:
    """``rows`` with the CIEDE2000 difference of the CIE Lab colours (l1, a1, b1) and (l2, a2, b2), all three factors 1.

    Every intermediate value is a column, so it is computed once; a null component gives a null.
    """
    seventh = lambda x: F.sqrt(F.pow(x, F.lit(7.0)) / (F.pow(x, F.lit(7.0)) + F.lit(25.0**7)))
    hue = lambda b, p: F.when((b == 0) & (p == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, p)), F.lit(360.0)))
    cos = lambda k, shift: F.cos(F.radians(k * c("hm") + shift))
    c = lambda n: F.col(f"_{n}")
    l1, a1, b1, l2, a2, b2 = (F.col(n) for n in ("l1", "a1", "b1", "l2", "a2", "b2"))
    steps = [
        {"c": (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2},
        {"g": (1 - seventh(c("c"))) / 2},
        {"p1": a1 * (1 + c("g")), "p2": a2 * (1 + c("g"))},
        {"c1": F.sqrt(c("p1") * c("p1") + b1 * b1), "c2": F.sqrt(c("p2") * c("p2") + b2 * b2), "h1": hue(b1, c("p1")), "h2": hue(b2, c("p2"))},
        {"turn": c("h2") - c("h1"), "total": c("h1") + c("h2"), "grey": c("c1") * c("c2") == 0, "cm": (c("c1") + c("c2")) / 2, "lm": F.pow((l1 + l2) / 2 - 50, F.lit(2.0))},
        {
            "dh": F.when(c("grey"), 0.0).when(c("turn") > 180, c("turn") - 360).when(c("turn") < -180, c("turn") + 360).otherwise(c("turn")),
            "hm": F.when(c("grey"), c("total")).when(F.abs(c("turn")) <= 180, c("total") / 2).when(c("total") < 360, (c("total") + 360) / 2).otherwise((c("total") - 360) / 2),
        },
        {"t": 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)},
        {
            "x": (l2 - l1) / (1 + 0.015 * c("lm") / F.sqrt(20 + c("lm"))),
            "y": (c("c2") - c("c1")) / (1 + 0.045 * c("cm")),
            "z": 2 * F.sqrt(c("c1") * c("c2")) * F.sin(F.radians(c("dh") / 2)) / (1 + 0.015 * c("cm") * c("t")),
            "r": -2 * seventh(c("cm")) * F.sin(F.radians(60 * F.exp(-F.pow((c("hm") - 275) / 25, F.lit(2.0))))),
        },
    ]
    for step in steps:
        rows = rows.withColumns({f"_{k}": v for k, v in step.items()})
    delta = F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z") + c("r") * c("y") * c("z"))
    return rows.withColumn(name, delta).drop(*[f"_{k}" for step in steps for k in step])
