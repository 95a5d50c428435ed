"""Map classes as ``CASE`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six choropleth labels of the population-trend map, and the
# five legend classes of the election map (edges 0, 12.5, 25, 50, 75, 100).
CHOROPLETH_LABELS = ["0%", "Less than 3%", "3% to 5%", "5% to 10%", "10% to 15%", "More than 15%"]
LEGEND_CLASSES = ["0-12.5", "12.5-25", "25-50", "50-75", "75-100"]
LEGEND_EDGES = [0.0, 12.5, 25.0, 50.0, 75.0, 100.0]


def choropleth_bin(pct) -> Column:
    """Class of a percent already rounded to 2 digits; negative or null -> null."""
    p = F.col(pct) if isinstance(pct, str) else pct
    z, lt3, b35, b510, b1015, gt15 = CHOROPLETH_LABELS
    return (F.when(p == 0, z)
            .when((p > 0) & (p < 3), lt3)
            .when((p >= 3) & (p < 5), b35)
            .when((p >= 5) & (p < 10), b510)
            .when((p >= 10) & (p < 15), b1015)
            .when(p >= 15, gt15))


def legend_class(pct) -> Column:
    """Lower edge inclusive, last class closed at 100; outside [0, 100] -> null."""
    p = F.col(pct) if isinstance(pct, str) else pct
    expr = None
    for i, label in enumerate(LEGEND_CLASSES):
        lo, hi = LEGEND_EDGES[i], LEGEND_EDGES[i + 1]
        cond = (p >= lo) & ((p <= hi) if i == len(LEGEND_CLASSES) - 1 else (p < hi))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr
