"""Plot specifications that can be written as JSON; the data frames beside them hold the points."""

from __future__ import annotations


def ramp(colours: list[str], steps: int = 100) -> list[str]:
    """Colours between the given ones (``#rrggbb``), evenly spaced."""
    stops = [[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in colours]
    out = []
    for s in range(steps):
        at = s * (len(stops) - 1) / max(1, steps - 1)
        i = min(int(at), len(stops) - 2)
        out.append("#" + "".join(f"{round(a + (b - a) * (at - i)):02x}" for a, b in zip(stops[i], stops[i + 1])))
    return out


def breaks(largest: float, n: int = 101) -> list[float]:
    """Symmetric breaks around zero; a flat table gets breaks of -1 to 1."""
    largest = abs(largest) or 1.0
    return [-largest + 2 * largest * i / (n - 1) for i in range(n)]


def volcano(fold_threshold: float = 1.5, pval_threshold: float = 0.05, columns: int = 3) -> dict:
    from math import log2, log10

    return {"kind": "points", "x": "log2_fold", "y": "neg_log10_pval", "colour": "significance", "label": "label", "facet": "cell_type", "columns": columns, "scales": "free", "colours": {"Enriched": "#ff0000", "Depleted": "#0000ff", "Not Significant": "#bebebe"}, "lines": {"y": -log10(pval_threshold), "x": [-log2(fold_threshold), log2(fold_threshold)]}}


def dots(low: str = "#d3d3d3", high: str = "#0000ff", dot_scale: float = 6) -> dict:
    return {"kind": "dots", "x": "grp", "y": "program", "size": "pct_nonzero", "colour": "sum_weight", "colours": [low, high], "sizes": [0, dot_scale]}


def heatmap(rows: int, largest: float, colours: tuple[str, ...] = ("#1e90ff", "#ffffff", "#ff0000"), small_above: int = 20, small: int = 8, star_size: int = 14, font: int = 10) -> dict:
    return {"kind": "tiles", "colours": ramp(list(colours)), "breaks": breaks(largest), "font": small if rows > small_above else font, "stars": star_size}


def scatter(scale: str = "viridis", point_size: float = 0.8, alpha: float = 1.0, labels: tuple[str, str] = ("x", "y"), colour: str = "program_usage", legend: str = "Weights") -> dict:
    known = ("viridis", "plasma", "inferno", "magma")
    scale = "categories" if colour == "grp" else scale if scale in known else "viridis"
    return {"kind": "points", "x": "x", "y": "y", "labels": list(labels), "colour": colour, "legend": legend, "scale": scale, "size": point_size, "alpha": alpha}


def lines(x: str, y: str, facet: str | None = None, mark: float | None = None) -> dict:
    """A line through points; ``mark`` is a place on the x axis that stands out."""
    return {"kind": "lines", "x": x, "y": y, "facet": facet, "mark": mark}
