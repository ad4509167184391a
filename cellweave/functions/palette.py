"""Cluster colours."""

from __future__ import annotations

# The colour lists that cluster figures are drawn with.
SET1 = ["#E41A1C", "#377EB8", "#4DAF4A", "#984EA3", "#FF7F00", "#FFFF33", "#A65628", "#F781BF", "#999999"]
PAIRED = ["#A6CEE3", "#1F78B4", "#B2DF8A", "#33A02C", "#FB9A99", "#E31A1C", "#FDBF6F", "#FF7F00", "#CAB2D6",
          "#6A3D9A", "#FFFF99", "#B15928"]
TWENTY = ["#00FE0A", "#FF0000", "#BDED1B", "#794B05", "#C3BEB7", "#0000FF", "#00FFFF", "#FF21D3", "#81B7DD", "#F87791",
          "#1E7309", "#FC9A07", "#625B51", "#6A09C3", "#189FF5", "#D19D00", "#0EBF06", "#88FFB3", "#F6FC2A", "#000000"]
HEAT = ["#FF0000", "#8B4500", "#262626", "#000000", "#8B8B00", "#FFFF00", "#ADFF2F"]
HEAT_STEPS = 100


def ramp(colors: list[str], n: int) -> list[str]:
    """``n`` colours evenly spaced along a list of hex colours."""
    if n == 1:
        return [colors[0]]
    points = [tuple(int(c[i:i + 2], 16) for i in (1, 3, 5)) for c in colors]
    out = []
    for step in range(n):
        at = step * (len(points) - 1) / (n - 1)
        low = min(int(at), len(points) - 2)
        mixed = (round(a + (b - a) * (at - low)) for a, b in zip(points[low], points[low + 1]))
        out.append("#" + "".join(f"{c:02X}" for c in mixed))
    return out


def heat_colors(n: int = HEAT_STEPS) -> list[str]:
    """Colours of a heatmap's values, from low to high."""
    return ramp(HEAT, n)


def cluster_colors(n: int) -> list[str]:
    if n <= 9:
        return ramp(SET1, n)
    if n <= 12:
        return ramp(PAIRED, n)
    return TWENTY[:n] if n <= 20 else ramp(SET1, n)
