"""Unions of areas in one piece, to hold the distributed ones against."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def _pieces(edges: np.ndarray, digits: int) -> np.ndarray:
    """Edges (x1, y1, x2, y2) cut where others meet or overlap them, without repeats; each from its smaller end."""
    a, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    out = []
    for i in range(len(edges)):
        near = np.flatnonzero((low <= high[i]).all(1) & (high >= low[i]).all(1))
        cross = d[i, 0] * d[near, 1] - d[i, 1] * d[near, 0]
        gap = a[near] - a[i]
        skew = near[cross != 0]
        t = (gap[cross != 0, 0] * d[skew, 1] - gap[cross != 0, 1] * d[skew, 0]) / cross[cross != 0]
        u = (gap[cross != 0, 0] * d[i, 1] - gap[cross != 0, 1] * d[i, 0]) / cross[cross != 0]
        at = t[(u > -1e-9) & (u < 1 + 1e-9)]
        along = near[(cross == 0) & (np.abs(gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) <= 1e-9 * np.hypot(*d[i]))]
        square = d[i] @ d[i]
        ends = np.concatenate([(edges[along, :2] - a[i]) @ d[i], (edges[along, 2:] - a[i]) @ d[i]]) / square
        at = np.unique(np.concatenate([[0.0, 1.0], at[(at > 0) & (at < 1)], ends[(ends > 0) & (ends < 1)]]))
        out.append(np.round(a[i] + at[:, None] * d[i], digits))
    parts = np.concatenate([np.column_stack([p[:-1], p[1:]]) for p in out])
    swap = (parts[:, 0] > parts[:, 2]) | (parts[:, 0] == parts[:, 2]) & (parts[:, 1] > parts[:, 3])
    parts[swap] = parts[swap][:, [2, 3, 0, 1]]
    parts = np.unique(parts, axis=0)
    return parts[(parts[:, :2] != parts[:, 2:]).any(1)]


def _inside(points: np.ndarray, areas: list[list[np.ndarray]]) -> np.ndarray:
    """Whether a point lies in any area; an area is a list of rings, and what an odd number of them holds is inside.

    Each area looks at the points between its bounds that no area before it holds.
    """
    order = np.argsort(points[:, 0], kind="stable")
    x, y = points[order, 0], points[order, 1]
    out = np.zeros(len(points), bool)
    for rings in areas:
        corners = np.concatenate(rings) if rings else np.zeros((0, 2))
        if not len(corners):
            continue
        (x_low, y_low), (x_high, y_high) = corners.min(0), corners.max(0)
        near = np.arange(np.searchsorted(x, x_low), np.searchsorted(x, x_high, "right"))
        near = near[(y[near] >= y_low) & (y[near] <= y_high) & ~out[near]]
        for a in range(0, len(near), 4096):
            at = near[a : a + 4096]
            odd = np.zeros(len(at), bool)
            for r in rings:
                x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
                over = (y1 > y[at, None]) != (y2 > y[at, None])
                with np.errstate(divide="ignore", invalid="ignore"):
                    left = x[at, None] < (x2 - x1) * (y[at, None] - y1) / (y2 - y1) + x1
                odd ^= (over & left).sum(1) % 2 == 1
            out[at[odd]] = True
    back = np.empty(len(points), bool)
    back[order] = out
    return back


def union(areas: list[list[np.ndarray]], digits: int = 6, step: float = 1e-5) -> list[np.ndarray]:
    """Closed rings of the union, outer ones counter-clockwise, holes clockwise; without corners on straight lines.

    All edges are cut at their meeting points; a piece belongs to the outline if one of its sides is covered
    and the other is not. Pieces run with the covered side on their left and are joined end to end.
    """
    rings = [r for rings in areas for r in rings if len(r) > 3]
    if not rings:
        return []
    parts = _pieces(np.concatenate([np.column_stack([r[:-1], r[1:]]) for r in rings]), digits)
    middle, way = (parts[:, :2] + parts[:, 2:]) / 2, parts[:, 2:] - parts[:, :2]
    normal = np.column_stack([-way[:, 1], way[:, 0]]) / np.hypot(way[:, 0], way[:, 1])[:, None] * step
    left, right = _inside(middle + normal, areas), _inside(middle - normal, areas)
    outline = np.concatenate([parts[left & ~right], parts[right & ~left][:, [2, 3, 0, 1]]])
    after = defaultdict(list)
    for x1, y1, x2, y2 in outline.tolist():
        after[(x1, y1)].append((x2, y2))
    out = []
    for start in sorted(after):
        while after[start]:
            ring, before = [start], None
            while True:
                here = ring[-1]
                options = after[here]
                if before is None or len(options) == 1:
                    chosen = options[0]
                else:  # at a corner that several parts share, the sharpest turn to the left keeps them apart
                    back = np.arctan2(before[1] - here[1], before[0] - here[0])
                    chosen = min(options, key=lambda p: (back - np.arctan2(p[1] - here[1], p[0] - here[0])) % (2 * np.pi) or 2 * np.pi)
                options.remove(chosen)
                before = here
                ring.append(chosen)
                if chosen == start:
                    break
            out.append(_straight(np.array(ring)))
    return out


def _straight(ring: np.ndarray) -> np.ndarray:
    """A closed ring without corners on straight lines."""
    p = ring[:-1]
    before, after = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-9 * np.hypot(*before.T) * np.hypot(*after.T)
    p = p[bend] if bend.sum() > 2 else p
    return np.concatenate([p, p[:1]])


def signed_area(ring: np.ndarray) -> float:
    return float((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum() / 2)
