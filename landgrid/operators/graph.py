"""Pixel graphs, degrees, regions and chains (D-9, D-10, E2-E9)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.operators.components import components
from landgrid.shared import materialise

EIGHT = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
HALF_EIGHT = [(0, 1), (1, -1), (1, 0), (1, 1)]
HALF_FOUR = [(0, 1), (1, 0)]
SHIFT = 1 << 31


def node_id(r: Column, c: Column) -> Column:
    """Row-major order as one long, so the smallest id of a region is its first pixel in reading order."""
    return r.cast("long") * SHIFT + c.cast("long")


def neighbours(px: DataFrame, offsets: list[tuple[int, int]], on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of pixels that are ``offsets`` apart and equal in ``on``: an equi-join on exploded offsets."""
    offs = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    a = px.select(F.col("r").alias("src_r"), F.col("c").alias("src_c"), *on, F.explode(offs).alias("o"))
    a = a.select("src_r", "src_c", *on, (F.col("src_r") + F.col("o.dr")).alias("dst_r"), (F.col("src_c") + F.col("o.dc")).alias("dst_c"))
    b = px.select(F.col("r").alias("dst_r"), F.col("c").alias("dst_c"), *on)
    return a.join(b, ["dst_r", "dst_c", *on])


def edges(px: DataFrame, resolution: float) -> DataFrame:
    """Undirected 8-neighbour edges, once each, with their length."""
    e = neighbours(px, HALF_EIGHT)
    dr, dc = F.col("dst_r") - F.col("src_r"), F.col("dst_c") - F.col("src_c")
    return e.select("src_r", "src_c", "dst_r", "dst_c", (F.sqrt((dr * dr + dc * dc).cast("double")) * resolution).alias("weight"))


def degrees(edge: DataFrame) -> DataFrame:
    """Number of edges at each node."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("src_r").alias("r"), F.col("src_c").alias("c")), F.struct(F.col("dst_r").alias("r"), F.col("dst_c").alias("c")))).alias("n"))
    return ends.groupBy("n.r", "n.c").agg(F.count("*").alias("degree"))


BLOCK = 256


def block_labels(r: np.ndarray, c: np.ndarray, value: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Of pixels of one block, in reading order: the position of the first pixel of each one's region inside the block."""
    n = len(r)
    grid = np.full((BLOCK + 2, BLOCK + 2), -1)
    y, x = r % BLOCK + 1, c % BLOCK + 1
    grid[y, x] = np.arange(n)
    ends = []
    for dr, dc in offsets:
        q = grid[y + dr, x + dc]
        i = np.flatnonzero(q >= 0)
        i = i[value[q[i]] == value[i]]
        ends.append((i, q[i]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def regions(px: DataFrame, four: bool = True, on: tuple[str, ...] = ()) -> DataFrame:
    """D-9, D-10: distinct (r, c, on...) pixels -> with ``zone``, the id of the region's first pixel; lone pixels are regions.

    Blocks of pixels are labelled apart; only labels that meet at a seam between blocks go through the contraction.
    """
    import pandas as pd

    offsets = HALF_FOUR if four else HALF_EIGHT
    shape = ", ".join(f"{k} {t}" for k, t in px.select("r", "c", *on).dtypes)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True)
        r, c = pdf.r.to_numpy(np.int64), pdf.c.to_numpy(np.int64)
        value = pdf[on[0]].to_numpy() if on else np.zeros(len(r))
        first = block_labels(r, c, value, offsets)
        return pdf.assign(local=r[first] * SHIFT + c[first])[["r", "c", *on, "local"]]

    blocks = px.select("r", "c", *on).groupBy(F.floor(F.col("r") / BLOCK), F.floor(F.col("c") / BLOCK)).applyInPandas(label, shape + ", local long")
    labelled = materialise(blocks, "block-labels")
    edge = lambda k: (F.pmod(F.col(k), F.lit(BLOCK)) == 0) | (F.pmod(F.col(k), F.lit(BLOCK)) == BLOCK - 1)
    seam = labelled.where(edge("r") | edge("c"))
    met = neighbours(seam, offsets, on)
    for k in ("src", "dst"):
        met = met.join(seam.select(F.col("r").alias(f"{k}_r"), F.col("c").alias(f"{k}_c"), F.col("local").alias(k)), [f"{k}_r", f"{k}_c"])
    found = components(met.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    zoned = labelled.join(found, labelled["local"] == found["node"], "left")
    zoned = zoned.select("r", "c", *on, F.coalesce("component", "local").alias("zone"))
    more = [k for k in px.columns if k not in ("r", "c", *on)]
    return px.join(zoned.drop(*on), ["r", "c"]) if more else zoned


def region_measures(zoned: DataFrame, resolution: float, on: tuple[str, ...] = ()) -> DataFrame:
    """D-10: pixel-edge area and perimeter of each region: its pixels, and its pixel sides without a neighbour inside."""
    inner = neighbours(zoned, HALF_FOUR, ("zone",)).groupBy("zone").agg(F.count("*").alias("shared"))
    n = zoned.groupBy("zone", *on).agg(F.count("*").alias("pixels"))
    sides = 4 * F.col("pixels") - 2 * F.coalesce("shared", F.lit(0))
    return n.join(inner, "zone", "left").select("zone", *on, "pixels", (F.col("pixels") * resolution * resolution).alias("area_sqm"), (sides * resolution).alias("perimeter_m"))


def road_class(width: Column) -> Column:
    """E8."""
    return F.when(width >= 4.0, "road").otherwise("pathway")


def trace_chains(edge: DataFrame, node_component: DataFrame) -> DataFrame:
    """Splits each component's graph into chains between end points and junctions, in parallel by component.

    edge: (src_r, src_c, dst_r, dst_c, weight); node_component: (r, c, zone). Gives zone, line_no, vertices (r, c) in walking
    order. Components of under three nodes are dropped; a loop without junctions becomes one closed chain in ring order if it has
    four nodes or more. A component is one group, as skeletons of one road network are thin; its adjacency is a dict.
    """
    import pandas as pd

    tagged = edge.join(node_component.withColumnsRenamed({"r": "src_r", "c": "src_c"}), ["src_r", "src_c"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, c, d in zip(pdf.src_r, pdf.src_c, pdf.dst_r, pdf.dst_c):
            near.setdefault((int(a), int(b)), []).append((int(c), int(d)))
            near.setdefault((int(c), int(d)), []).append((int(a), int(b)))
        lines: list[list[tuple[int, int]]] = []
        if len(near) >= 3:
            for v in near.values():
                v.sort()
            keys = {n for n, v in near.items() if len(v) != 2}
            used: set = set()

            def follow(a, b):
                path = [a, b]
                used.add((a, b) if a < b else (b, a))
                while path[-1] not in keys:
                    nxt = [q for q in near[path[-1]] if q != path[-2]]
                    e = (path[-1], nxt[0]) if path[-1] < nxt[0] else (nxt[0], path[-1])
                    if e in used:
                        break
                    used.add(e)
                    path.append(nxt[0])
                return path

            for a in sorted(keys):
                for b in near[a]:
                    if ((a, b) if a < b else (b, a)) not in used:
                        lines.append(follow(a, b))
            if not keys and len(near) >= 4:
                first = min(near)
                keys.add(first)
                lines.append(follow(first, near[first][0]))
        return pd.DataFrame({"zone": int(pdf.zone.iloc[0]), "line_no": range(1, len(lines) + 1), "vertices": [[{"r": r, "c": c} for r, c in p] for p in lines]})

    return tagged.groupBy("zone").applyInPandas(walk, "zone long, line_no int, vertices array<struct<r:int,c:int>>")
