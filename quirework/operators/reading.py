"""Reading order of regions on a page: letters by insertion with a spatial comparison, registers by groups of overlapping regions.

Both orders depend on the order of arrival and on no transitive comparison, so a page's regions are ordered in one function call. A page is a
bounded group: rows are gathered by page only.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Region = dict  # id, l, t, r, b, label


def letter_order(regions: list[Region]) -> list[Region]:
    """Every region goes before the first one already placed that it precedes: wholly above it; or level with it and of like height, then further left if they share enough height, else higher; or
    level but of other height, with its middle above the other's top."""

    def precedes(a: Region, b: Region) -> bool:
        if a["b"] < b["t"]:
            return True
        if a["t"] > b["b"]:
            return False
        ha, hb = a["b"] - a["t"], b["b"] - b["t"]
        low = 0.3 * min(ha, hb)
        if abs(ha - hb) >= low:
            return (a["t"] + a["b"]) / 2 < b["t"]
        higher = a["t"] < b["t"]
        shared = a["b"] - b["t"] if higher else b["b"] - a["t"]
        return a["l"] < b["l"] if shared > low else higher

    placed: list[Region] = []
    for a in regions:
        at = next((i for i, b in enumerate(placed) if precedes(a, b)), len(placed))
        placed.insert(at, a)
    return placed


def _is_number(label: str | None, most: int | None = None) -> bool:
    x = (label or "").replace(".", "").replace(" ", "")
    return x.isdigit() and (most is None or len(x) <= most)


class _Group:
    def __init__(self, region: Region, heading: bool = False) -> None:
        self.regions, self.heading = [region], heading

    def span(self, k: str) -> int:
        return (min if k in "lt" else max)(x[k] for x in self.regions)

    @property
    def top(self) -> int:
        return 0 if self.heading and len(self.regions) == 1 else self.span("t")

    @property
    def bottom(self) -> int:
        return 0 if self.heading and len(self.regions) == 1 else self.span("b")


def register_groups(regions: list[Region], page_width: int) -> list[_Group]:
    """Regions joined to the first group that they overlap in height, unless both are wide; short numbers head the page on their own. Groups in the left half then join the body group that is closest in height."""
    groups: list[_Group] = []
    for x in regions:
        if _is_number(x["label"], 4):
            groups.append(_Group(x, True))
            continue
        wide = x["r"] - x["l"] > 0.4 * page_width
        for g in groups:
            apart = g.bottom <= x["t"] or g.top >= x["b"]
            if not apart and not (wide and g.span("r") - g.span("l") > 0.4 * page_width):
                g.regions.append(x)
                break
        else:
            groups.append(_Group(x))
    def lone(g: _Group) -> bool:
        return all(x["r"] < page_width / 2 and not _is_number(x["label"]) for x in g.regions)

    if not any(map(lone, groups)):  # only a group without any number asks for the others to be attached
        return groups
    heads = [g for g in groups if all(_is_number(x["label"]) for x in g.regions)]
    left = [g for g in groups if g not in heads and all(x["r"] < page_width / 2 for x in g.regions)]
    bodies = [g for g in groups if g not in heads and g not in left]
    if not bodies:
        bodies, left = left[:1], left[1:]
    for g in left:
        to = min(bodies, key=lambda h: min(abs(g.bottom - h.top), abs(g.top - h.bottom)))
        to.regions += g.regions
    return heads + bodies


def register_order(regions: list[Region], page_width: int) -> list[tuple[Region, str, int]]:
    """Regions with their mode and group: by group from the top, page numbers alone, else annotations (left half) before bodies, each from the top."""
    out: list[tuple[Region, str, int]] = []
    for k, g in enumerate(sorted(register_groups(regions, page_width), key=lambda g: g.top)):
        if len(g.regions) == 1 and _is_number(g.regions[0]["label"]):
            out.append((g.regions[0], "page_number", k))
            continue
        left = [x for x in g.regions if x["r"] < page_width / 2]
        right = [x for x in g.regions if x["r"] >= page_width / 2]
        out += [(x, "annotation", k) for x in sorted(left, key=lambda x: x["t"])]
        out += [(x, "body", k) for x in sorted(right, key=lambda x: x["t"])]
    return out


def _by_page(regions: DataFrame, order: Callable[[list[Region], int], list[tuple[Region, str | None, int | None]]]) -> DataFrame:
    """scan_id, region_id, place, mode, grp of the regions with a whole box, in order of arrival (pos, region_id)."""
    schema = pa.schema([("scan_id", pa.int64()), ("region_id", pa.int64()), ("place", pa.int32()), ("mode", pa.string()), ("grp", pa.int32())])

    def run(page: pa.Table) -> pa.Table:
        rows = sorted(page.to_pylist(), key=lambda x: (x["pos"] is None, x["pos"] or 0, x["id"]))
        width = max((x["page_width"] or 0 for x in rows), default=0)
        made = order(rows, width)
        return pa.table([pa.array([x["scan_id"] for x, _, _ in made], pa.int64()), pa.array([x["id"] for x, _, _ in made], pa.int64()), pa.array(range(len(made)), pa.int32()), pa.array([m for _, m, _ in made], pa.string()), pa.array([g for _, _, g in made], pa.int32())], schema=schema)

    whole = regions.where("coords.l is not null and coords.t is not null and coords.r is not null and coords.b is not null and scan_id is not null")
    x = whole.select(F.col("scan_id").cast("bigint"), F.col("region_id").cast("bigint").alias("id"), "pos", "label", "page_width", "coords.l", "coords.t", "coords.r", "coords.b")
    return x.groupBy("scan_id").applyInArrow(run, "scan_id bigint, region_id bigint, place int, mode string, grp int")


def order_letters(regions: DataFrame) -> DataFrame:
    return _by_page(regions, lambda rows, _: [(x, None, None) for x in letter_order(rows)]).select("scan_id", "region_id", "place")


def order_registers(regions: DataFrame) -> DataFrame:
    return _by_page(regions, register_order)
