"""Settings from an INI file: folders of graphs, and the grid of random ones."""

from __future__ import annotations

import configparser
from dataclasses import dataclass


def _numbers(text: str, kind: type) -> tuple:
    return tuple(kind(x) for x in text.replace(",", " ").split())


@dataclass(frozen=True)
class Settings:
    paths: dict[str, str]
    sizes: tuple[int, ...] = (1000, 10000, 100000)
    ratios: tuple[float, ...] = (1.0, 10.0)
    negative_rates: tuple[float, ...] = (0.0, 0.01)
    copies: int = 5


def load_settings(path: str) -> Settings:
    """Section ``paths`` names folders; section ``grid`` has sizes, ratios, negative_rates (lists) and copies. What is absent keeps its default; a missing file is an error."""
    parser = configparser.ConfigParser()
    with open(path) as f:
        parser.read_file(f)
    found = {}
    if parser.has_section("grid"):
        grid = parser["grid"]
        for name, kind in (("sizes", int), ("ratios", float), ("negative_rates", float)):
            if name in grid:
                found[name] = _numbers(grid[name], kind)
        if "copies" in grid:
            found["copies"] = grid.getint("copies")
    return Settings(dict(parser["paths"]) if parser.has_section("paths") else {}, **found)
