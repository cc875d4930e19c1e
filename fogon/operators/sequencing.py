"""Visit order of one courier's stops: nearest neighbour, then 2-opt.

A route is one row holding arrays, so a batch of routes crosses to Python through
Arrow at once; the helper works on one route, whose length the courier's capacity
bounds.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from fogon.functions.geo import EARTH_RADIUS_KM, KITCHEN_LAT, KITCHEN_LNG

# The helpers travel to the Python workers with the task, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: a 2-opt move must gain more than this many km.
MIN_GAIN_KM = 1e-9


def distance_matrix(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Great-circle km between the kitchen (row 0) and the stops (rows 1..n)."""
    phi = np.radians(np.concatenate(([KITCHEN_LAT], lat)))
    lam = np.radians(np.concatenate(([KITCHEN_LNG], lng)))
    half_phi = np.sin((phi[:, None] - phi[None, :]) / 2)
    half_lam = np.sin((lam[:, None] - lam[None, :]) / 2)
    h = half_phi**2 + np.cos(phi)[:, None] * np.cos(phi)[None, :] * half_lam**2
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def greedy_tour(dist: np.ndarray) -> list[int]:
    """Stops 1..n, always the nearest next; equal distances keep the input order."""
    open_stops = np.ones(len(dist), dtype=bool)
    open_stops[0] = False
    tour, here = [], 0
    for _ in range(len(dist) - 1):
        here = int(np.argmin(np.where(open_stops, dist[here], np.inf)))
        open_stops[here] = False
        tour.append(here)
    return tour


def two_opt(tour: list[int], dist: np.ndarray) -> list[int]:
    """Reverse segments while that shortens the closed tour through the kitchen.

    Each candidate is judged by the two edges it replaces. The scan goes on after an
    accepted move and repeats until a full scan accepts none.
    """
    cost = dist.tolist()
    path = [0, *tour, 0]
    changed = len(tour) > 1
    while changed:
        changed = False
        for i in range(1, len(path) - 2):
            for j in range(i + 1, len(path) - 1):
                before, first, last, after = path[i - 1], path[i], path[j], path[j + 1]
                gain = (
                    cost[before][first] + cost[last][after]
                    - cost[before][last] - cost[first][after]
                )
                if gain > MIN_GAIN_KM:
                    path[i : j + 1] = path[i : j + 1][::-1]
                    changed = True
    return path[1:-1]


def _plan_batch(lat: pd.Series, lng: pd.Series) -> pd.DataFrame:
    naive, best = [], []
    for route_lat, route_lng in zip(lat, lng, strict=True):
        dist = distance_matrix(np.asarray(route_lat), np.asarray(route_lng))
        tour = greedy_tour(dist)
        naive.append(tour)
        best.append(two_opt(tour, dist))
    return pd.DataFrame({"naive": naive, "best": best})


def plan_route(lat: str | Column, lng: str | Column) -> Column:
    """1-based stop positions in nearest-neighbour and in 2-opt order, per route."""
    udf = F.pandas_udf(_plan_batch, "struct<naive: array<int>, best: array<int>>")
    return udf(lat, lng)
