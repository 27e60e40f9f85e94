"""Pages by key, budgets and top-k."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SIZE, MOST_SIZE = 50, 200
Order = Sequence[tuple[str, bool]]  # column, descending


def token(row: dict) -> str:
    """An opaque mark of where a page ended."""
    return base64.urlsafe_b64encode(json.dumps(row, sort_keys=True).encode()).decode().rstrip("=")


def read_token(text: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))


def after(order: Order, last: dict) -> Column:
    """Rows that come after the last one, in an order of mixed directions."""
    terms = []
    for i, (name, down) in enumerate(order):
        equal = [F.col(n) == F.lit(last[n]) for n, _ in order[:i]]
        beyond = F.col(name) < F.lit(last[name]) if down else F.col(name) > F.lit(last[name])
        terms.append(reduce(lambda a, b: a & b, [*equal, beyond]))
    return reduce(lambda a, b: a | b, terms)


def page(rows: DataFrame, order: Order, size: int = DEFAULT_SIZE, last: dict | None = None) -> DataFrame:
    """One page and the row that tells whether there is another."""
    n = min(MOST_SIZE, size or DEFAULT_SIZE)
    rows = rows.where(after(order, last)) if last else rows
    return rows.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in order)).limit(n + 1)


def within_budget(rows: DataFrame, order: Order, size: Column, budget: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows in order while their summed size fits, one at least."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in order))
    sized = rows.withColumn("_used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return sized.where((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def natural_key(name: str) -> list[Column]:
    """Sort keys: letters before the first number, the number, then the text."""
    return [F.regexp_extract(name, r"^(\D*)", 1), F.coalesce(F.regexp_extract(name, r"^\D*(\d+)", 1).try_cast("bigint"), F.lit(-1)), F.col(name)]


#: Names of the event model that a request may use; two older names mean MESH.
LAYERS = ("WILDFIRE", "EVACUATION", "WEATHER_ALERT", "FIRE_WEATHER", "EARTHQUAKE", "ROAD_INCIDENT", "MESH", "POWER", "BURN_STATUS", "GAUGE", "AIR_QUALITY", "ANNOUNCEMENT")
ALIASES = {"NETWORK": "MESH", "MESH_NODE": "MESH"}
STATUSES = ("ACTIVE", "SCHEDULED", "RESOLVED", "EXPIRED")
KINDS = ("AREA", "COUNTY", "TOWN", "CORRIDOR")


def _names(values: Sequence[str], known: Sequence[str], what: str, aliases: dict[str, str] | None = None) -> list[str]:
    out = []
    for name in (n.strip().upper() for v in values for n in v.split(",")):
        name = (aliases or {}).get(name, name)
        if name and name not in known:
            raise ValueError(f"unknown {what}: {name!r}")
        if name and name not in out:
            out.append(name)
    return out


def layers(values: Sequence[str]) -> list[str]:
    """Layer names of repeated or comma-separated values, whatever their case; an unknown one is an error."""
    return _names(values, LAYERS, "layer", ALIASES)


def statuses(values: Sequence[str]) -> list[str]:
    """Status names; ACTIVE and SCHEDULED when none is asked for."""
    return _names(values, STATUSES, "status") or ["ACTIVE", "SCHEDULED"]


def severity(name: str) -> int:
    """The least severity of a request; none and INFO filter nothing."""
    from tideway.functions.classify import NAMES

    return NAMES.index(_names([name], NAMES, "severity")[0]) if name.strip() else 0


def place_kind(name: str) -> str | None:
    found = _names([name], KINDS, "place kind")
    return found[0] if found else None


def moment(text: str) -> int | None:
    """Seconds of an RFC 3339 stamp, which states its offset; none for an empty one."""
    from datetime import datetime

    if not text.strip():
        return None
    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    if at.tzinfo is None or "T" not in text.upper():
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    return int(at.timestamp())


def page_size(n: int) -> int:
    if n < 0:
        raise ValueError("page_size must not be negative")
    return min(MOST_SIZE, n or DEFAULT_SIZE)


def by_key(places: DataFrame, key: str) -> DataFrame:
    """The place of an id (which has a colon) or of a slug."""
    return places.where(F.col("place_id" if ":" in key else "slug") == key)


def late_page(rows: DataFrame, order: Order, key: str, size: int = DEFAULT_SIZE, last: dict | None = None) -> DataFrame:
    """A page whose keys are chosen on the order's columns alone; the wide columns are joined to those few rows, and the order is set again."""
    narrow = page(rows.select(key, *(c for c, _ in order if c != key)), order, size, last).select(F.col(key).alias("_key"))
    found = rows.join(F.broadcast(narrow), F.col(key) == F.col("_key")).drop("_key")  # at most MOST_SIZE + 1 keys
    return found.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in order))
