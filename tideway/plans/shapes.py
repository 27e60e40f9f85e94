"""Queries over shapes and graphs: candidates by cells, exact tests on the pairs left, components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.operators import graph, grouped, mesh, spatial
from tideway.plans.adapters import Views
from tideway.plans.registry import query
from tideway.plans.streams import keeper

BOX = ("min_lat", "min_lng", "max_lat", "max_lng")


def place_shapes(v: Views) -> DataFrame:
    return spatial.bounded(v.places.select("place_id", "kind", spatial.box_polygon(*map(F.col, BOX)).alias("geojson")))


def event_shapes(v: Views) -> DataFrame:
    """A square of up to 0.4 degrees about each current event of a layer."""
    half = 0.05 * (1 + F.col("k") % 4) / 2
    corners = F.col("lat") - half, F.col("lng") - half, F.col("lat") + half, F.col("lng") + half
    return spatial.bounded(v.current.where("layer IN (2, 3)").select("id", spatial.box_polygon(*corners).alias("geojson")))


@query("""SELECT e.id, p.place_id FROM current_events e JOIN places p ON e.lat - 0.05 * (1 + e.k % 4) / 2 <= p.max_lat AND e.lat + 0.05 * (1 + e.k % 4) / 2 >= p.min_lat AND e.lng - 0.05 * (1 + e.k % 4) / 2 <= p.max_lng AND e.lng + 0.05 * (1 + e.k % 4) / 2 >= p.min_lng WHERE e.layer IN (2, 3)""")
def j9_shape_places(v: Views) -> DataFrame:
    """Event shapes and the places they meet, borders included."""
    return spatial.shapes_meet(event_shapes(v), place_shapes(v), tree=v.tree(spatial.CELL)).select("a.id", "b.place_id")


@query("""WITH d AS (SELECT e.seq, p.place_id, greatest(0, p.min_lat - e.lat, e.lat - p.max_lat) * 111320.0 AS dy, greatest(0, p.min_lng - e.lng, e.lng - p.max_lng) * 111320.0 * cos(radians((e.lat + (p.min_lat + p.max_lat) / 2) / 2)) AS dx FROM current_events e, places p WHERE p.kind = 'TOWN')
    SELECT seq, place_id, round(sqrt(dx * dx + dy * dy), 1) AS metres FROM d WHERE sqrt(dx * dx + dy * dy) <= 15000""")
def j11_cameras_near(v: Views) -> DataFrame:
    """Points within 15 km of a town's shape, with the distance; 0 inside."""
    towns = place_shapes(v).where("kind = 'TOWN'")
    return spatial.points_near(v.current.select("seq", "lat", "lng"), towns, 15_000, v.tree(spatial.CELL)).select("a.seq", "b.place_id", F.round("metres", 1).alias("metres"))


def joined(v: Views, observations: DataFrame) -> DataFrame:
    return graph.components(mesh.edges(observations).select("a", "b"), keeper(v.spark))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT x, y FROM (SELECT unnest([pubkey] || path_nodes[:-2]) AS x, unnest(path_nodes) AS y FROM mesh_observations) WHERE x <> '' AND y <> '' AND x <> y), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r AS (SELECT DISTINCT x AS node, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def a18_components(v: Views) -> DataFrame:
    """Nodes that links join, each with the smallest name of its group."""
    return joined(v, v.mesh_observations)


@query()
def a18_components_whole(v: Views) -> DataFrame:
    """The same; a test holds it against a plain union-find."""
    return joined(v, v.mesh_observations)


@query()
def w12_telemetry_kept(v: Views) -> DataFrame:
    """Samples worth storing; what is kept depends on what was kept before, so the test holds it against a loop."""
    t = v.telemetry.select("seq", F.concat(F.lit("n"), "node").alias("pubkey"), "reporter", (F.col("reported_at") - F.col("reported_at") % 7200).alias("reported_at"), (F.col("seq") % 5).cast("double").alias("last_success"), (F.col("uptime") % 3).alias("uptime"), (F.col("seq") % 2).alias("sent"), (F.col("seq") % 3).alias("recv"))
    return grouped.telemetry_kept(t)


@query("""SELECT seq, CASE WHEN n = 1 THEN id ELSE id || ':' || n END AS numbered FROM (SELECT seq, event_type || '-' || user_id % 5 AS id, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY seq) AS n FROM observed)""")
def n11_numbered_ids(v: Views) -> DataFrame:
    rows = v.observed.select("seq", F.concat_ws("-", "event_type", (F.col("user_id") % 5).cast("string")).alias("id"))
    return grouped.numbered_groups(rows, ["id"], ["seq"], "id").select("seq", "numbered")
