"""The library's own operators: literal cases, brute force, and their SQL on the smallest tables."""

from __future__ import annotations

import math
import random

import pytest

from draftloom import catalog
from draftloom.operators import aggregates, graph, spatial
from draftloom.operators.graph import connected_components
from draftloom.plans import solvers, stages, view
from draftloom.plans.view import over
from draftloom.sources import dxf, readers, sinks
from draftloom.streaming import arrivals
from tests.conftest import SMALL
from tests.helpers import same

WALL = "prim_id string, page long, orient string, coord double, s double, e double"
SEG = "prim_id string, page long, layer string, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("name", ["openings_gap", "wall_pairs", "hv_junctions", "wall_runs", "t_junctions", "endpoint_snap", "object_nearby_text", "room_clusters", "wall_components", "object_aggregates", "compact_linework", "canonical_runs", "curved_walls", "placement_export", "structure_quality", "compact_roundtrip", "wall_type_envelope", "opening_swing", "detector_scores", "pipeline_health", "consumer_readiness", "room_adjacency", "compass_direction", "room_closures", "shell_gaps", "structural_relations", "structural_signals", "hatch_crossings", "rectangular_rooms", "opening_classify", "routing_barriers", "dominant_scale_cluster", "point_in_polygon", "layer_summary", "image_fingerprint", "dimension_nearest_line", "box_touch_join", "node_degree_kind", "room_components", "detector_prf", "wall_pairs_greedy", "loop_simplify", "shared_wall_join", "hypothesis_select", "pipeline_levels", "rerun_closure", "event_sessions", "geojson_features"])
def test_operators_equal_their_plain_sql(spark, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], SMALL)


def test_every_query_names_what_it_covers():
    assert set(catalog.COVERS) == set(catalog.QUERIES) and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_faces_of_a_double_line_room(spark):
    walls = [("top1", 1, "H", 100.0, 100.0, 500.0), ("top2", 1, "H", 110.0, 100.0, 500.0), ("low", 1, "H", 400.0, 100.0, 500.0), ("low2", 1, "H", 390.0, 100.0, 500.0), ("r", 1, "V", 500.0, 100.0, 400.0), ("r2", 1, "V", 490.0, 100.0, 400.0), ("l", 1, "V", 100.0, 100.0, 400.0), ("l2", 1, "V", 110.0, 100.0, 400.0)]
    frame = spark.createDataFrame(walls, WALL)
    pairs = catalog.apply("wall_pairs", walls=frame).collect()
    assert {frozenset((r["a_id"], r["b_id"])) for r in pairs} == {frozenset(p) for p in (("top1", "top2"), ("low2", "low"), ("r2", "r"), ("l", "l2"))}
    assert all(r["separation"] == 10 for r in pairs)
    assert catalog.apply("wall_pairs_greedy", walls=frame).count() == 4


RECTANGLE = [("t", 1, "H", 100.0, 100.0, 500.0), ("b", 1, "H", 350.0, 100.0, 500.0), ("l", 1, "V", 100.0, 100.0, 350.0), ("r", 1, "V", 500.0, 100.0, 350.0)]


def test_nodes_of_a_rectangle_a_tee_and_a_crossing(spark):
    def nodes(walls):
        return {(r["x"], r["y"]): (r["kind"], r["degree"], r["directions"]) for r in catalog.apply("node_degree_kind", walls=spark.createDataFrame(walls, WALL)).collect()}

    assert sorted(nodes(RECTANGLE).values()) == [("Corner", 2, "ES"), ("Corner", 2, "NE"), ("Corner", 2, "NW"), ("Corner", 2, "SW")]
    tee = nodes([("a", 1, "H", 100.0, 100.0, 420.0), ("b", 1, "V", 250.0, 100.0, 280.0)])
    assert tee[250, 100] == ("TJunction", 3, "ESW") and sorted(k for k, *_ in tee.values()) == ["Endpoint"] * 3 + ["TJunction"]
    cross = nodes([("a", 1, "H", 100.0, 0.0, 200.0), ("b", 1, "V", 100.0, 0.0, 200.0), ("c", 1, "H", 100.0, 200.0, 300.0)])
    assert cross[100, 100] == ("Crossing", 4, "NESW") and cross[200, 100][0] == "Inline"
    edges = catalog.apply("wall_edges_split", walls=spark.createDataFrame([("w", 1, "H", 100.0, 100.0, 300.0), ("d", 1, "V", 200.0, 100.0, 240.0)], WALL)).collect()
    assert {r["prim_id"]: (r["edges"], r["shortest"]) for r in edges} == {"w": (2, 100.0), "d": (1, 140.0)}


def test_rooms_are_what_walls_close_off(spark):
    rooms = lambda walls: sorted(r["cells"] for r in catalog.apply("room_components", walls=spark.createDataFrame(walls, WALL)).collect())
    assert rooms(RECTANGLE) == [20 * 13]
    assert rooms([*RECTANGLE, ("m", 1, "V", 300.0, 100.0, 350.0)]) == [10 * 13, 10 * 13]
    assert rooms([*RECTANGLE, ("m", 1, "V", 300.0, 100.0, 250.0)]) == [20 * 13]  # a wall that leaves a way round
    assert rooms(RECTANGLE[:3]) == []  # open to the outside


ROOM = "id string, page long, x double, y double, w double, h double, label string, confidence double"


def test_rooms_side_by_side(spark):
    rooms = spark.createDataFrame([("a", 1, 0.0, 0.0, 100.0, 80.0, None, 0.9), ("b", 1, 100.0, 0.0, 100.0, 80.0, None, 0.9), ("c", 1, 300.0, 0.0, 50.0, 50.0, None, 0.9), ("d", 2, 0.0, 0.0, 100.0, 80.0, None, 0.9)], ROOM)
    # A wall in two parts with an opening of 20 between.
    walls = spark.createDataFrame([("w1", 1, "V", 100.0, 0.0, 30.0), ("w2", 1, "V", 100.0, 50.0, 80.0), ("far", 1, "V", 140.0, 0.0, 80.0)], WALL)
    got = catalog.apply("room_adjacency", rooms=rooms, walls=walls).collect()
    assert [(r["a"], r["b"], r["shared"], r["direction"], r["confidence"]) for r in got] == [("a", "b", 80.0, "East", round(0.48 + 0.16 + 0.18 + 0.12, 9))]
    assert [tuple(r) for r in catalog.apply("compass_direction", rooms=rooms).collect()] == [("a", "b", "East", "West")]
    closed = {r["id"]: r["closed"] for r in catalog.apply("room_closures", rooms=rooms, walls=walls).collect()}
    assert closed == {"a": round(60 / 360, 9), "b": round(60 / 360, 9), "c": 0.0, "d": 0.0}  # no stroke closes nothing
    gaps = catalog.apply("shell_gaps", rooms=rooms, walls=spark.createDataFrame([("t", 1, "H", 3.0, 20.0, 60.0)], WALL)).collect()
    assert {(r["id"], r["side"]): r["covered"] for r in gaps if r["covered"]} == {("a", "top"): 40.0}


def test_arcs_are_in_one_curved_wall_each(spark):
    arcs = spark.createDataFrame([(i, 1, 0.0, 0.0, r, 0.0, 1.5) for i, r in enumerate((50.0, 54.0, 60.0))] + [(9, 1, 30.0, 0.0, 54.0, 0.0, 1.5)], "id long, page long, cx double, cy double, r double, start_at double, sweep double")
    assert catalog.apply("arc_pairs", arcs=arcs).count() == 3
    assert [(r["inner_"], r["outer_"], r["thickness"]) for r in catalog.apply("curved_walls", arcs=arcs).collect()] == [(0, 1, 4.0)]


def test_leaves_hang_on_the_jamb_their_arc_is_about(spark):
    walls = spark.createDataFrame([("a", 1, "H", 100.0, 0.0, 100.0), ("b", 1, "H", 100.0, 130.0, 230.0), ("c", 1, "V", 300.0, 0.0, 100.0), ("d", 1, "V", 300.0, 140.0, 200.0)], WALL)
    arcs = spark.createDataFrame([(1, 1, 130.0, 100.0, 30.0, math.pi, math.pi / 2), (2, 1, 300.0, 101.0, 40.0, 0.0, -math.pi / 2), (3, 1, 700.0, 100.0, 30.0, 0.0, 1.5)], "id long, page long, cx double, cy double, r double, start_at double, sweep double")
    got = {r["arc"]: (r["hinge"], r["swing_side"], r["swing"], r["hinge_x"], r["hinge_y"]) for r in catalog.apply("opening_swing", walls=walls, arcs=arcs).collect()}
    assert got == {1: ("EndJamb", "NegativeCoordinateSide", "CounterClockwise", 130.0, 100.0), 2: ("StartJamb", "PositiveCoordinateSide", "Clockwise", 300.0, 100.0)}


def test_aggregates_are_of_their_members_category(spark):
    def one(*categories):
        rows = [(i, 1, c, 10.0 * i, 0.0, 5.0, 5.0, 0.9, "x", "F") for i, c in enumerate(categories)]
        r = catalog.apply("object_aggregates", items=spark.createDataFrame(rows, "id long, page long, category string, x double, y double, w double, h double, confidence double, label string, status string")).first()
        return r["n"], r["category"], r["influence"]

    assert one("Door", "Door", "Fixture") == (3, "Door", "Unknown")
    assert one("Furniture", "Furniture", "Stair") == (3, "Furniture", "SoftObstacle")
    assert one("Stair", "Stair", "Furniture", "Furniture") == (4, "Furniture", "SoftObstacle")  # a tie goes by name
    assert one("Column", "Equipment") == (2, "GenericSymbol", "Unknown")
    assert one("Column", "Column", "Vehicle") == (3, "Vehicle", "RoomUseEvidenceOnly")


def test_scores_of_detectors_and_stages(spark):
    detections = spark.createDataFrame([(1, "walls", 8, 2, 2), (1, "rooms", 0, 1, 0), (1, "titles", 0, 0, 0)], "page long, detector string, matched long, missed long, extra long")
    assert catalog.apply("detector_scores", detections=detections).first()["score"] == round((0.22 * 0.8 + 0.04) / 0.44, 9)
    health = spark.createDataFrame([(1, "error", 2, True, True), (1, "error", 4, True, True), (1, "warning", 1, True, True), (2, "error", 0, False, False), (3, "other", 9, True, True)], "page long, issue string, n long, ready boolean, declared boolean")
    assert {r["page"]: r["health"] for r in catalog.apply("pipeline_health", health=health).collect()} == {1: round(1 - 0.2 - 0.03, 9), 2: round(1 - 0.65, 9), 3: 1.0}


def test_near_joins_meet_each_pair_once(spark):
    """Boxes far wider than a cell, places on cell borders and below zero."""
    rng = random.Random(4)
    rects = [(i, 1, rng.randrange(-50, 50) * 12.0, rng.randrange(-50, 50) * 12.0, rng.randrange(1, 200) * 1.0, rng.randrange(1, 90) * 1.0, "k") for i in range(60)]
    texts = [(i, 1, rng.randrange(-50, 50) * 12.0, rng.randrange(-50, 50) * 12.0, "t", 1) for i in range(80)]
    inside = lambda t, r: r[2] - 6 <= t[2] <= r[2] + r[4] + 6 and r[3] - 6 <= t[3] <= r[3] + r[5] + 6
    want = {t[0]: min((r[4] * r[5], r[0]) for r in rects if inside(t, r))[1] for t in texts if any(inside(t, r) for r in rects)}
    got = catalog.apply("containment_join", texts=spark.createDataFrame(texts, "id long, page long, x double, y double, text string, size int"), rects=spark.createDataFrame(rects, "id long, page long, x double, y double, w double, h double, kind string")).collect()
    assert want and {r["text_id"]: r["rect_id"] for r in got} == want and len(got) == len(want)


BOX = "id long, page long, x double, y double, w double, h double"


def test_touching_boxes_need_no_pairs(spark, monkeypatch):
    """Boxes of equal components as by brute force, with few edges where all lie in one place."""
    rng = random.Random(7)
    for reach, whole in ((8.0, True), (5.0, False)):
        at = lambda high: float(rng.randrange(-50, high)) if whole else rng.uniform(-50, high)  # noqa: B023, E731
        boxes = [(i, i % 2, at(150), at(150), abs(at(12)) % 12, abs(at(5)) % 5) for i in range(200)] + [(900, 0, -900.0, 0.0, 300.0, 200.0), (901, None, 0.0, 0.0, 1.0, 1.0)]
        want = {b[0]: b[0] for b in boxes}
        for _ in boxes:
            before = dict(want)
            for a in boxes:
                for b in boxes:
                    if a[1] is not None and a[1] == b[1] and a[2] - reach <= b[2] + b[4] and b[2] <= a[2] + a[4] + reach and a[3] - reach <= b[3] + b[5] and b[3] <= a[3] + a[5] + reach:
                        want[a[0]] = want[b[0]] = min(want[a[0]], want[b[0]])
            if want == before:
                break
        assert {r["id"]: r["component"] for r in spatial.touching(spark.createDataFrame(boxes, BOX), reach).collect()} == want
    written, edges = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df, name: edges.append(df.count() if name == "edges" else 0) or written(df, name))
    crowd = [(i, 1, float(i % 20), float(i % 15), 2.0, 2.0) for i in range(400)]
    got = catalog.apply("compact_linework", rects=spark.createDataFrame(crowd, BOX)).first()
    assert (got["component"], got["n"]) == (0, 400) and max(edges) <= 400


def test_nearest_of_crowds_and_of_the_far(spark, monkeypatch):
    """As by brute force, where many texts lie in one place, some are alone and ties go by name; without all pairs of a crowd."""
    rng = random.Random(8)
    texts = [(i, 1, 4.0 * rng.randrange(8), 4.0 * rng.randrange(8)) for i in range(500)] + [(500 + i, 1, 300.0 + 40 * i, 0.0) for i in range(6)] + [(600, 2, 0.0, 0.0)]
    items = [(i, 1, 5.0 * rng.randrange(-12, 80), 5.0 * rng.randrange(-4, 12), 4.0, 3.0) for i in range(200)] + [(200, 3, 0.0, 0.0, 1.0, 1.0)]
    away = lambda i, t: round(math.hypot(max(0.0, t[2] - i[2] - i[4], i[2] - t[2]), max(0.0, t[3] - i[3] - i[5], i[3] - t[3])), 6)
    want = {i[0]: sorted((away(i, t), t[0]) for t in texts if t[1] == i[1] and away(i, t) <= 90)[:5] for i in items}
    made, join = [], spatial.grid_join

    def counted(*args, **kw):
        made.append(join(*args, **kw).count())
        return join(*args, **kw)

    monkeypatch.setattr(spatial, "grid_join", counted)
    frame = spark.createDataFrame([(*i, "Fixture") for i in items], BOX + ", category string")
    rows = catalog.apply("object_nearby_text", items=frame, texts=spark.createDataFrame([(*t, f"t{t[0]}") for t in texts], "id long, page long, x double, y double, text string")).collect()
    got = {i[0]: [] for i in items}
    for r in sorted(rows, key=lambda r: r["rank"]):
        assert r["text"] == f"t{r['text_id']}" and r["rank"] == len(got[r["id"]]) + 1
        got[r["id"]].append((r["distance"], r["text_id"]))
    assert got == want and sum(made) < sum(1 for i in items for t in texts if t[1] == i[1] and away(i, t) <= 90) / 3


def test_least_boxes_are_found_without_ranking_pairs(spark):
    texts = spark.createDataFrame([(1, 1, 10.0, 10.0), (2, 1, 10.0, 10.0), (3, 1, 500.0, 10.0)], "id long, page long, x double, y double")
    rects = spark.createDataFrame([(7, 1, 8.0, 8.0, 4.0, 3.0), (6, 1, 8.0, 8.0, 4.0, 3.0), (5, 1, 0.0, 0.0, 30.0, 30.0), (4, 1, 7.0, 9.0, 3.0, 4.0)], BOX)
    got = catalog.apply("containment_join", texts=texts, rects=rects)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 4, 12.0), (2, 4, 12.0)]  # a tie goes by name
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


STROKE = "id long, page long, x1 double, y1 double, x2 double, y2 double, importance string, wall_type string, confidence double"


def test_truth_is_matched_one_to_one(spark):
    walls = [(i, 1, 0.0, 50.0 * i, 100.0, 50.0 * i, "critical" if i == 2 else "normal", "interior", 0.9) for i in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, STROKE)
    same_ = catalog.apply("detector_prf", predicted=frame(walls), truth=frame(walls)).first()
    assert (same_["recall"], same_["precision_"], same_["f1"]) == (1, 1, 1)
    doubled = catalog.apply("detector_prf", predicted=frame([*walls, *((10 + r[0], *r[1:3], r[3] + 1, r[4], r[5] + 1, *r[6:]) for r in walls)]), truth=frame(walls)).first()
    assert (doubled["matched"], doubled["recall"], doubled["precision_"]) == (5, 1, 0.5)  # the second of each is extra
    less = {(r["importance"]): r["recall"] for r in catalog.apply("truth_by_importance", predicted=frame([w for w in walls if w[0] != 2]), truth=frame(walls)).collect()}
    assert less == {"critical": 0, "normal": 1}


def test_tags_and_hints(spark):
    said = ["VAV-3 FD-2 P-10", "Room P-1 and P-2", "P-1, P-2", "AHU_2", "AHU2", "none"]
    texts = spark.createDataFrame([(i, 1, 0.0, 0.0, t, 1) for i, t in enumerate([*said, "hairline", "portable ramp", "Office chair", "sofa_bed"])], "id long, page long, x double, y double, text string, size int")
    tags: dict = {}
    for r in catalog.apply("tag_tokens", texts=texts).collect():
        tags.setdefault([*said, *[""] * 4][r["id"]], []).append((r["token"], r["prefix"]))
    assert {k: sorted(t for t, _ in v) for k, v in tags.items() if k} == {"VAV-3 FD-2 P-10": ["FD-2", "P-10", "VAV-3"], "Room P-1 and P-2": ["P-1", "P-2"], "P-1, P-2": ["P-1", "P-2"], "AHU_2": ["AHU-2"], "AHU2": ["AHU2"]}
    assert tags["AHU2"][0][1] == "AHU"
    hints = {r["text"]: r["category"] for r in catalog.apply("category_hints", texts=texts).collect()}
    assert (hints["hairline"], hints["portable ramp"], hints["Office chair"], hints["sofa_bed"]) == ("Unknown", "Unknown", "Furniture", "Furniture")


def test_uses_lines_and_fields(spark):
    rooms = spark.createDataFrame([("a", 1, 0.0, 0.0, 100.0, 80.0, "OFFICE/101"), ("b", 1, 0.0, 0.0, 400.0, 80.0, None), ("c", 1, 0.0, 0.0, 100.0, 80.0, "xyz")], "id string, page long, x double, y double, w double, h double, label string")
    assert {r["id"]: r["use"] for r in catalog.apply("room_use_classify", rooms=rooms).collect()} == {"a": "Office", "b": "Corridor", "c": "Unknown"}
    texts = spark.createDataFrame([(1, 1, 0.0, 0.0, "zeta", 1), (2, 1, 10.0, 0.0, "alpha", 1)], "id long, page long, x double, y double, text string, size int")
    assert [(r["words"], r["first_word"]) for r in catalog.apply("text_lines", texts=texts).collect()] == [(2, "zeta")]
    notes = spark.createDataFrame([(0, 1, 0.0, 0.0, "doors", 1), (1, 1, 0.0, 0.0, "walls", 1), (2, 1, 0.0, 0.0, "roof", 1), (3, 1, 0.0, 0.0, "Bedroom 3", 1)], texts.schema)
    assert {r["id"]: (r["marker"], r["body"]) for r in catalog.apply("annotation_items", texts=notes).collect()} == {0: ("12", "doors"), 1: ("A", "walls"), 2: ("7", "roof"), 3: ("", "")}
    fields = {r["id"]: r for r in catalog.apply("title_block_fields", texts=spark.createDataFrame([(i, 1, 0.0, 0.0, "x", 4) for i in range(6)], texts.schema)).collect()}
    assert (fields[0]["label"], fields[1]["label"], fields[1]["date"], fields[2]["revision"], fields[3]["sheet"], fields[5]["label"]) == ("project", "date", "2024-03-04", "C", "A-4", "")


def test_caps_keep_the_best_of_each_page(spark):
    lines = spark.createDataFrame([(f"p{i}", i % 2, "H", 0.0, 0.0, float(i), "A-WALL" if i % 3 else "X", 1) for i in range(20)], f"{WALL}, layer string, part long")
    got = over(lambda name: lines, aggregates.seeds(3)).collect()
    assert {(r["page"], r["rank"]): r["prim_id"] for r in got} == {(0, 1): "p16", (0, 2): "p14", (0, 3): "p10", (1, 1): "p19", (1, 2): "p17", (1, 3): "p13"}
    kept = over(lambda name: view.frame(spark, SMALL, name), aggregates.capped(3, 4, 5, 2, 1)).groupBy("kind", "page").count().collect()
    assert {r["kind"]: r["count"] for r in kept} == {"crop": 3, "linework": 4, "candidate": 5, "room": 2, "arc": 1} and max(r["count"] for r in kept) == 5


def test_sentences_become_flags_and_figures(spark):
    said = [("a", "Trusted exterior shell, not trusted after review"), ("a", "single stroke"), ("b", "Filled wall-solid primitive"), ("b", "pair with thickness 12.5 and coverage 0.82"), ("c", "none")]
    got = {r["prim_id"]: tuple(r)[1:] for r in catalog.apply("evidence_flags", evidence=spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(said)], "prim_id string, n int, said string")).collect()}
    assert got == {"a": (2, False, None, None), "b": (2, True, 12.5, 0.82), "c": (1, False, None, None)}


def test_pages_lose_quality_for_faults(spark):
    got = {r["grade"] for r in catalog.QUERIES["quality_score"](spark, SMALL).collect()}
    assert catalog.QUERIES["quality_score"](spark, SMALL).where("not calibrated").count() > 0 and got - {"Strong"}


def test_what_is_placed_and_what_waits_for_review(spark):
    walls = spark.createDataFrame([("t1", 1, "H", 100.0, 100.0, 500.0), ("t2", 1, "H", 110.0, 100.0, 500.0), ("r", 1, "V", 500.0, 100.0, 400.0), ("alone", 1, "H", 900.0, 700.0, 800.0)], WALL)
    rooms = spark.createDataFrame([("a", 1, 100.0, 100.0, 400.0, 300.0, "Office", 0.9), ("b", 1, 900.0, 0.0, 10.0, 10.0, None, 0.9)], ROOM)
    items = spark.createDataFrame([(7, 1, "Door", 0.0, 0.0, 5.0, 5.0, 0.5, "x", "F")], "id long, page long, category string, x double, y double, w double, h double, confidence double, label string, status string")
    got = {(r["kind"], r["id"]): r["ready"] for r in catalog.apply("placement_export", walls=walls, rooms=rooms, items=items).collect()}
    assert got == {("wall", "t1"): True, ("wall", "t2"): True, ("wall", "r"): True, ("wall", "alone"): False, ("room", "a"): True, ("room", "b"): False, ("object", "7"): False}
    quality = catalog.apply("structure_quality", walls=walls, rooms=rooms).first()
    assert (quality["walls"], quality["total"], quality["supported"], quality["rooms"], quality["closed"], quality["grade"]) == (4, 1200.0, round(1100 / 1200, 9), 2, round((700 / 1400 + 0) / 2, 9), "Partial")


def test_openings_and_the_frontier(spark):
    walls = [("a", 1, "H", 0.0, 0.0, 100.0), ("b", 1, "H", 0.0, 10.0, 40.0), ("c", 1, "H", 0.0, 130.0, 200.0), ("d", 1, "H", 0.0, 300.0, 400.0)]
    got = catalog.apply("openings_gap", walls=spark.createDataFrame(walls, WALL)).collect()
    assert [(r["n_openings"], r["total_gap"], r["widest"]) for r in got] == [(1, 30.0, 30.0)]  # a to c; c to d is too wide


def test_texts_of_dimensions_and_scales(spark):
    said = {"1000 mm": 1000, "4 500": 4500, "3,5 m": 3500, "12'-6\"": 12.5 * 304.8, '8"': 203.2, "1:100": None, "21.7 m2": None, "OFFICE": None, "25 cm": 250}
    texts = spark.createDataFrame([(i, 1, 0.0, 0.0, t, 1) for i, t in enumerate(said)], "id long, page long, x double, y double, text string, size int")
    got = {r["text"]: r["mm"] for r in catalog.apply("dimension_parse", texts=texts).collect()}
    for t, want in said.items():
        assert got[t] is None if want is None else math.isclose(got[t], want), t
    ratio = {r["text"]: r["ratio"] for r in catalog.apply("scale_parse", texts=spark.createDataFrame([(1, 1, 0.0, 0.0, '1/4" = 1\'', 1), (2, 1, 0.0, 0.0, "SCALE 1 : 50", 1)], texts.schema)).collect()}
    assert ratio == {'1/4" = 1\'': 48.0, "SCALE 1 : 50": 50.0}


def test_layers_by_name(spark):
    lines = spark.createDataFrame([(f"p{i}", 1, "H", 0.0, 0.0, 100.0, layer, 1) for i, layer in enumerate(("A-WALL", "DIMENSIONS", "HVAC-VENT", "A-FURN", "A-FIXTURE", "A-HATCH"))], f"{WALL}, layer string, part long")
    got = {r["layer"]: r["category"] for r in catalog.apply("layer_classify", lines=lines).collect()}
    assert got == {"A-WALL": "Wall", "DIMENSIONS": "Dimension", "HVAC-VENT": "HVAC", "A-FURN": "Furniture", "A-FIXTURE": "Fixture", "A-HATCH": "SurfacePattern"}


def test_measurements_with_outliers(spark):
    def check(good, bad):
        rows = [(i, 1, 0.0, 100.0, 0.0, 1000.0) for i in range(good)] + [(good + i, 1, 0.0, 100.0, 0.0, 1370.0) for i in range(bad)]
        return catalog.apply("measurement_checks", dims=spark.createDataFrame(rows, "id long, page long, s double, e double, coord double, mm double")).first()

    assert (check(6, 2)["ratio"], check(6, 2)["blocking"]) == (0.25, False)
    assert not check(11, 4)["blocking"] and check(2, 2)["blocking"]


def test_dimension_chains(spark):
    chain = lambda parent: [(1, 1, 100.0, 200.0, 0.0, 1000.0), (2, 1, 200.0, 300.0, 0.0, 2000.0), (3, 1, 100.0, 300.0, 0.0, parent)]
    for parent, consistent in ((3000.0, True), (3200.0, False)):
        got = catalog.apply("dimension_chains", dims=spark.createDataFrame(chain(parent), "id long, page long, s double, e double, coord double, mm double")).collect()
        assert [(r["id"], r["children"], r["children_mm"], r["consistent"]) for r in got] == [(3, 2, 3000.0, consistent)]


def test_matching_equals_the_sequential_order(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(30), rng.randrange(30), rng.randrange(8) / 8) for _ in range(300)]
    pairs = list({(a, b): (a, b, s) for a, b, s in pairs}.values())
    used_a, used_b, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b, s))
    got = solvers.greedy_matching(spark.createDataFrame(pairs, "a long, b long, score double"))
    assert {tuple(r) for r in got.collect()} == want


def test_crowds_are_matched_by_tiers(spark, monkeypatch):
    """As the sequential SQL does, with few pairs of a crowd made: ends that a better pair took meet no others."""
    few = solvers.FEW
    for n in ("greedy_assignment", "truth_by_importance", "curved_walls"):
        monkeypatch.setattr(solvers, "FEW", 50)
        monkeypatch.setattr(solvers, "crowded", lambda *_: True)
        same(catalog.QUERIES[n](spark, SMALL), catalog.ORACLES[n], SMALL)
    monkeypatch.setattr(solvers, "FEW", few)
    made, wrote = [], solvers.written
    monkeypatch.setattr(solvers, "written", lambda df, name: made.append(df.count() if name in ("met", "pairs") else 0) or wrote(df, name))
    rows = [(i, 1, 10.0 * (i % 30), 0.0, 10.0 * (i % 30) + 50, 0.0, "normal", "interior", 0.9) for i in range(300)]
    frame = spark.createDataFrame(rows, STROKE)
    assert catalog.apply("greedy_assignment", predicted=frame, truth=frame).count() == 300 and sum(made) <= 300 * 10


def test_local_search_ends_where_no_change_helps():
    rng = random.Random(2)
    for _ in range(30):
        ids = list(range(9))
        unary = {i: rng.uniform(-1, 1) for i in ids}
        relations = [(a, b, rng.uniform(-0.5, 0.5), rng.random() < 0.1) for a in ids for b in ids if a < b and rng.random() < 0.4]
        value = lambda c: sum(unary[i] for i in c) + sum(-1.5 if h else w for a, b, w, h in relations if a in c and b in c)  # noqa: B023, E731
        loops = [(rng.random(), [(rng.randrange(1, 9), rng.sample(ids, 2)) for _ in range(4)]) for _ in range(2)]
        objective = solvers.Objective(unary, relations, loops)

        def worth(c):
            share = [sum(n for n, of in edges if c & set(of)) / sum(n for n, _ in edges) for _, edges in loops]  # noqa: B023
            return value(c) + sum(w * (0.55 * s * s + 0.85 * (s >= 0.9)) for (w, _), s in zip(loops, share, strict=True))  # noqa: B023

        chosen = solvers.local_search(objective, passes=100)
        assert all(worth(chosen ^ {i}) <= worth(chosen) + 1e-3 for i in ids)
        grown = solvers.bundled(objective, chosen, set(ids), dict.fromkeys(ids, 1.0), [(a, b, w) for a, b, w, _ in relations])
        assert grown >= chosen and worth(grown) >= worth(chosen) - 1e-9
        assert math.isclose(objective.added(sorted(grown - chosen), chosen), worth(grown) - worth(chosen), abs_tol=1e-9)


def test_bundles_close_rooms_and_carry_on_runs():
    # Each of two missing sides costs .1 alone; together they close the room.
    unary = {"a": 0.3, "b": 0.3, "c": -0.35, "d": -0.35, "x": -0.3}
    loop = (1.0, [(10, ["a"]), (10, ["b"]), (10, ["c", "x"]), (10, ["d"])])
    objective = solvers.Objective(unary, [("c", "x", 0.0, True)], [loop])
    chosen = solvers.local_search(objective)
    sizes = dict.fromkeys(unary, 10.0)
    assert chosen == {"a", "b"} and solvers.bundled(objective, chosen, set(unary), sizes, []) == {"a", "b", "d", "x"}
    assert solvers.bundled(objective, chosen, {"c", "x"}, sizes, []) == {"a", "b"}  # no stroke for one side
    # A run whose next part costs more than its link, but not with the one after it.
    unary = {"a": 0.3, "b": -0.25, "c": -0.05}
    links = [("a", "b", 0.2, False), ("b", "c", 0.2, False)]
    objective = solvers.Objective(unary, links)
    chosen = solvers.local_search(objective)
    assert chosen == {"a"} and solvers.bundled(objective, chosen, set(unary), sizes, [r[:3] for r in links]) == {"a", "b", "c"}


def test_exact_runs_straddle_buckets():
    assert solvers.exact_runs([0.0, 55.0, 200.0], [50.0, 100.0, 260.0], [0.9, 1.1, 0.9]) == [[0, 1], [2]]


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(60)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_stage_levels():
    found = stages.levels()
    assert found[0] == 0 and all(found[a] < found[b] for a, b in stages.dependencies())
    assert stages.downstream(29) == {29} and {12, 13, 15, 18} <= stages.downstream(12)


DXF = """0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nDOOR\n0\nLINE\n8\nA-DOOR\n10\n0\n20\n0\n11\n10\n21\n0\n0\nINSERT\n2\nDOOR\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nA-WALL\n10\n1\n20\n2\n11\n3\n21\n4
0\nINSERT\n8\nX\n2\nDOOR\n10\n100\n20\n50\n41\n2\n42\n2\n50\n90\n0\nARC\n8\nA\n10\n5\n20\n6\n40\n30\n50\n350\n51\n80\n0\nTEXT\n8\nT\n10\n7\n20\n8\n1\nOFFICE\n0\nLWPOLYLINE\n8\nP\n70\n1\n10\n0\n20\n0\n10\n4\n20\n0\n10\n4\n20\n3\n0\nENDSEC\n0\nEOF\n"""


def test_drawing_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.dxf").write_text(DXF)
    (tmp_path / "bad.dxf").write_text("zero\nSECTION\n")
    rows = dxf.read(spark, f"file://{tmp_path}").collect()
    good = [r for r in rows if r["doc"].endswith("a.dxf")]
    assert [r["kind"] for r in good] == ["Line", "Symbol", "Line", "Symbol", "Arc", "Text", "Polyline"]  # a block isn't followed into itself
    assert [round(v, 6) for v in (good[2]["x1"], good[2]["y1"], good[2]["x2"], good[2]["y2"])] == [100, 50, 100, 70] and good[2]["block"] == "DOOR"
    assert math.isclose(good[4]["sweep"], math.radians(90)) and len(good[6]["points"]) == 3 and good[6]["closed"]
    assert [r["kind"] for r in rows if r["doc"].endswith("bad.dxf")] == ["error"]
    with pytest.raises(NotImplementedError):
        readers.read(spark, "x.dwg")


def drawn(entities: str, block: str = "", base: str = "10\n0\n20\n0") -> str:
    blocks = f"0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB\n{base}\n{block}\n0\nENDBLK\n0\nENDSEC\n" if block else ""
    return f"{blocks}0\nSECTION\n2\nENTITIES\n{entities}\n0\nENDSEC\n0\nEOF\n"


def test_inserted_blocks_turn_mirror_stretch_and_repeat():
    arc = "0\nARC\n8\n0\n10\n1\n20\n0\n40\n2\n50\n0\n51\n90"
    insert = lambda more: f"0\nINSERT\n8\nDOORS\n2\nB\n10\n10\n20\n20\n{more}"
    kinds = lambda text, kind: [r for r in dxf.primitives(text) if r["kind"] == kind]
    turned = kinds(drawn(insert("50\n90"), arc), "Arc")[0]
    assert [round(turned[k], 6) for k in ("x1", "y1", "radius", "start_angle", "sweep")] == [10, 21, 2, round(math.pi / 2, 6), round(math.pi / 2, 6)] and turned["layer"] == "DOORS"
    mirrored = kinds(drawn(insert("41\n-1\n42\n1"), arc), "Arc")[0]
    ends = lambda r: {tuple(round(c + r["radius"] * f(a), 6) for c, f in ((r["x1"], math.cos), (r["y1"], math.sin))) for a in (r["start_angle"], r["start_angle"] + r["sweep"])}
    assert ends(mirrored) == {(7, 20), (9, 22)} and mirrored["sweep"] > 0
    stretched = kinds(drawn(insert("41\n3\n42\n1"), arc), "Polyline")[0]
    assert all(math.isclose(((p["x"] - 13) / 6) ** 2 + ((p["y"] - 20) / 2) ** 2, 1) for p in stretched["points"]) and not stretched["closed"]
    line = "0\nLINE\n8\nA\n10\n5\n20\n5\n11\n6\n21\n5"
    grid = kinds(drawn(insert("70\n3\n71\n2\n44\n10\n45\n100"), line, "10\n5\n20\n5"), "Line")
    assert [(r["x1"], r["y1"]) for r in grid] == [(10, 20), (20, 20), (30, 20), (10, 120), (20, 120), (30, 120)] and grid[0]["layer"] == "A"
    said = "".join(f"\n0\nATTRIB\n8\nT\n10\n1\n20\n2\n1\n{text}\n2\n{tag}\n70\n{hidden}" for text, tag, hidden in (("D-01", "NUMBER", 0), ("secret", "NOTE", 1), (" ", "EMPTY", 0)))
    assert [(r["text"], r["tag"], r["block"], r["x1"]) for r in dxf.primitives(drawn(insert("66\n1") + said + "\n0\nSEQEND", line)) if r["kind"] == "Text"] == [("D-01", "NUMBER", "B", 1.0)]
    low, high = dxf.primitives(drawn(line + "\n0\nARC\n8\nA\n10\n0\n20\n0\n40\n1\n50\n0\n51\n90"), flip=True)
    assert (low["y1"], high["y1"], high["start_angle"]) == (0, 5, -math.pi / 2)


def test_json_documents_and_reports(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"overrides": [{"pattern": "A-*", "category": "Wall"}, {"pattern": "D", "category": "Door", "sourceFormat": "dxf"}]}')
    rows = readers.read_json(spark, f"file://{tmp_path}/p.json", "layer-profile").collect()
    assert [(r["pattern"], r["category"], r["bad"]) for r in rows] == [("A-*", "Wall", None), ("D", "Door", None)]
    strings = spark.createDataFrame([(1, "a", "b"), (2, "b", None), (3, "c", "a"), (3, "c", "a")], "id int, p string, q string")
    book, coded = sinks.compact(strings, ["p", "q"])
    assert sorted(r["value"] for r in book.collect()) == ["a", "b", "c"] and book.select("code").distinct().count() == 3 and dict(coded.dtypes)["p"] == "bigint"
    assert sorted(map(tuple, sinks.expand(book, coded, ["p", "q"]).collect()), key=str) == sorted(map(tuple, strings.collect()), key=str)
    assert sinks.markdown(spark.range(2), "Report") == "# Report\n\n| id |\n| --- |\n| 0 |\n| 1 |\n"


def test_arriving_documents(spark, tmp_path):
    segs = spark.createDataFrame([("a", 1, "A-WALL", 0.0, 0.0, 50.0, 0.0)], SEG)
    segs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        query = arrivals.process(spark.readStream.schema(segs.schema).parquet(f"{tmp_path}/in"), lambda rows: rows.selectExpr("prim_id", "x2 - x1 AS len"), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
    assert [r["len"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [50.0]
    events = spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema).parquet(f"{SMALL}/events.parquet*")
    q = arrivals.durations(events).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").count()
