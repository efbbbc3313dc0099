import pytest

from harborlight import boxes
from harborlight.boxes import Box


def test_queries():
    assert boxes.asked_for({"bbox": "[-71, 42, -70, 43]"}) == Box(42, 43, -71, -70)
    assert boxes.asked_for({"bbox": [179, 0, -179, 1]}) == Box(0, 1, 179, -179)
    for bad in ("1,2,3", "-71,43,-70,42", "-71,42,,43", [0, 0, 30, 1], [0, 0, 1, 95], 5):
        assert boxes.asked_for({"bbox": bad, "distance": 5, "position": [0, 0]}) is None
    box = boxes.asked_for({"position": {"latitude": "42", "longitude": -71}, "distance": 1000})
    assert 0.0089 < box.north - 42 < 0.0091 and box.west < -71 < box.east
    for bad in ({"distance": 0}, {"distance": 2e6}, {"distance": " "}, {}):
        assert boxes.asked_for(bad | {"position": [0, 0]}) is None


def test_hull_goes_the_short_way():
    assert boxes.hull(Box(0, 1, 170, 175), Box(-1, 0, -175, -170)) == Box(-1, 1, 170, -170)
    assert boxes.hull(Box(0, 1, -10, 0), Box(0, 1, 5, 10)) == Box(0, 1, -10, 10)
    assert boxes.hull(Box(0, 1, 180, -180), Box(0, 1, 180, -180)) == Box(0, 1, 180, -180)
    assert boxes.hull(Box(0, 1, -180, 180), Box(0, 1, 5, 10)) == Box(0, 1, -180, 180)
    with pytest.raises(ValueError):
        boxes.hull(Box(0, 1, float("nan"), 0), Box(0, 1, 0, 1))


def test_parts_and_clamps():
    assert boxes.parts(Box(0, 1, 170, -170)) == [Box(0, 1, 170, 180), Box(0, 1, -180, -170)]
    assert boxes.clamped(Box(0, 10, 175, -175)) == Box(4, 6, 179, -179)
    assert boxes.clamped(Box(0, 1, 5, 6)) == Box(0, 1, 5, 6)


def test_circle_near_a_pole_and_bad_input():
    assert boxes.around(89.999, 0, 5000).north <= 90
    for bad in ((91, 0, 5), (0, 181, 5), (0, 0, -1), (0, 0, float("inf"))):
        with pytest.raises(ValueError):
            boxes.around(*bad)


def test_route_boxes_stop_at_the_look_ahead():
    near = boxes.along_route([(0, 0), (0, 0.1)], 500)
    far = boxes.along_route([(0, 0), (0, 5)], 500)
    assert near.east < 0.11 and 0.166 < far.east < 0.175
    assert boxes.along_route([], 500) is None
    assert boxes.along_route([(0, 0), (0, 5), (9, 9)], 500) == far


def test_waypoints():
    entries = [[0, 1], [200, 1], "x", [2, 3, 9], [4]]
    assert boxes.waypoints(entries) == [(1.0, 0.0), (3.0, 2.0)]
    assert boxes.waypoints(entries, True, 1) == [(1.0, 0.0)]
    assert boxes.waypoints(entries, index=99) == [(3.0, 2.0)] and boxes.waypoints(entries, index=-1) == boxes.waypoints(entries)
    assert boxes.waypoints(None) == []
