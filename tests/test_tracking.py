"""The tracker against hand-counted cases, and on a stream against a plain loop."""

import math

import pytest

from gradeloom.streaming import tracking as tr
from tests.test_streams import replay  # noqa: F401


def seen(x, y=0, label="red:good", c=0.8, sharp=math.inf, side=100):
    return tr.Seen((x, y, x + side, y + side), label, (c, c, c), sharp)


def run(frames, rules=tr.Rules()):  # noqa: B008
    tracks, number, out = [], 0, []
    for f in frames:
        tracks, number = tr.next_tracks(tracks, f, number, rules)
        out.append((tr.published(tracks, rules), [t.number for t in tracks]))
    return tracks, out


def test_box_and_velocity_follow():
    tracks, out = run([[seen(0)], [seen(8)], [seen(16)]])
    assert out[0][0] == [] and [r[0] for r in out[1][0]] == [0]
    assert tracks[0].box[0] == pytest.approx(0.25 * 6 + 0.75 * 16)
    assert tracks[0].velocity[0] == pytest.approx(0.45 * (0.55 * 8) + 0.55 * 10)


def test_label_needs_a_run_and_blurred_boxes_do_not_vote():
    tracks, out = run([[seen(0)], [seen(0)], [seen(0, label="red:bad")], [seen(0, label="red:bad", sharp=20)], [seen(0, label="red:bad")], [seen(0, label="red:bad")]])
    assert [r[0][0][5] for r in out[1:]] == ["red:good"] * 4 + ["red:bad"]
    assert tracks[0].votes == 5 and tracks[0].hits == 6


def test_fast_or_soft_boxes_do_not_vote():
    tracks, _ = run([[seen(0)], [seen(40)], [seen(60, sharp=50)]])
    assert tracks[0].votes == 1 and tracks[0].hits == 3


def test_near_centres_match_and_far_ones_do_not():
    assert run([[seen(0, side=10)], [seen(115, side=10)]])[1][1][1] == [0]
    assert run([[seen(0, side=10)], [seen(125, side=10)]])[1][1][1] == [0, 1]


def test_lost_tracks_drift_and_go():
    tracks, out = run([[seen(0)], [seen(10)], [], [], [], []])
    assert [n for _, n in out] == [[0]] * 5 + [[]]
    tracks, _ = run([[seen(0)], [seen(10)], []])
    assert tracks[0].box[0] == pytest.approx(7.5 + 0.6 * 5.5) and tracks[0].velocity[0] == pytest.approx(5.5 * 0.75)


def test_covered_tracks_stay():
    big = lambda x: tr.Seen((x, 0, x + 300, 200), "red:good", (0.9, 0.9, 0.9), math.inf)
    frames = [[seen(0), big(40)], [seen(0), big(40)]] + [[big(40 - 10 * k)] for k in range(1, 16)]
    tracks, out = run(frames)
    assert out[10][1] == [0, 1]  # more frames unseen than misses allow
    assert tr.Rules().longest_cover == 12


def test_stream_is_the_loop(replay):  # noqa: F811
    frames = [[seen(4 * n), seen(300 - 3 * n, 50, "green:bad", 0.6, 95)] if n % 7 != 5 else [] for n in range(18)]
    as_row = lambda s: (list(map(float, s.box)), s.label, *s.confidences, None if s.sharpness == math.inf else float(s.sharpness))
    rows = [(k, n, [as_row(s) for s in f]) for n, f in enumerate(frames) for k in (1, 2)]
    schema = "camera long, frame long, seen array<struct<box:array<double>,label:string,kind_confidence:double,grade_confidence:double,joint_confidence:double,sharpness:double>>"
    got = replay(rows, schema, lambda s: tr.track_objects(s, "camera"), "tracks")
    want = [(n, *r) for n, (shown, _) in enumerate(run(frames)[1]) for r in shown]
    for camera in (1, 2):
        assert sorted(tuple(r)[1:] for r in got if r.camera == camera) == sorted(want)
