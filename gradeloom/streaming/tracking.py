"""A multi-object tracker by camera: boxes of frames become tracks with smoothed boxes and steady labels.

The state of a camera is its list of tracks, a handful of numbers each, in Spark's state store.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from types import SimpleNamespace
from typing import Any

from pyspark.sql import DataFrame

from gradeloom.streaming.stateful import label_step, scan_by_key

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Rules:
    """Fixed values of the tracker."""

    least_iou: float = 0.18
    reach: float = 120.0
    follow_velocity: float = 0.55
    follow_box: float = 0.75
    follow_confidence: float = 0.35
    sharp: float = 25.0
    crisp: float = 90.0
    fast: float = 35.0
    calm: float = 10.0
    cover_size: float = 1.25
    cover_share: float = 0.45
    longest_cover: int = 12
    drift: float = 0.6
    brake: float = 0.75
    most_misses: int = 3
    confirm: int = 2
    switch: int = 3


@dataclass
class Seen:
    """One box of a frame with its label, three confidences and sharpness."""

    box: Box
    label: str
    confidences: tuple[float, float, float]
    sharpness: float


@dataclass
class Track:
    number: int
    box: Box
    confidences: tuple[float, float, float]
    velocity: tuple[float, float] = (0.0, 0.0)
    hits: int = 1
    votes: int = 0
    misses: int = 0
    covered: int = 0
    label: str | None = None
    sums: dict[str, float] = field(default_factory=dict)
    other: str | None = None
    run: int = 0


def moved(b: Box, dx: float, dy: float) -> Box:
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def centre(b: Box) -> tuple[float, float]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def size(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def common(a: Box, b: Box) -> float:
    return size((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def closeness(track: Track, seen: Seen, rules: Rules) -> float:
    """Above 2 for boxes that overlap enough, 0 to 1 for near centres, else -1; the track is taken where its velocity leads."""
    ahead = moved(track.box, *track.velocity)
    both = common(ahead, seen.box)
    iou = both / max(size(ahead) + size(seen.box) - both, 1e-9)
    far = math.dist(centre(ahead), centre(seen.box))
    return 2.0 + iou if iou >= rules.least_iou else 1.0 - far / rules.reach if far <= rules.reach else -1.0


def vote(track: Track, seen: Seen, rules: Rules) -> None:
    """Count a usable observation: blend its confidences in and let the rule of steady labels (``stateful.label_step``) decide about the label."""
    keep = 1 - rules.follow_confidence
    track.confidences = tuple(keep * old + rules.follow_confidence * new for old, new in zip(track.confidences, seen.confidences, strict=True))
    held = (track.label, track.votes, list(track.sums), list(track.sums.values()), track.other, track.run)
    (track.label, track.votes, labels, sums, track.other, track.run), _ = label_step(held, SimpleNamespace(usable=True, label=seen.label, confidence=seen.confidences[2], frame=None), rules.confirm, rules.switch)
    track.sums = dict(zip(labels, sums, strict=True))


def follow(track: Track, seen: Seen, rules: Rules) -> tuple[float, float]:
    """Move a matched track to its observation; gives how far the centre went."""
    (x, y), (u, v) = centre(track.box), centre(seen.box)
    step = (u - x, v - y)
    track.velocity = tuple((1 - rules.follow_velocity) * old + rules.follow_velocity * new for old, new in zip(track.velocity, step, strict=True))
    track.box = tuple((1 - rules.follow_box) * old + rules.follow_box * new for old, new in zip(track.box, seen.box, strict=True))
    way = math.hypot(*step)
    if seen.sharpness >= rules.sharp and way <= rules.fast and (seen.sharpness >= rules.crisp or way <= rules.calm):
        vote(track, seen, rules)
    track.hits, track.misses, track.covered = track.hits + 1, 0, 0
    return step


def cover(track: Track, matched: list[int], seen: list[Seen], rules: Rules) -> int | None:
    """The matched observation that is large enough and hides most of a track, the later one of equals; null without any."""
    own = size(track.box)
    shares = {k: common(track.box, seen[k].box) / max(own, 1e-9) for k in matched if size(seen[k].box) >= rules.cover_size * own}
    return max((k for k, share in shares.items() if share >= rules.cover_share), key=lambda k: (shares[k], k), default=None)


def go_on(track: Track, under: tuple[float, float] | None, rules: Rules) -> None:
    """Where a track without observation goes: along with what covers it (no miss while that is not too long), or on by its own fading velocity."""
    hidden = under is not None
    way = under if hidden else tuple(rules.drift * v for v in track.velocity)
    track.velocity = under if hidden else tuple(rules.brake * v for v in track.velocity)
    track.box = moved(track.box, *way)
    track.covered = track.covered + 1 if hidden else 0
    if track.covered > rules.longest_cover:  # hidden for too long: from here on it is lost like any other
        vx, vy = track.velocity
        track.box, track.velocity = moved(track.box, rules.drift * vx, rules.drift * vy), (rules.brake * vx, rules.brake * vy)
        track.covered, hidden = 0, False
    track.misses = 0 if hidden else track.misses + 1


def begun(seen: Seen, number: int, rules: Rules) -> Track:
    """A new track, with its first vote if the observation is sharp."""
    track = Track(number, seen.box, seen.confidences)
    if seen.sharpness >= rules.sharp:
        vote(track, seen, rules)
    return track


def next_tracks(tracks: list[Track], seen: list[Seen], number: int, rules: Rules = Rules()) -> tuple[list[Track], int]:  # noqa: B008
    """The tracks after one frame, and the number of the next new track."""
    pairs = sorted(((closeness(t, s, rules), i, j) for i, t in enumerate(tracks) for j, s in enumerate(seen)), reverse=True)
    taken: dict[int, int] = {}
    for score, i, j in pairs:
        if score >= 0 and i not in taken and j not in taken.values():
            taken[i] = j
    steps = {j: follow(tracks[i], seen[j], rules) for i, j in taken.items()}
    for i, track in enumerate(tracks):
        if i not in taken:
            over = cover(track, list(steps), seen, rules)
            go_on(track, None if over is None else steps[over], rules)
    fresh = [s for j, s in enumerate(seen) if j not in steps]
    tracks = tracks + [begun(s, number + n, rules) for n, s in enumerate(fresh)]
    number += len(fresh)
    return [t for t in tracks if t.misses <= rules.most_misses], number


def published(tracks: list[Track], rules: Rules = Rules()) -> list[tuple]:  # noqa: B008
    """Confirmed tracks from left to right: number, rounded box, label, confidences."""
    shown = [t for t in tracks if t.hits >= rules.confirm and t.votes >= rules.confirm and t.label is not None]
    rows = [(t.number, *(int(round(x)) for x in t.box), t.label, *t.confidences) for t in shown]
    return sorted(rows, key=lambda r: r[1])


SCHEMA = "frame long, track long, x1 long, y1 long, x2 long, y2 long, label string, kind_confidence double, grade_confidence double, joint_confidence double"


def track_objects(stream: DataFrame, key: str, rules: Rules = Rules(), idle: int | None = None, ts: str | None = None, late: str = "10 minutes") -> DataFrame:  # noqa: B008
    """Tracks shown after each frame, by ``key`` (a long).

    Each row of the stream is a frame: ``frame``, and ``seen``, an array of ``box`` (array of four), ``label``, ``kind_confidence``,
    ``grade_confidence``, ``joint_confidence`` and ``sharpness`` (null: sharp); an empty or null array is an empty frame.
    ``idle``: milliseconds without frames after which a camera's tracks are forgotten. ``ts``: the frames' time, by which they are taken across micro-batches.
    """

    def step(now: tuple, row: Any) -> tuple[tuple, list[tuple] | None]:
        number, text = now
        tracks = [Track(**{**t, "box": tuple(t["box"]), "velocity": tuple(t["velocity"]), "confidences": tuple(t["confidences"])}) for t in json.loads(text)]
        boxes = row.seen if row.seen is not None else []  # rows, or maps where the stream is taken in event order
        seen = [Seen(tuple(map(float, s["box"])), s["label"], (float(s["kind_confidence"]), float(s["grade_confidence"]), float(s["joint_confidence"])), math.inf if s["sharpness"] is None else float(s["sharpness"])) for s in boxes]
        tracks, number = next_tracks(tracks, seen, number, rules)
        return (number, json.dumps([asdict(t) for t in tracks])), [(int(row.frame), *r) for r in published(tracks, rules)] or None

    return scan_by_key(stream, key, "frame", f"{key} long, {SCHEMA}", "number long, tracks string", (0, "[]"), step, idle, ts, late)
