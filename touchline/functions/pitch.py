"""Pitch geometry as column expressions. Coordinates are centimetres; the acting club attacks towards growing x."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.bind import let

# Limits of the published definitions, in centimetres, degrees and seconds.
PLAUSIBLE_MARGIN = 300.0
PROGRESSIVE_GAIN = 914.4
LATERAL_BAND_DEGREES = 15.0
PRESSURE_RADIUS = 500.0
GOAL_WIDTH = 732.0
CROWD_RADIUS = 1000.0


@dataclass(frozen=True)
class Pitch:
    """Length, width and penalty area of a pitch."""

    length: float
    width: float
    box_length: float
    box_width: float


FIFA = Pitch(10500, 6800, 1650, 4032)
ROBOFLOW = Pitch(12000, 7000, 2015, 4100)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    return F.sqrt(dx * dx + dy * dy)


def from_normalised(x: Column, y: Column, attacks_positive_x: Column, pitch: Pitch = FIFA) -> tuple[Column, Column]:
    """Unit coordinates to centimetres, both axes turned where the club attacks towards falling x."""
    return F.when(attacks_positive_x, x).otherwise(1 - x) * pitch.length, F.when(attacks_positive_x, y).otherwise(1 - y) * pitch.width


def turned(x: Column, y: Column, pitch: Pitch = FIFA) -> tuple[Column, Column]:
    """The point as the opponent sees it: half a turn about the centre."""
    return F.lit(pitch.length) - x, F.lit(pitch.width) - y


def is_plausible(x: Column, y: Column, pitch: Pitch = FIFA, margin: float = PLAUSIBLE_MARGIN) -> Column:
    return x.between(-margin, pitch.length + margin) & y.between(-margin, pitch.width + margin)


def goal_distance(x: Column, y: Column, pitch: Pitch = FIFA) -> Column:
    return distance(x, y, F.lit(float(pitch.length)), F.lit(pitch.width / 2))


def goal_angle(x: Column, y: Column, pitch: Pitch = FIFA, goal_width: float = GOAL_WIDTH) -> Column:
    """Angle between the posts in radians; 0 on or behind the goal line."""
    dx = F.lit(float(pitch.length)) - x
    upper, lower = pitch.width / 2 + goal_width / 2 - y, pitch.width / 2 - goal_width / 2 - y
    return F.when(dx <= 0, 0.0).otherwise(F.abs(F.atan2(upper, dx) - F.atan2(lower, dx)))


def third(x: Column, pitch: Pitch = FIFA) -> Column:
    return F.when(x < pitch.length / 3, "defensive").when(x < 2 * pitch.length / 3, "middle").when(x.isNotNull(), "final")


def in_final_third(x: Column, pitch: Pitch = FIFA) -> Column:
    return x >= 2 * pitch.length / 3


def in_own_third(x: Column, pitch: Pitch = FIFA) -> Column:
    return x < pitch.length / 3


def in_defending(x: Column, fraction: float, pitch: Pitch = FIFA) -> Column:
    return x < fraction * pitch.length


def in_box(x: Column, y: Column, pitch: Pitch = FIFA) -> Column:
    """Inside the attacked penalty area, its lines included."""
    return (x >= pitch.length - pitch.box_length) & (F.abs(y - pitch.width / 2) <= pitch.box_width / 2)


def progression(x: Column, y: Column, end_x: Column, end_y: Column, pitch: Pitch = FIFA) -> Column:
    """How much nearer to the goal centre the end is."""
    return goal_distance(x, y, pitch) - goal_distance(end_x, end_y, pitch)


def direction(x: Column, y: Column, end_x: Column, end_y: Column) -> Column:
    """forward, lateral or back by the angle to the attack; no movement is lateral."""
    dx, dy = end_x - x, end_y - y
    angle = F.degrees(F.atan2(F.abs(dy), dx))
    still = (dx == 0) & (dy == 0)
    label = F.when(still, "lateral").when(angle <= 90 - LATERAL_BAND_DEGREES, "forward").when(angle >= 90 + LATERAL_BAND_DEGREES, "back")
    return F.when(dx.isNotNull() & dy.isNotNull(), F.coalesce(label, F.lit("lateral")))


def nearest(x: Column, y: Column, points: Column) -> Column:
    """Distance to the nearest of an array of points; null without points."""
    return F.array_min(F.transform(points, lambda p: distance(x, y, p["x"], p["y"])))


def under_pressure(x: Column, y: Column, points: Column, radius: float = PRESSURE_RADIUS) -> Column:
    return nearest(x, y, points) <= radius


def within(x: Column, y: Column, points: Column, radius: float) -> Column:
    """How many points are within the radius; none without points."""
    return F.coalesce(F.size(F.filter(points, lambda p: distance(x, y, p["x"], p["y"]) <= radius)), F.lit(0))


def in_lane(x: Column, y: Column, points: Column, pitch: Pitch = FIFA) -> Column:
    """Points inside the triangle of the shot and the posts, its edges included; null without points."""
    goal, low, high = F.lit(float(pitch.length)), F.lit((pitch.width - GOAL_WIDTH) / 2), F.lit((pitch.width + GOAL_WIDTH) / 2)

    def side(p: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        return (ax - p["x"]) * (by - p["y"]) - (ay - p["y"]) * (bx - p["x"])

    def inside(p: Column) -> Column:
        sides = [side(p, x, y, goal, low), side(p, goal, low, goal, high), side(p, goal, high, x, y)]
        return ~(F.least(*sides) < 0) | ~(F.greatest(*sides) > 0)

    return F.when(F.size(points) > 0, F.size(F.filter(points, inside)))


def corner_flag_distance(x: Column, y: Column, pitch: Pitch = FIFA) -> Column:
    goal = F.lit(float(pitch.length))
    return F.least(distance(x, y, goal, F.lit(0.0)), distance(x, y, goal, F.lit(float(pitch.width))))


def touchline_distance(y: Column, pitch: Pitch = FIFA) -> Column:
    return F.least(F.abs(y), F.abs(pitch.width - y))


def is_corner_sentinel(x: Column, y: Column, pitch: Pitch = FIFA) -> Column:
    return x.isin(0.0, float(pitch.length)) & y.isin(0.0, float(pitch.width))


def shot_angle(x_m: Column, c_m: Column, goal_width_m: float = GOAL_WIDTH / 100) -> Column:
    """Opening angle in metres from the goal line and from the axis; 0 on or behind the line."""
    angle = F.atan2(goal_width_m * x_m, x_m * x_m + c_m * c_m - (goal_width_m / 2) ** 2)
    return F.when(x_m <= 0, 0.0).when(angle < 0, angle + F.pi()).otherwise(angle)


def logistic(z: Column) -> Column:
    """The logistic function without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def length_bucket(length: Column, buckets: list[tuple[str, float, float]]) -> Column:
    """The half-open bucket of a length; null if none holds it."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        out = F.when((length >= low) & (length < high), name).otherwise(out)
    return out


@dataclass(frozen=True)
class Grid:
    """Zones of the pitch, numbered row by row."""

    nx: int = 16
    ny: int = 12
    pitch: Pitch = FIFA

    def zone(self, x: Column, y: Column) -> Column:
        """The zone of a point, clamped to the grid after truncation towards zero."""
        ix = F.greatest(F.lit(0), F.least(F.lit(self.nx - 1), (x / self.pitch.length * self.nx).cast("int")))
        iy = F.greatest(F.lit(0), F.least(F.lit(self.ny - 1), (y / self.pitch.width * self.ny).cast("int")))
        return F.when(x.isNotNull() & y.isNotNull(), iy * self.nx + ix)

    def centre(self, zone: Column) -> tuple[Column, Column]:
        ix, iy = zone % self.nx, F.floor(zone / self.nx)
        return (ix + 0.5) * self.pitch.length / self.nx, (iy + 0.5) * self.pitch.width / self.ny

    def mirrored(self, zone: Column) -> Column:
        return ((self.ny - 1 - F.floor(zone / self.nx)) * self.nx + zone % self.nx).cast("int")


def box_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a box, 0 inside."""
    dx = F.greatest(x1 - px, F.lit(0.0), px - x2)
    dy = F.greatest(y1 - py, F.lit(0.0), py - y2)
    return F.sqrt(dx * dx + dy * dy)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap over union of boxes given as x, y, width, height; 0 where the union is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - wide * high
    return F.when(union <= 0, 0.0).otherwise(wide * high / union)


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography given as an array of rows."""
    at = lambda i: h[i][0] * x + h[i][1] * y + h[i][2]
    return at(0) / at(2), at(1) / at(2)


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its largest entry."""
    raised = let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return let(raised, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, w: s + w), lambda total: F.transform(r, lambda v: v / total)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays; 1 where exactly one has no length, 0 where neither has."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1 - dot(a, b) / (na * nb))


def saturated(x: Column, bound: float = 6.0) -> Column:
    return bound * F.tanh(x / bound)


def displacement(x: Column, y: Column, to_x: Column, to_y: Column, metres: tuple[float, float] = (105.0, 68.0)) -> tuple[Column, Column]:
    """A move between unit coordinates, in metres."""
    return (to_x - x) * metres[0], (to_y - y) * metres[1]


def slot_index(left_to_right: Column, role: Column) -> Column:
    """Side and role (1 to 13) to a slot; an error outside of them."""
    fine = left_to_right.isin(0, 1) & role.between(1, 13)
    return F.when(fine, left_to_right * 13 + role - 1).otherwise(F.raise_error(F.lit("side or role out of range")).cast("int"))


def slot_side_role(slot: Column) -> tuple[Column, Column]:
    return F.floor(slot / 13).cast("int"), (slot % 13 + 1).cast("int")


def inverse(h: Column) -> Column:
    """Inverse of a 3 by 3 array by cofactors; null where there is none."""
    minor = lambda a, b, c, d: h[a][b] * h[c][d] - h[a][d] * h[c][b]
    rows = [[minor(1, 1, 2, 2), -minor(0, 1, 2, 2), minor(0, 1, 1, 2)], [-minor(1, 0, 2, 2), minor(0, 0, 2, 2), -minor(0, 0, 1, 2)], [minor(1, 0, 2, 1), -minor(0, 0, 2, 1), minor(0, 0, 1, 1)]]
    det = h[0][0] * rows[0][0] + h[0][1] * rows[1][0] + h[0][2] * rows[2][0]
    return F.when(F.abs(det) > 1e-12, let(det, lambda d: F.array(*(F.array(*(v / d for v in row)) for row in rows))))


def reprojected(h: Column, points: list[tuple[float, float]], width: float, height: float, margin: float = 0.02) -> Column:
    """Pitch points back in the picture: those in front of the camera and within the frame and its margin, as an array."""
    edge = margin * max(width, height)
    marks = F.array(*(F.struct(F.lit(float(x)).alias("px"), F.lit(float(y)).alias("py")) for x, y in points))

    def place(inv: Column) -> Column:
        def one(p: Column) -> Column:
            at = lambda i: inv[i][0] * p["px"] + inv[i][1] * p["py"] + inv[i][2]
            return F.struct((at(0) / at(2)).alias("x"), (at(1) / at(2)).alias("y"))

        return F.transform(marks, one)

    depth = lambda x, y: h[2][0] * x + h[2][1] * y + h[2][2]
    ahead = F.signum(depth(F.lit(width / 2), F.lit(height)))
    inside = lambda p: p["x"].between(-edge, width + edge) & p["y"].between(-edge, height + edge) & (F.signum(depth(p["x"], p["y"])) == ahead)
    return let(inverse(h), lambda inv: F.filter(place(inv), inside))
