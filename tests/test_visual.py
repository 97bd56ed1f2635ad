"""Perceptual hashes, flashes, keyframes and pyramids against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest

from probanda.functions import colour
from probanda.operators import buffers, flashes, keyframes, perceptual, pyramid, scopes


# --- hashes ----------------------------------------------------------------

def line_weights(size, outs):
    m = np.zeros((outs, size))
    for o in range(outs):
        ratio = size / outs
        wide, middle = max(ratio, 1.0), (o + 0.5) * ratio
        for i in range(size):
            m[o, i] = max(0.0, 1 - abs(i + 0.5 - middle) / wide)
        m[o] /= m[o].sum()
    return m


def plain_hashes(v):
    h, w = v.shape
    small = {k: np.floor(np.round(line_weights(h, oh) @ v @ line_weights(w, ow).T, 6) + 0.5) for k, (ow, oh) in perceptual.SIDES.items()}
    a = small["a"] > small["a"].mean()
    d = small["d"][:, :-1] > small["d"][:, 1:]
    c = np.cos((2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 64)
    f = np.round(c @ small["p"] @ c.T, 6)
    p = f > sorted(f.ravel()[1:])[31]
    p[0, 0] = False
    code = lambda bits: sum(int(x) << i for i, x in enumerate(bits.ravel()))
    return tuple(x - (1 << 64) if x >> 63 else x for x in map(code, (a, d, p)))


def test_hashes_of_any_size(spark, monkeypatch):
    r = np.random.default_rng(2)
    pictures = [r.integers(0, 256, s).astype(float) for s in ((8, 8), (40, 50), (13, 7), (1, 1), (64, 3), (32, 32), (9, 70))] + [np.add.outer(np.arange(30.0), np.arange(41.0)) * 3]
    rows = [(i, p.shape[1], p.shape[0], y, x, float(p[y, x])) for i, p in enumerate(pictures) for y in range(p.shape[0]) for x in range(p.shape[1])]
    frame = spark.createDataFrame([*rows, (99, 2, 2, 0, 0, None)], "image int, width int, height int, y int, x int, v double")
    want = {i: plain_hashes(p) for i, p in enumerate(pictures)} | {99: (0, 0, 0)}
    assert {x[0]: tuple(x)[1:] for x in perceptual.hashes(frame).collect()} == want
    assert {x[0]: x[1] for x in perceptual.hashes(frame, "d").collect()} == {k: x[1] for k, x in want.items()}
    monkeypatch.setattr(perceptual, "SMALL", 0)
    assert {x[0]: tuple(x)[1:] for x in perceptual.hashes(frame).collect()} == want
    assert perceptual.hashes(frame.where("false")).count() == 0


# --- flashes ---------------------------------------------------------------

def plain_flashes(directions):
    """Change by change: an opposing change closes the pair that is pending."""
    pending, out = None, []
    for frame, d in directions:
        if pending and pending[0] == -d:
            out.append((pending[1], frame))
            pending = None
        else:
            pending = (d, frame - 1)
    return out


def test_pairs_of_changes(spark):
    r = random.Random(4)
    cells = {c: [(f, r.choice([1, -1])) for f in range(1, 60) if r.random() < 0.6] for c in range(60)}
    cells |= {100: [(1, 1)], 101: [(1, 1), (2, 1), (3, -1)], 102: [(1, 1), (2, -1), (3, 1), (4, -1)], 103: []}
    changes = spark.createDataFrame([("s", c, f, d) for c, x in cells.items() for f, d in x], "series string, cell int, frame long, direction int")
    got = sorted((x["cell"], x["start"], x["end"]) for x in flashes.flashes(changes).collect())
    assert got == sorted((c, a, b) for c, x in cells.items() for a, b in plain_flashes(x)) and len(got) > 300


def test_frames_and_segments_at_risk(spark):
    """Eight cells; the first five blink for two seconds at eight frames a second, the others stay."""
    light = [("s", c, f, (0.9 if f % 2 else 0.1) if c < 5 and f < 16 else 0.5) for c in range(8) for f in range(60)]
    light += [("calm", c, f, (0.6 if f % 6 == 0 else 0.2)) for c in range(4) for f in range(60)]
    light += [("dull", 0, f, None) for f in range(3)]
    cells = spark.createDataFrame(light, "series string, cell int, frame long, luminance double")
    found = flashes.flashes(flashes.luminance_changes(cells))
    frames = flashes.flashing_frames(found, cells, 8)
    pairs = plain_flashes([(f, 1 if f % 2 else -1) for f in range(1, 16)] + [(16, -1)])
    want = {f: sum(f - 8 < end <= f for _, end in pairs) for f in range(60)}
    got = {x["frame"]: x for x in frames.where("series = 's'").collect()}
    assert {f: x["peak"] for f, x in got.items()} == {f: n for f, n in want.items() if n}
    assert all(x["above"] == (0.625 if x["peak"] > 3 else 0) and x["near"] == (0.625 if x["peak"] >= 3 else 0) for x in got.values())
    risks = {x["series"]: x for x in flashes.risk_segments(frames).collect()}
    risky = [f for f, n in want.items() if n >= 3]
    assert set(risks) == {"s"} and (risks["s"]["verdict"], risks["s"]["start"], risks["s"]["end"], risks["s"]["peak"], risks["s"]["area"]) == ("FAIL", got[risky[0]]["start"], risky[-1], 4, 62.5)


def test_changes_that_count(spark):
    rows = [("s", 0, 0, 0.5), ("s", 0, 1, 0.59), ("s", 0, 2, 0.7), ("s", 0, 3, 0.95), ("s", 0, 4, 0.84), ("s", 0, 5, 0.1)]
    got = flashes.luminance_changes(spark.createDataFrame(rows, "series string, cell int, frame int, luminance double")).collect()
    assert [(x["frame"], x["direction"]) for x in sorted(got)] == [(2, 1), (3, 1), (5, -1)]
    red = [("s", 0, 0, 0.0, 0.0, 0.0), ("s", 0, 1, 1.0, 0.0, 0.0), ("s", 0, 2, 1.0, 0.9, 0.9), ("s", 0, 3, 0.3, 0.3, 0.3), ("s", 0, 4, 0.33, 0.03, 0.03), ("s", 0, 5, 0.3, 0.03, 0.03)]
    got = flashes.red_changes(spark.createDataFrame(red, "series string, cell int, frame int, red double, green double, blue double")).collect()
    assert [(x["frame"], x["direction"]) for x in sorted(got)] == [(1, 1), (2, -1), (4, 1)]


# --- keyframes -------------------------------------------------------------

def test_best_parting_among_all():
    r = np.random.default_rng(6)
    for n in (1, 2, 3, 5, 8, 10, 11):
        for penalty in (0.001, 0.02, 0.15, 3.0):
            bins = np.abs(r.normal(size=(n, 6)) * 0.1 + np.repeat(r.normal(size=(n // 3 + 1, 6)), 3, 0)[:n])
            bins /= bins.sum(1, keepdims=True)

            def cost(ends, bins=bins, penalty=penalty):
                return sum(((bins[a:b] - bins[a:b].mean(0)) ** 2).sum() + penalty for a, b in zip((0, *ends[:-1]), ends, strict=True))

            best = min(cost((*c, n)) for k in range(n) for c in itertools.combinations(range(1, n), k))
            assert math.isclose(cost(tuple(keyframes.best_cuts(bins, penalty))), best, abs_tol=1e-9)


def test_shots_and_repeated_keyframes(spark):
    a, b = [1.0] + [0.0] * 23, [0.0] * 23 + [1.0]
    near = [0.995, 0.005] + [0.0] * 22
    rows = [("v", i, h, p, p, d) for i, (h, p, d) in enumerate([(a, 0, "a")] * 4 + [(b, -1, "b")] * 3 + [(near, 3, "c")] * 5 + [(near, 255, "d")] * 0)] + [("w", 0, a, 0, 0, "a"), ("w", 1, None, 0, 0, "x")]
    frames = spark.createDataFrame(rows, "series string, at int, hist array<double>, phash long, dhash long, digest string")
    got = sorted(tuple(x) for x in keyframes.keyframes(frames, 2.0).collect())
    assert got == [("v", 0, 0, 3, 0.0, 2.0, 1, 1), ("v", 1, 4, 6, 2.0, 3.5, 5, 5), ("v", 2, 7, 11, 3.5, 6.0, 9, 1), ("w", 0, 0, 0, 0.0, 0.5, 0, 0)]
    assert sorted(x["keyframe"] for x in keyframes.keyframes(frames, 2.0, bits=1).where("series = 'v'").collect()) == [1, 5, 9]
    assert keyframes.keyframes(frames.where("false"), 1.0).count() == 0


# --- pyramids --------------------------------------------------------------

def cells_of(spark, pairs):
    rows = [(i, x, y, float(b[y, x]), float(c[y, x])) for i, (b, c) in enumerate(pairs) for y in range(b.shape[0]) for x in range(b.shape[1])]
    return spark.createDataFrame(rows, "image int, x int, y int, b double, c double")


def laplacian(v):
    return np.abs(4 * v[1:-1, 1:-1] - v[:-2, 1:-1] - v[2:, 1:-1] - v[1:-1, :-2] - v[1:-1, 2:])


def test_levels_and_profiles_against_arrays(spark):
    r = np.random.default_rng(9)
    b, c = r.random((13, 18)), r.random((13, 18))
    cells = cells_of(spark, [(b, c)])
    got = {x["level"]: x for x in pyramid.levels(cells).collect()}
    for k in range(4):
        n = 1 << k
        parts = [(b[y : y + n, x : x + n], c[y : y + n, x : x + n]) for y in range(0, 13, n) for x in range(0, 18, n)]
        assert got[k]["squares"] == len(parts)
        assert got[k]["difference"] == pytest.approx(sum(abs(q.mean() - p.mean()) * p.size for p, q in parts) / b.size)
    tiles = {(x["tx"], x["ty"]): x for x in pyramid.tile_profiles(cells, 5).collect()}
    assert len(tiles) == 12
    for (tx, ty), t in tiles.items():
        p, q = (v[5 * ty : 5 * ty + 5, 5 * tx : 5 * tx + 5] for v in (b, c))
        half = 1.96 * np.sqrt((q - p).var(ddof=1) / p.size) if p.size > 1 else 0
        assert (t["pixels"], t["shift"], t["low"]) == (p.size, pytest.approx((q - p).mean()), pytest.approx((q - p).mean() - half))
        assert t["variance_ratio"] == pytest.approx(q.var() / p.var())
        assert t["b_contrast"] == pytest.approx(p.std() / max(p.mean(), 0.02))
        if min(p.shape) > 2 and 5 * tx + 5 <= 18 and 5 * ty + 5 <= 13:
            assert t["detail_ratio"] == pytest.approx(laplacian(q).mean() / laplacian(p).mean())
    whole = pyramid.change_classes(cells, 5).first()
    assert whole["detail_ratio"] == pytest.approx(laplacian(c).mean() / laplacian(b).mean())


def test_shift_of_just_the_limit_is_summed_line_by_line(spark):
    b, c = np.array([[0.5604, 0.52], [0.5088, 0.5708]]), np.array([[0.5906, 0.53], [0.5132, 0.6062]])
    cells = cells_of(spark, [(b, c)])
    for order in (("x", "y"), ("y", "x")):
        t = pyramid.tile_profiles(cells.repartition(1).sortWithinPartitions(*order), 2).first()
        assert t["shift"] == (0.5906 + 0.53 + 0.5132 + 0.6062) / 4 - (0.5604 + 0.52 + 0.5088 + 0.5708) / 4 and not t["shifted"]


def test_kinds_of_change(spark):
    r = np.random.default_rng(1)
    b = np.round(r.random((32, 32)) * 0.3 + 0.4, 4)
    noise = b + 0.01 * (np.indices(b.shape).sum(0) % 2 * 2 - 1)
    region = b.copy()
    region[:, :8] += 0.1
    corner = b.copy()
    corner[:4, :4] += 0.1
    got = {x["image"]: x for x in pyramid.change_classes(cells_of(spark, [(b, b), (b, noise), (b, region), (b, corner)]), 4).collect()}
    assert [got[i]["class"] for i in range(4)] == ["identical", "texture_noise_only", "systematic_shift", "texture_noise_only"]
    assert got[2]["regions"] == 1 and got[2]["shifted"] == 16 and got[3]["shifted"] == 1 and got[1]["coarse"] == pytest.approx(0, abs=1e-9)
    gaps = cells_of(spark, [(b, b + 1e-4)]).withColumn("gap_b", pyramid.F.lit(False)).withColumn("gap_c", pyramid.F.col("x") < 8)
    assert pyramid.change_classes(gaps, 4).first()["class"] == "systematic_shift"
    assert pyramid.change_classes(gaps.where("false"), 4).count() == 0


# --- colours ---------------------------------------------------------------

#: The published test pairs of CIEDE2000 (fixed values): two CIELAB colours and their difference.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, 2.8361, -74.02, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
    (50.0, -1.1848, -84.8006, 50.0, 0.0, -82.7485, 1.0),
    (50.0, -0.9009, -85.5211, 50.0, 0.0, -82.7485, 1.0),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.001, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0012, 7.2195),
    (50.0, -0.001, 2.49, 50.0, 0.0009, -2.49, 4.8045),
    (50.0, -0.001, 2.49, 50.0, 0.001, -2.49, 4.8045),
    (50.0, -0.001, 2.49, 50.0, 0.0011, -2.49, 4.7461),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 61.0, -5.0, 29.0, 22.8977),
    (50.0, 2.5, 0.0, 56.0, -27.0, -3.0, 31.903),
    (50.0, 2.5, 0.0, 58.0, 24.0, 15.0, 19.4535),
    (50.0, 2.5, 0.0, 50.0, 3.1736, 0.5854, 1.0),
    (50.0, 2.5, 0.0, 50.0, 3.2972, 0.0, 1.0),
    (50.0, 2.5, 0.0, 50.0, 1.8634, 0.5757, 1.0),
    (50.0, 2.5, 0.0, 50.0, 3.2592, 0.335, 1.0),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (63.0109, -31.0961, -5.8663, 62.8187, -29.7946, -4.0864, 1.263),
    (61.2901, 3.7196, -5.3901, 61.4292, 2.248, -4.962, 1.8731),
    (35.0831, -44.1164, 3.7933, 35.0232, -40.0716, 1.5901, 1.8645),
    (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373),
    (36.4612, 47.858, 18.3852, 36.2715, 50.5065, 21.2231, 1.4146),
    (90.8027, -2.0831, 1.441, 91.1528, -1.6435, 0.0447, 1.4441),
    (90.9257, -0.5406, -0.9208, 88.6381, -0.8985, -0.7239, 1.5381),
    (6.7747, -0.2908, -2.4247, 5.8714, -0.0985, -2.2286, 0.6377),
    (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_published_pairs_of_ciede2000(spark):
    names = ["l1", "a1", "b1", "l2", "a2", "b2"]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, " + ", ".join(f"{n} double" for n in [*names, "want"]))
    there = colour.with_ciede2000(rows, names[:3], names[3:], "d")
    back = colour.with_ciede2000(rows, names[3:], names[:3], "d")
    assert there.columns == [*rows.columns, "d"]
    for df in (there, back):
        assert all(round(x["d"], 4) == x["want"] for x in df.collect())


def test_light_and_eyes(spark):
    F = colour.F
    v = spark.createDataFrame([(0.0,), (0.04,), (0.2,), (0.735,), (1.0,)], "v double")
    got = v.select("v", colour.linear_light(F.col("v")).alias("l"), colour.encoded(colour.linear_light(F.col("v"))).alias("e"), colour.quantized(colour.light_of(F.col("v"))).alias("q")).collect()
    assert all(x["e"] == pytest.approx(x["v"], abs=1e-9) and x["q"] == pytest.approx(x["v"], abs=1e-6) for x in got) and got[2]["l"] == pytest.approx(0.0331047666)
    white = spark.createDataFrame([(1.0, 1.0, 1.0)], "r double, g double, b double")
    lab = colour.with_lab(white, ["r", "g", "b"], ["l", "a", "bb"]).first()
    assert (lab["l"], lab["a"], lab["bb"]) == (pytest.approx(100), pytest.approx(0, abs=0.02), pytest.approx(0, abs=0.02))
    # Rows of a simulation's matrix sum to one, so grey stays grey; red and green come near each other for a protan eye.
    for kind in colour.DEFICIENCIES:
        assert list(white.select(*colour.simulated(kind, [F.lit(0.4)] * 3)).first()) == pytest.approx([0.4] * 3, abs=1e-5)
    itp = colour.with_ictcp(spark.createDataFrame([(0.5, 0.5, 0.5), (2.0, 0.0, 0.0)], "r double, g double, b double"), ["r", "g", "b"], ["i", "t", "p"]).collect()
    assert itp[0]["i"] == pytest.approx(0.5, abs=1e-6) and itp[0]["t"] == pytest.approx(0, abs=1e-6) and itp[1]["i"] is None
    apart = spark.createDataFrame([(0.5, 0.1, 0.2, 0.4, 0.3, 0.2)], "a double, b double, c double, d double, e double, f double")
    assert apart.select(colour.itp_difference(["a", "b", "c"], ["d", "e", "f"])).first()[0] == pytest.approx(720 * math.sqrt(0.01 + 0.25 * 0.04))


# --- buffers ---------------------------------------------------------------

def unfolded(v):
    """The octahedral point of a unit vector, as shares of 0 to 1."""
    v = np.asarray(v, float) / np.abs(v).sum()
    x, y = v[:2] if v[2] >= 0 else (1 - np.abs(v[1::-1])) * np.where(v[:2] >= 0, 1, -1)
    return [float(x / 2 + 0.5), float(y / 2 + 0.5)]


def test_errors_by_kind(spark):
    r = np.random.default_rng(7)
    rows, want = [], []
    for _ in range(40):
        a, b = r.normal(size=3), r.normal(size=3)
        angle = math.degrees(math.acos(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1)))
        rows += [("normal", "oct", None, unfolded(a), unfolded(b)), ("normal", None, None, (a / 4 + 0.5).tolist(), (b / 9 + 0.5).tolist())]
        want += [angle, angle]
    rows += [("depth", "reverse_z", None, [0.75], [0.5]), ("depth", None, None, [2.0], [2.25]), ("motion", None, 10.0, [0.5, 0.5], [0.65, 0.7]), ("id", None, None, [1.0, 2.0], [1.0, 2.0]), ("mask", None, None, [1.0], [0.0]), ("normal", None, None, [0.2, 0.7, 0.1], [0.2, 0.7, 0.1])]
    want += [0.25, 0.25, 5.0, 0.0, 1.0, 0.0]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, kind string, encoding string, scale double, b array<double>, c array<double>")
    got = {x["i"]: x for x in buffers.errors(frame).collect()}
    assert [got[i]["error"] for i in range(len(rows))] == pytest.approx(want, abs=1e-6)
    assert got[80]["relative"] == 1.0 and got[81]["relative"] == 0.125 and got[82]["relative"] is None


def test_validity_and_odd_samples(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", "depth", [0.5], [0.6], True, True), ("a", "depth", [0.5], [0.9], True, False), ("a", "depth", [0.5], [0.9], False, True), ("a", "depth", [0.5], [0.9], False, None), ("a", "depth", None, [0.1], True, True),
            ("b", "depth", [inf], [inf], True, True), ("b", "depth", [0.1], [nan], True, True), ("c", "normal", [0.5, 0.5, 0.5], [1.0, 0.5, 0.5], True, True), ("d", "speed", [1.0], [2.0], True, True), ("e", "id", [1.0], [1.0], True, True), ("f", "depth", [0.5], [0.505], True, True)]
    frame = spark.createDataFrame(rows, "g string, kind string, b array<double>, c array<double>, valid_b boolean, valid_c boolean").withColumns({"encoding": buffers.F.lit(None).cast("string"), "scale": buffers.F.lit(None).cast("double")})
    got = {x["g"]: x for x in buffers.summaries(frame, ["g"]).collect()}
    a = got["a"]
    assert (a["compared"], a["only_b"], a["only_c"], a["neither"], a["odd"], a["status"]) == (1, 1, 2, 1, 0, "fail") and a["mean"] == pytest.approx(0.1) and a["above"] == 1.0
    assert [got[g]["odd"] for g in "bcd"] == [2, 1, 1] and {got[g]["status"] for g in "bcd"} == {"unknown"}
    assert got["e"]["status"] == got["f"]["status"] == "pass" and got["e"]["changed"] == 0
    assert {x["g"]: x["status"] for x in buffers.summaries(frame, ["g"], {"depth": 0.2}).collect()}["a"] == "pass"
    assert buffers.summaries(frame.where("false"), ["g"]).count() == 0


# --- scopes ----------------------------------------------------------------

def test_inside_outside_and_boundary(spark):
    """A picture of 150 x 140, so that boxes span several squares; against sets of pixels."""
    w, h = 150, 140
    boxes = {1: [(60, 50, 70, 30), (100, 70, 40, 60)], 2: [(0, 0, 10, 10)], 3: [(140, 0, 20, 5)], 4: []}
    changed = {1: {(61, 51), (139, 129)}, 2: {(9, 9), (10, 9)}, 3: set(), 4: {(0, 0)}}
    cells = spark.range(w * h).selectExpr(f"int(id % {w}) x", f"int(id div {w}) y").crossJoin(spark.createDataFrame([(i,) for i in boxes], "image int"))
    dots = spark.createDataFrame([(i, x, y) for i, s in changed.items() for x, y in s], "image int, x int, y int").withColumn("after", scopes.F.lit(2))
    cells = cells.join(dots, ["image", "x", "y"], "left").selectExpr("image", "x", "y", "1 as before", "coalesce(after, 1) as after", "if(after is null, 0.0D, 0.5D) as error")
    frame = spark.createDataFrame([(i, *b) for i, v in boxes.items() for b in v], "image int, x int, y int, w int, h int")
    got = {r["image"]: r for r in scopes.localized(cells, frame).collect()}
    for i, v in boxes.items():
        ins = {(x, y) for bx, by, bw, bh in v for x in range(bx, min(bx + bw, w)) for y in range(by, min(by + bh, h))}
        edge = {(x, y) for x in range(w) for y in range(h) for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if 0 <= q[0] < w and 0 <= q[1] < h and (q in ins) != ((x, y) in ins)}
        r = got[i]
        assert (r["inside_pixels"], r["outside_pixels"], r["boundary_pixels"]) == (len(ins), w * h - len(ins), len(edge))
        assert (r["inside_changed"], r["outside_changed"], r["boundary_changed"]) == (len(changed[i] & ins), len(changed[i] - ins), len(changed[i] & edge))
    assert [got[i]["verdict"] for i in boxes] == ["preserved", "collateral_change", "invalid_region", "invalid_region"]
    assert {r["image"]: r["verdict"] for r in scopes.localized(cells, frame, 0.6).collect()}[2] == "preserved"


def test_tile_trees(spark):
    files = lambda *p: spark.createDataFrame([(x, d) for x, d in p], "path string, digest string")
    a = files(("1/0/0.png", "a"), ("1/1/1.jpg", "b"), ("2/3/3.webp", "c"), ("1/2/0.png", "d"), ("1/0/x.png", "e"), ("2/0/0.png", "f"), ("2/0/0.jpg", "g"), ("0/0/0.png", None), (None, "z"))
    assert sorted((str(x["path"]), x["problem"]) for x in scopes.tile_keys(a).collect() if x["problem"]) == [("1/0/x.png", "malformed"), ("1/2/0.png", "out_of_range"), ("2/0/0.jpg", "repeated"), ("2/0/0.png", "repeated"), ("None", "malformed")]
    b = files(("1/0/0.jpg", "a"), ("1/1/0.png", "q"), ("2/3/3.png", "C"), ("0/0/0.png", None))
    got = {x["z"]: tuple(x)[1:] for x in scopes.tile_coverage(a, b).collect()}
    assert got == {0: (1, 1, 1, 0, 0, 0, 1.0, "identical"), 1: (2, 2, 1, 1, 1, 0, 0.5, "changed"), 2: (1, 1, 1, 0, 0, 1, 1.0, "changed")}


def test_sources_and_answers(spark):
    from probanda.functions import scalars as S

    rows = spark.createDataFrame([("human", "yes"), (" Human:Ann ", "unsure"), ("humanoid", "needs_human"), ("model", None), (None, "Unsure")], "s string, a string")
    assert [tuple(x) for x in rows.select(S.is_human(colour.F.col("s")), S.is_abstention(colour.F.col("a"))).collect()] == [(True, False), (True, True), (False, True), (False, False), (False, False)]


def test_small_images_are_rows_of_one_shuffle(spark, monkeypatch):
    """Small images meet no table of weights: their pixels are shuffled once, and the codes are those of the joins."""
    r = np.random.default_rng(5)
    rows = [(i, 8, 8, y, x, float(r.integers(0, 256))) for i in range(30) for y in range(8) for x in range(8)] + [(40, 8, 8, 1, 1, None)]
    frame = spark.createDataFrame(rows, "image int, width int, height int, y int, x int, v double")
    packed = perceptual.hashes(frame)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    monkeypatch.setattr(perceptual, "PACKED", 0)
    assert sorted(packed.collect()) == sorted(perceptual.hashes(frame).collect())


def test_images_that_are_rows_are_not_shuffled(spark, monkeypatch):
    """Only ids move: the codes are those of the pixels, with nulls, short rows, repeated images and large ones."""
    r = np.random.default_rng(6)
    rows = [(i, 8, 8, [float(x) for x in r.integers(0, 256, 64)]) for i in range(30)] + [(40, 8, 8, [None, 9.0, 4.0]), (41, 5, 3, [float(x) for x in range(20)]), (42, 8, 8, None), (43, 8, 8, []), (3, 8, 8, [7.0] * 64), (44, 2, 2, [None] * 4)]
    frame = spark.createDataFrame([*rows, (50, 40, 33, [float(x % 251) for x in range(1320)])], "image int, width int, height int, values array<double>")
    pixels = frame.select("image", "width", "height", colour.F.posexplode("values").alias("at", "v")).selectExpr("image", "width", "height", "int(at div width) AS y", "at % width AS x", "v")
    want = sorted(perceptual.hashes(pixels).collect())
    assert sorted(perceptual.line_hashes(frame).collect()) == want and len(want) == 34
    monkeypatch.setattr(perceptual, "SMALL", 0)
    assert sorted(perceptual.line_hashes(frame, "dp").collect()) == sorted(perceptual.hashes(pixels, "dp").collect())
    single = perceptual.line_hashes(frame.where("image between 10 and 44"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString() and single.count() == 23
