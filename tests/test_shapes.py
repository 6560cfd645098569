"""Growth, thinning, distances and thresholds on masks against plain loops, over tiles of several sizes."""

import math
import random
from collections import deque

import numpy as np
import pytest

from mensura.operators import networks, regions, splitting, tiles, voxels


def blobs(seed, height=40, width=50, discs=14):
    draw, found = random.Random(seed), set()
    for _ in range(discs):
        cy, cx, r = draw.randrange(height), draw.randrange(width), draw.choice((2, 3, 4, 6))
        found |= {(y, x) for y in range(max(0, cy - r), min(height, cy + r + 1)) for x in range(max(0, cx - r), min(width, cx + r + 1)) if (y - cy) ** 2 + (x - cx) ** 2 <= r * r}
    return found


def frame(spark, masks):
    return spark.createDataFrame([(i, y, x) for i, m in masks.items() for y, x in sorted(m)], "image long, y long, x long")


def flood(mask, seeds, steps):
    """Nearest seed of every place by breadth; ties to the least label."""
    out = {}
    for label in sorted(set(seeds.values())):
        far = {p: 0.0 for p, s in seeds.items() if s == label and p in mask}
        waiting = deque(far)
        while waiting:
            p = waiting.popleft()
            for dy, dx, w in steps:
                q = (p[0] + dy, p[1] + dx)
                if q in mask and far[p] + w < far.get(q, math.inf) - 1e-9:
                    far[q] = far[p] + w
                    waiting.append(q)
        for p, v in far.items():
            if p not in out or v < out[p][1] - 1e-9:
                out[p] = (label, v)
    return out


@pytest.mark.parametrize(("tile", "neighbours"), [(8, 4), (7, 8), (256, 4)])
def test_growth(spark, tile, neighbours):
    masks = {1: blobs(1), 2: {(y, x) for y in range(-6, 20) for x in range(20) if y % 4 == 0 or (x == 19 if y % 8 < 4 else x == 0)}}
    draw = random.Random(tile)
    seeds = {i: {p: draw.randrange(5) for p in draw.sample(sorted(m), 4)} for i, m in masks.items()}
    rows = [(i, y, x, s) for i, own in seeds.items() for (y, x), s in own.items()] + [(1, 999, 999, 7), (2, None, 3, 1)]
    got = tiles.grown(frame(spark, masks), spark.createDataFrame(rows, "image long, y long, x long, label long"), neighbours, tile=tile).collect()
    steps = tiles._CROSS if neighbours == 4 else tiles._AROUND
    want = {(i, *p): v for i, m in masks.items() for p, v in flood(m, seeds[i], steps).items()}
    found = {(r.image, r.y, r.x): (r.label, r.distance) for r in got}
    assert found.keys() == want.keys() and len(found) == len(got)
    assert all(found[k][0] == v[0] and found[k][1] == pytest.approx(v[1]) for k, v in want.items())


def thin(mask):
    mask = set(mask)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(mask)
        for odd in (True, False):
            gone = []
            for y, x in mask:
                n = [(y + dy, x + dx) in mask for dy, dx in ring]
                up, right, down, left = n[0], n[2], n[4], n[6]
                turns = sum(not a and b for a, b in zip(n, n[1:] + n[:1]))
                corner = not (up and right and down) and not (right and down and left) if odd else not (up and right and left) and not (up and down and left)
                if 2 <= sum(n) <= 6 and turns == 1 and corner:
                    gone.append((y, x))
            mask -= set(gone)
        if len(mask) == before:
            return mask


@pytest.mark.parametrize(("tile", "margin"), [(9, 4), (16, 2), (256, 16)])
def test_thinning(spark, tile, margin):
    masks = {1: blobs(4), 2: {(y, x) for y in range(30) for x in range(30)}, 3: {(0, 0)}, 4: {(y, x) for y in range(5) for x in range(60)}}
    got = {(r.image, r.y, r.x) for r in tiles.thinned(frame(spark, masks), tile=tile, margin=margin).collect()}
    assert got == {(i, *p) for i, m in masks.items() for p in thin(m)}


def test_tortuosity(spark):
    arch = {(y, 0) for y in range(10)} | {(0, x) for x in range(12)} | {(y, 11) for y in range(10)}
    line, dot = {(3, x) for x in range(8)}, {(5, 5)}
    rows = [(1, label, y, x) for label, m in ((1, arch), (2, line), (3, dot)) for y, x in m]
    got = {r.label: r for r in tiles.tortuosity(spark.createDataFrame(rows, "image long, label long, y long, x long"), tile=6).collect()}
    assert got[2].tortuosity == pytest.approx(1) and got[2].ends == 2
    assert got[3].tortuosity == 1 and got[3].ends == 0 and got[3].arc is None
    skeleton = thin(arch)
    ends = sorted(p for p in skeleton if sum((p[0] + a, p[1] + b) in skeleton for a, b, _ in tiles._AROUND) == 1)
    arc = flood(skeleton, {ends[0]: 0}, tiles._AROUND)[ends[1]][1]
    assert len(ends) == 2 and got[1].tortuosity == pytest.approx(arc / math.dist(*ends)) and got[1].tortuosity > 2
    empty = spark.createDataFrame([], "image long, label long, y long, x long")
    assert tiles.tortuosity(empty).collect() == []


def test_distance_transform(spark):
    masks = {1: blobs(7), 2: {(y, x) for y in range(40) for x in range(50)}, 3: {(y, x) for y in range(40) for x in range(50)} - {(0, 0)}, 4: {(y, x) for y in range(40) for x in range(50)} - {(7, 9), (7, 30), (33, 20)}}
    got = tiles.distance_transform(frame(spark, masks), 50, 40).collect()
    for i, mask in masks.items():
        back = np.array(sorted({(y, x) for y in range(40) for x in range(50)} - mask))
        own = {(r.y, r.x): r for r in got if r.image == i}
        assert own.keys() == mask
        for (y, x), r in own.items():
            if not len(back):
                assert r.square is None and r.edge_y is None
                continue
            square = ((back - (y, x)) ** 2).sum(axis=1).min()
            assert r.square == square == (r.edge_y - y) ** 2 + (r.edge_x - x) ** 2 and (r.edge_y, r.edge_x) not in mask
    assert tiles.distance_transform(frame(spark, {}), 5, 5).collect() == []


def components(mask):
    out = {}
    for start in sorted(mask):
        if start not in out:
            out[start], waiting = start, [start]
            while waiting:
                y, x = waiting.pop()
                for dy, dx, _ in tiles._AROUND:
                    q = (y + dy, x + dx)
                    if q in mask and q not in out:
                        out[q] = start
                        waiting.append(q)
    return out


def test_separation(spark):
    mask = blobs(11, discs=25)
    core = {p for p in mask if all((p[0] + a, p[1] + b) in mask for a, b, _ in tiles._AROUND)}
    seeds = {p: y * 50 + x for p, (y, x) in components(core).items()}
    sizes = {s: sum(v == s for v in seeds.values()) for s in seeds.values()}
    kept = {p: s for p, (s, _) in flood(mask, seeds, tiles._CROSS).items() if 4 < sizes[s] < 60}
    parts = components(set(kept))
    got = voxels.separated(frame(spark, {5: mask}), 50, 40, 4, 60).collect()
    assert len(got) == len(kept) > 0
    assert all(kept[r.y, r.x] == r.seed and r.label == parts[r.y, r.x][0] * 50 + parts[r.y, r.x][1] for r in got)


def test_adaptive_threshold(spark):
    draw = np.random.default_rng(2)
    image = draw.integers(0, 256, (23, 31))
    rows = [(1, y, x, int(image[y, x])) for y in range(23) for x in range(31)]
    pixels = spark.createDataFrame(rows, "image long, y long, x long, v long")
    for block, less in ((3, 2), (11, 0), (61, -3.5)):
        reach = block // 2
        wide = np.pad(image, reach, mode="edge")
        windows = np.lib.stride_tricks.sliding_window_view(wide, (block, block))
        sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
        bell = np.exp(-(np.arange(-reach, reach + 1.0) ** 2) / (2 * sigma**2))
        means = {"mean": np.rint(windows.sum(axis=(2, 3)) / block**2), "gaussian": np.rint(np.einsum("yxab,a,b->yx", windows, bell / bell.sum(), bell / bell.sum()))}
        for method, mean in means.items():
            got = {(r.y, r.x) for r in voxels.adaptive(pixels, "v", block, less, method).collect()}
            assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(image > mean - math.ceil(less)))))
    with pytest.raises(ValueError):
        voxels.adaptive(pixels, "v", 4, 0)


def test_adaptive_threshold_over_tiles(spark):
    # images that start anywhere, lie across tiles or end at their sides, in rows of any order
    draw = np.random.default_rng(3)
    images = {k: (y0, x0, draw.integers(0, 256, shape)) for k, (y0, x0, shape) in enumerate([(250, 248, (14, 16)), (-3, 510, (12, 9)), (256, 0, (4, 256)), (7, 7, (1, 1))])}
    rows = [(k, y0 + y, x0 + x, int(image[y, x])) for k, (y0, x0, image) in images.items() for y in range(image.shape[0]) for x in range(image.shape[1])]
    pixels = spark.createDataFrame([rows[i] for i in draw.permutation(len(rows))], "image int, y int, x long, v long").repartition(3)
    wanted = set()
    for k, (y0, x0, image) in images.items():
        means = np.rint(np.lib.stride_tricks.sliding_window_view(np.pad(image, 4, mode="edge"), (9, 9)).sum(axis=(2, 3)) / 81)
        wanted |= {(k, y0 + y, x0 + x) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(image > means - 1)))}
    got = voxels.adaptive(pixels, "v", 9, 1)
    assert {tuple(r) for r in got.collect()} == wanted and got.dtypes == [("image", "int"), ("y", "int"), ("x", "bigint")]


def test_debris(spark):
    image = np.full((40, 40), 10)
    image[10:13, 10:13] = 200  # a spot
    image[30:31, 30:31] = 200  # too small
    image[0:6, 20:26] = 200  # cut off by the edge
    pixels = spark.createDataFrame([(1, y, x, int(image[y, x])) for y in range(40) for x in range(40)] + [(2, y, x, 7) for y in range(4) for x in range(4)], "image long, y long, x long, v long")
    got = {(r.image, r.y, r.x) for r in voxels.debris(pixels, "v", 40, 40, 3.0, 4, 100, 2).collect()}
    disc = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
    assert got == {(1, y + a, x + b) for y in range(10, 13) for x in range(10, 13) for a, b in disc}


def test_branches(spark):
    ring = {(y, x) for y in range(10, 16) for x in range(10, 16) if y in (10, 15) or x in (10, 15)} - {(10, 10), (10, 15), (15, 10), (15, 15)}
    cross = {(20, x) for x in range(20, 31)} | {(y, 25) for y in range(21, 28)}
    line = {(2, x) for x in range(3, 9)}
    got = networks.branches(frame(spark, {1: ring | cross | line, 2: {(0, 0), (5, 5)}}), 64).collect()
    assert all(r.image == 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.network, []).append((r.kind, r.places, round(r.length, 4), round(r.span, 4)))
    assert by[2 * 64 + 3] == [(0, 6, 5.0, 5.0)]
    assert by[10 * 64 + 11] == [(3, 16, round(12 + 4 * math.sqrt(2), 4), 0.0)]
    # the crossing has four junctions about its middle
    assert sorted(k for k, *_ in by[20 * 64 + 20]) == [1, 1, 1] and sum(p for _, p, *_ in by[20 * 64 + 20]) == len(cross) - 4
    assert networks.branches(frame(spark, {}), 64).collect() == []


def test_network_summary(spark):
    mask = {(y, x) for y in range(10, 15) for x in range(5, 50)} | {(y, x) for y in range(10, 38) for x in range(25, 30)} | {(36, x) for x in range(2, 12)}
    got = networks.network_summary(tiles.thinned(frame(spark, {3: mask})), frame(spark, {3: mask}), 50, 40).first()
    assert (got.individuals, got.networks, got.kind0) == (1, 1, 1) and got.kind1 == 3
    assert got.individual_length_mean == 9 and got.individual_width_mean == 2 and 3 < got.network_width_median <= 6
    assert got.network_share == pytest.approx(1 - 1 / (got.kind0 + got.kind1 + got.kind2 + got.kind3))


def test_recovery(spark):
    rows = [(1, y, x, 9 if 4 <= y <= 6 and 4 <= x <= 6 else 5 if 2 <= y <= 8 and 2 <= x <= 8 else 5 if 20 <= y < 23 and 20 <= x < 24 else 0) for y in range(30) for x in range(30)]
    pixels = spark.createDataFrame(rows, "image long, y long, x long, v long")
    cells = pixels.select("image", "y", "x")
    tree = {(r.threshold, r.label): (r.area, r.parent) for r in networks.component_tree(pixels, "v", [8, 3], 30).collect()}
    assert tree == {(3.0, 62): (49, None), (3.0, 620): (12, None), (8.0, 124): (9, 62)}
    got = networks.recovered(pixels, "v", [8, 3], cells, 30, 30, largest=1, reach=1).collect()
    high, low = ({(r.y, r.x) for r in got if r.threshold == t} for t in (8, 3))
    cross = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    taken = {(y, x) for y in range(4, 7) for x in range(4, 7)}
    assert high == {(y + a, x + b) for y, x in taken for a, b in cross}
    # the rest of the object is a ring about what the disc has taken, whose hole is filled
    assert low == {(y + a, x + b) for y in range(2, 9) for x in range(2, 9) for a, b in cross}


def test_gluing_follows_the_rules_one_region_after_the_other(spark):
    draw = random.Random(5)
    own = {}
    for label in range(1, 60):
        y, x = draw.randrange(40), draw.randrange(40)
        for _ in range(draw.choice((1, 3, 6, 25))):
            own.setdefault((y, x), label)
            y, x = y + draw.choice((-1, 0, 1)), x + draw.choice((-1, 0, 1))
    places = {}
    for p, label in own.items():
        places.setdefault(label, []).append(p)
    small = {k for k, ps in places.items() if 1 < len(ps) < 10}
    parent = {k: k for k in places}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    rules = set()
    for k in small:
        ys, xs = [p[0] for p in places[k]], [p[1] for p in places[k]]
        near = {own.get((y + dy, x + dx)) for y, x in places[k] for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 9 and min(ys) <= y + dy <= max(ys) and min(xs) <= x + dx <= max(xs)} - {k, None}
        few = near & small
        joined = near if len(near) == 1 else few if len(few) > 1 else set()
        rules.add((min(len(near), 2), bool(joined)))
        for other in joined:
            a, b = sorted((root(k), root(other)))
            parent[b] = a
    assert len(rules) == 4
    rows = [(i, y, x, label) for i in (1, 2) for (y, x), label in own.items()]
    got = regions.glued(spark.createDataFrame(rows + rows[:5], "image long, y long, x long, label long"), 1, 10).collect()
    assert {(r.image, r.label): r.glued for r in got} == {(i, k): root(k) for i in (1, 2) for k in places} and len(got) == 2 * len(places)


def test_distances_to_the_inscribed_circle(spark):
    cell = {(y, x) for y in range(1, 10) for x in range(1, 10)}
    cells = frame(spark, {1: cell, 2: cell})
    spots = spark.createDataFrame([(1, 5, 5, 1), (1, 5, 9, 2), (1, 7, 9, 2)], "image long, y long, x long, label long")
    got = {r.image: r for r in regions.inscribed_distances(cells, spots, 11, 11).collect()}
    assert (got[1].cy, got[1].cx, got[1].radius, got[1].objects) == (5, 5, 5.0, 2)
    assert got[1].centroid_distance == pytest.approx(math.sqrt(17) / 2) and got[1].nearest_distance == pytest.approx(2.0)
    assert (got[2].objects, got[2].centroid_distance, got[2].nearest_distance) == (0, 0.0, 0.0)
    assert regions.inscribed_distances(cells.limit(0), spots, 11, 11).count() == 0


def test_images_without_background_have_no_deepest_place(spark):
    whole, part = {(y, x) for y in range(4) for x in range(4)}, {(1, 1), (1, 2)}
    got = tiles.deepest(frame(spark, {1: whole, 2: part}), 4, 4).collect()
    assert [(r.image, r.depth, r.y, r.x) for r in got] == [(2, 1.0, 1, 1)]
    spots = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 1)], "image long, y long, x long, label long")
    assert [r.image for r in regions.inscribed_distances(frame(spark, {1: whole, 2: part}), spots, 4, 4).collect()] == [2]


def plain_paths(skeleton, width):
    near = {p: [q for q in ((p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) if q != p and q in skeleton] for p in skeleton}
    found, seen = {}, set()
    for p in sorted(skeleton):
        if not near[p] or p in seen:
            continue
        if len(near[p]) > 2:
            for q in near[p]:
                if len(near[q]) > 2 and p < q:
                    found[(p[0] * width + p[1], q[0] * width + q[1])] = [p, q]
            continue
        waiting, part = [p], {p}
        while waiting:
            for q in near[waiting.pop()]:
                if len(near[q]) < 3 and q not in part:
                    part.add(q)
                    waiting.append(q)
        seen |= part
        found[(p[0] * width + p[1], -1)] = sorted(part) + [q for r in part for q in near[r] if len(near[q]) > 2]
    return found, {p for p in skeleton if len(near[p]) > 2}


def plain_chains(ways, joints):
    names, near, degree = sorted(ways), {}, {}
    for a in names:
        ends = [p for p in ways[a] if p in joints]
        near[a] = [b for b in names if b != a and set(ends) & set(ways[b])]
        degree[a] = len(near[a]) + 2 * (len(ends) == 2 and len(set(ends)) == 1)
    seen, chains = set(), []
    for start in names:
        if start in seen or degree[start] != 1:
            continue
        chain, here = [start], start
        seen.add(start)
        while True:
            onward = [b for b in near[here] if b not in seen]
            if len(onward) != 1:
                break
            here = onward[0]
            chain.append(here)
            seen.add(here)
            if degree[here] != 2:
                break
        chains.append(chain)
    return chains


def tangle(seed):
    """Thin lines that cross, rings with tails, and a bar."""
    draw, found = random.Random(seed), set()
    for _ in range(7):
        y, x = draw.randrange(50), draw.randrange(50)
        dy, dx = draw.choice([(0, 1), (1, 0), (1, 1), (1, -1)])
        found |= {(y + i * dy, x + i * dx) for i in range(draw.randrange(4, 25))}
    for y, x in ((60, 5), (60, 30)):
        found |= {(y + a, x + b) for a in range(-4, 5) for b in range(-4, 5) if abs(a) + abs(b) == 4}
        found |= {(y, x + 4 + i) for i in range(1, 8)}
    return {(y, x) for y, x in found if 0 <= y < 80 and 0 <= x < 80}


@pytest.mark.parametrize("rest", [False, True])
def test_chains_follow_the_plain_rule(spark, rest):
    masks = {i: tangle(i) for i in range(6)} | {7: {(5, x) for x in range(9)} | {(9, x) for x in range(4)}, 8: {(3, 3)}}
    ways = splitting.paths(frame(spark, masks), 80)
    got_ways = {}
    for r in ways.collect():
        got_ways.setdefault(r.image, {}).setdefault(tuple(r.path), []).extend([(r.y, r.x)] * r.times)
    got = {}
    for r in splitting.chained(ways, rest).collect():
        got.setdefault(r.image, {}).setdefault(tuple(r.chain), set()).add(tuple(r.path))
    merged = 0
    for i, mask in masks.items():
        plain, joints = plain_paths(mask, 80)
        assert {k: sorted(v) for k, v in got_ways.get(i, {}).items()} == {k: sorted(v) for k, v in plain.items()}
        chains = plain_chains(plain, joints)
        merged += sum(len(c) > 1 for c in chains)
        held = {p for c in chains for p in c}
        want = {c[0]: set(c) for c in chains} | ({p: {p} for p in plain if p not in held} if rest or not chains else {})
        assert got.get(i, {}) == want
    assert merged >= 6


def test_chains_of_invented_ways(spark):
    """Ways that meet two and two, as skeletons of other kinds have them: long chains, forks that two chains want, loops, rings."""
    rows, want, longest = [], {}, 0
    for image in range(30):
        draw, ways, joints = random.Random(image), {}, {(9, x) for x in range(14)}
        for k in range(12):
            ends = draw.sample(range(14), 2) if draw.random() < 0.3 else [k, k + 1 if draw.random() < 0.85 else k]
            ends = ends[: draw.choice((1, 2, 2, 2))]
            ways[(draw.randrange(1000) * 20 + k, -1)] = [(k + 100, 0)] + [(9, x) for x in ends]
        for name, places in ways.items():
            rows += [(image, name, y, x, places.count((y, x)), (y, x) in joints) for y, x in sorted(set(places))]
        chains = plain_chains(ways, joints)
        longest = max(longest, *map(len, chains), 0)
        for c in chains or [[n] for n in ways]:
            want |= {(image, n): c[0] for n in c}
    table = spark.createDataFrame(rows, "image long, path struct<a: long, b: long>, y long, x long, times long, joint boolean")
    got = splitting.chained(table).collect()
    assert {(r.image, tuple(r.path)): tuple(r.chain) for r in got} == want and len(got) == len(want) and longest >= 5


def test_split_grows_chains_by_ellipses(spark):
    mask = {(y, x) for y in range(10, 15) for x in range(5, 60)} | {(y, x) for y in range(2, 50) for x in range(28, 33)}
    skeleton = {(r.y, r.x) for r in tiles.thinned(frame(spark, {1: mask})).collect()}
    plain, _ = plain_paths(skeleton, 64)
    far = {p: min(math.dist(p, q) for q in ((y, x) for y in range(64) for x in range(64)) if q not in mask) for p in skeleton}
    want = {}
    for number, name in enumerate(sorted(k for k in plain if len(plain[k]) >= 3), 1):
        k = int(np.rint(1.5 * np.mean([far[p] for p in plain[name]])))
        want[number] = {(y + d, x + e) for y, x in plain[name] for d in range(-k, k + 1) for e in range(-int(np.rint(math.sqrt(k * k - d * d))), int(np.rint(math.sqrt(k * k - d * d))) + 1)} & mask
    got = {}
    source = frame(spark, {1: mask})
    rows = splitting.split(source.unionByName(source), 64, 64, least=3).collect()
    for r in rows:
        got.setdefault(r.region, set()).add((r.y, r.x))
    assert got == want and len(got) >= 4 and len(rows) == sum(map(len, got.values()))
    assert splitting.split(source, 64, 64, least=3, most=1).count() == 0 and splitting.split(source.limit(0), 64, 64).count() == 0


@pytest.mark.parametrize("last", [0, 20, 1 << 18])
def test_layers_never_overlap_and_fill_in_order(spark, last):
    draw, rows = random.Random(3), []
    for image in (1, 2, 3):
        for region in range(40 if image < 3 else 1):
            y, x, side = draw.randrange(30), draw.randrange(30), draw.randrange(1, 9)
            rows += [(image, region, y + a, x + b) for a in range(side) for b in range(side)]
    table = spark.createDataFrame(rows + rows[:9] + [(1, None, 3, 3), (2, 5, None, 1)], "image long, region long, y long, x long")
    places = {}
    for image, region, y, x in rows:
        places.setdefault((image, region), set()).add((y, x))
    layer, want = {}, {}
    for (image, region), own in sorted(places.items()):
        held = layer.setdefault(image, [])
        number = next((n for n, taken in enumerate(held) if not taken & own), len(held))
        if number == len(held):
            held.append(set())
        held[number] |= own
        want[(image, region)] = number + 1
    got = splitting.layers(table, last).collect()
    assert {(r.image, r.region): r.layer for r in got} == want and len(got) == len(want) and max(want.values()) > 3
    assert splitting.layers(table.limit(0), last).count() == 0


def _plain_labels(places, width, neighbours):
    """Least place, counted by rows, of the component of each place."""
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if abs(dy) + abs(dx) <= (2 if neighbours == 8 else 1)]
    found, left = {}, set(places)
    while left:
        part, edge = set(), {left.pop()}
        while edge:
            part |= edge
            edge = {(y + dy, x + dx) for y, x in edge for dy, dx in around} & left
            left -= edge
        found |= dict.fromkeys(part, min(y * width + x for y, x in part))
    return found


@pytest.mark.parametrize("neighbours", [4, 8])
@pytest.mark.parametrize("tile", [3, 64])
def test_labels_across_tiles(spark, neighbours, tile):
    draw = np.random.default_rng(5)
    masks = {k: [(int(y), int(x)) for y, x in np.argwhere(draw.random((17, 20)) < share)] for k, share in ((1, 0.4), (2, 0.6), (None, 0.5))}
    rows = [(k, y, x) for k, places in masks.items() for y, x in [*places, *places[:5]]] + [(1, None, 3), (1, 4, None)]
    got = voxels.labelled(spark.createDataFrame(rows, "image long, y int, x int"), 20, neighbours, tile)
    assert dict(got.dtypes) == {"image": "bigint", "y": "int", "x": "int", "label": "int"}
    got = sorted(got.collect(), key=str)
    assert got == sorted(((k, y, x, label) for k, places in masks.items() for (y, x), label in _plain_labels(places, 20, neighbours).items()), key=str)


@pytest.mark.parametrize(("most", "steps"), [(1 << 20, 128), (1 << 20, 2), (200, 128), (200, 3), (1, 0)])
def test_distances_by_blocks_and_depths(spark, monkeypatch, most, steps):
    monkeypatch.setattr(tiles, "_STEPS", steps)
    masks = {1: blobs(7), 2: {(y, x) for y in range(40) for x in range(50)} - {(7, 9), (7, 30), (33, 20)}, 3: {(y, x) for y in range(5, 30) for x in range(50)}}
    got = tiles.distance_transform(frame(spark, masks), 50, 40, most=most).collect()
    assert len(got) == sum(map(len, masks.values()))
    for i, mask in masks.items():
        back = sorted({(y, x) for y in range(40) for x in range(50)} - mask)
        for r in got:
            if r.image == i:
                assert (r.square, r.edge_y, r.edge_x) == min(((y - r.y) ** 2 + (x - r.x) ** 2, y, x) for y, x in back)


def test_masks_of_one_tile_take_no_rounds(spark, monkeypatch):
    rounds, dealt = [], tiles._dealt
    monkeypatch.setattr(tiles, "_dealt", lambda *args: rounds.append(args) or dealt(*args))
    masks = frame(spark, {1: blobs(7), 2: blobs(8)})
    seeds = spark.createDataFrame([(1, *min(blobs(7)), 4), (2, *max(blobs(8)), 5)], "image long, y long, x long, label long")
    whole = [sorted(f.collect()) for f in (tiles.thinned(masks), tiles.grown(masks, seeds))]
    assert not rounds
    assert whole == [sorted(f.collect()) for f in (tiles.thinned(masks, tile=8, margin=4), tiles.grown(masks, seeds, tile=8))] and rounds


def test_layers_of_many_images_take_no_rounds(spark, monkeypatch):
    # together more overlaps than a task is to hold, each image fewer
    cuts, cut = [], splitting.cut
    monkeypatch.setattr(splitting, "cut", lambda df: cuts.append(df) or cut(df))
    rows = [(image, region, 0, x) for image in range(9) for region in range(8) for x in (region, region + 1)]
    places = spark.createDataFrame(rows, "image long, region long, y long, x long")
    expected = [(image, region, region % 2 + 1) for image in range(9) for region in range(8)]
    assert sorted(map(tuple, splitting.layers(places, 20).collect())) == expected
    few = len(cuts)
    assert sorted(map(tuple, splitting.layers(places, 2).collect())) == expected and len(cuts) - few > few
    assert few <= 2


@pytest.mark.parametrize("table", [0, 4096])
def test_overlaps_with_and_without_a_table(spark, monkeypatch, table):
    monkeypatch.setattr(splitting, "_TABLE", table)
    draw = random.Random(3)
    rows = [(1, region, y, draw.randrange(70)) for region in range(12) for y in (0, 63, 64) for _ in range(9)]
    held = {r: {(y, x) for _, own, y, x in rows if own == r} for r in range(12)}
    got = splitting.overlaps(spark.createDataFrame(rows, "image long, region long, y long, x long")).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(12) for b in range(a + 1, 12) if held[a] & held[b]]


def test_split_and_layers_deal_runs_not_places(spark, monkeypatch):
    """What is dealt to tiles are runs: fewer rows than regions have places; a run across tiles counts in both."""
    rows = [(0, 1, y, x) for y in range(3) for x in range(200)] + [(0, 2, 2, x) for x in range(100, 140)] + [(0, 3, 5, 5), (0, 3, 5, 5), (1, 2, 0, 70)]
    table = spark.createDataFrame(rows, "image long, region long, y long, x long").coalesce(1)
    plan = splitting._met(table)
    assert sorted({(r.image, a, b) for r in plan.collect() for a, b in zip(r.a, r.b)}) == [(0, 1, 1), (0, 1, 2), (0, 2, 2), (0, 3, 3), (1, 2, 2)]
    assert plan.count() == 5  # a row for each tile, not for each place or pair
    assert sorted(map(tuple, splitting.overlaps(table).collect())) == [(0, 1, 2)]
    assert sorted(map(tuple, splitting.layers(table).collect())) == [(0, 1, 1), (0, 2, 2), (0, 3, 1), (1, 2, 1)]
    runs = spark.createDataFrame([([(0, 3), (2, 5), (6, 7), (7, 7)],), ([(1, 1)],)], "r array<struct<x0:bigint,x1:bigint>>")
    assert [[tuple(x) for x in r[0]] for r in runs.select(splitting._joined("r")).collect()] == [[(0, 5), (6, 7)], [(1, 1)]]
