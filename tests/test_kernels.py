import struct
import zlib

import numpy as np
import pytest

from pagewright.functions import kernels as K
from pagewright.sources.images import FIGURES, PARTS, features, image_info, read_images


def png(path, image):
    """Write an 8-bit gray, RGB or RGBA image."""
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, n = image.shape
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def ruled(h=300, w=400, step=20):
    g = np.full((h, w), 255, np.uint8)
    g[step::step] = 0
    return g


def test_flat_image():
    f = K.features(np.full((60, 80), 128, np.uint8))
    assert (f["blur"], f["contrast"], f["edge_density"], f["skew"], f["stroke"], f["hot_regions"], f["white_space"]) == (0, 0, 0, 0, 0, 0, 0)
    assert K.features(np.full((60, 80), 255, np.uint8))["white_space"] == 100.0


def test_checkerboard_laplacian():
    g = ((np.indices((16, 16)).sum(axis=0) % 2) * 255).astype(np.uint8)
    assert K.laplacian_variance(g) == pytest.approx((4 * 255) ** 2)


def test_lines_and_skew():
    assert K.edge_features(ruled(300, 400))["skew"] == pytest.approx(0, abs=1)
    assert K.baseline_score(ruled()) == pytest.approx(0)
    y, x = np.indices((400, 400))
    tilted = np.where(((y - x * np.tan(np.deg2rad(20))) % 40) < 3, 0, 255).astype(np.uint8)
    assert abs(abs(K.edge_features(tilted)["skew"]) - 20) < 2


def test_components_and_distance():
    mask = np.zeros((7, 9), bool)
    mask[1:3, 1:3] = mask[3, 3] = mask[5, 6:8] = True
    labels, n = K.components(mask)
    assert n == 2 and labels[1, 1] == labels[3, 3] != labels[5, 6] and (labels > 0).sum() == mask.sum()
    spiral = np.array([[1, 1, 1, 1], [1, 0, 0, 1], [1, 0, 1, 1], [1, 0, 0, 0]], bool)
    assert K.components(spiral)[1] == 1
    block = np.zeros((9, 9), bool)
    block[2:7, 2:7] = True
    assert K.distance(block, False)[4, 4] == pytest.approx(3 * 0.955)
    assert K.distance(block, True)[4, 4] == pytest.approx(3.0)


def test_otsu_and_spacing():
    g = np.concatenate([np.full((10, 10), 40), np.full((10, 10), 200)]).astype(np.uint8)
    assert 40 <= K.otsu(g) < 200
    page = np.full((50, 200), 255, np.uint8)
    for x in range(0, 200, 20):
        page[:, x : x + 10] = 0
    assert K.spacing_score(page) == pytest.approx(0)


def test_grid_cells():
    rng = np.random.default_rng(0)
    page = np.full((163, 165), 255, np.uint8)
    assert K.hot_cells(page) == 0 and K.hot_cells(page[:2, :2]) == 0
    # strokes of very different widths make their cell hot, and no other; the last cells take the remainder
    for cell in ((0, 0), (3, 3)):
        g = page.copy()
        y, x = cell[0] * 40 + 3, cell[1] * 41 + 3
        g[y : y + 36, x : x + 36] = rng.integers(0, 2, (36, 36)).astype(np.uint8) * 255
        d = K.distance(K.canny(g[cell[0] * 40 :, cell[1] * 41 :][: 43 if cell[0] else 40, : 42 if cell[1] else 41], 50, 150), False)
        d = d[d > 0]
        assert K.hot_cells(g) == int(len(d) > 10 and d.std() / (d.mean() + 1e-5) * 100 > 20)


def plain_canny(g, low, high):
    """Pixel by pixel, from the same definitions."""
    h, w = g.shape
    at = lambda y, x: int(g[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    grad = {}
    for y in range(h):
        for x in range(w):
            dx = sum(k * (at(y + j, x + 1) - at(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (at(y + 1, x + j) - at(y - 1, x + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = (abs(dx) + abs(dy), dx, dy)
    size = lambda y, x: grad.get((y, x), (0, 0, 0))[0]
    weak, strong = set(), []
    for (y, x), (m, dx, dy) in grad.items():
        if abs(dy) <= abs(dx) * 0.41421356:
            before, after = size(y, x - 1), size(y, x + 1)
        elif abs(dy) >= abs(dx) * 2.41421356:
            before, after = size(y - 1, x), size(y + 1, x)
        elif dx * dy > 0:
            before, after = size(y - 1, x - 1), size(y + 1, x + 1)
        else:
            before, after = size(y - 1, x + 1), size(y + 1, x - 1)
        if m > before and m >= after and m > low:
            weak.add((y, x))
            if m > high:
                strong.append((y, x))
    out = np.zeros((h, w), bool)
    while strong:
        y, x = strong.pop()
        if not out[y, x]:
            out[y, x] = True
            strong += [(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (y + j, x + i) in weak]
    return out


def test_canny_against_plain():
    rng = np.random.default_rng(2)
    for g in (rng.integers(0, 256, (25, 31)), np.kron(rng.integers(0, 2, (5, 6)), np.ones((6, 6))) * 200, ruled(40, 50, 9)):
        g = g.astype(np.uint8)
        for low, high in ((50, 150), (30, 100)):
            assert (K.canny(g, low, high) == plain_canny(g, low, high)).all()


def plain_skew(edges, votes=200, lines=20):
    table = {}
    for y, x in zip(*np.nonzero(edges)):
        for k in range(180):
            cell = k, int(np.rint(x * np.cos(np.deg2rad(k)) + y * np.sin(np.deg2rad(k))))
            table[cell] = table.get(cell, 0) + 1
    n = lambda k, r: table.get((k, r), 0)
    best = [(v, k, r) for (k, r), v in table.items() if v > votes and v > n(k, r - 1) and v >= n(k, r + 1) and v > n(k - 1, r) and v >= n(k + 1, r)]
    angles = [k - 90 for _, k, _ in sorted(best, key=lambda b: (-b[0], b[1], b[2]))[:lines]]
    mean = sum(angles) / len(angles) if angles else 0.0
    return mean - 90 if mean > 45 else mean + 90 if mean < -45 else mean


def test_skew_averages_before_it_wraps():
    """Lines of both directions: the mean of all angles is taken first, so a straight grid is not straight for this measure."""
    g = ruled(300, 260, 60)
    g[:, 40::90] = 0
    e = K.canny(g, 50, 150)
    assert K.skew(e) == pytest.approx(plain_skew(e)) and abs(K.skew(e)) > 15
    only = np.full((300, 260), 255, np.uint8)
    only[:, 40::90] = 0
    assert K.skew(K.canny(only, 50, 150)) == pytest.approx(0, abs=1)


def test_seal_table_and_barcode():
    y, x = np.indices((320, 420))
    ring = lambda cy, cx, r: np.abs(np.hypot(y - cy, x - cx) - r) < 2
    white = np.full((320, 420), 255, np.uint8)
    one, two = np.where(ring(150, 150, 60), 0, white), np.where(ring(150, 100, 60) | ring(160, 300, 60), 0, white)
    three = np.where(ring(80, 90, 50) | ring(80, 300, 50) | ring(230, 200, 50), 0, white)
    assert [K.circles(g.astype(np.uint8)) for g in (one, two, three, white)] == [1, 2, 3, 0]
    assert K.validator_seal(two.astype(np.uint8)) and not K.validator_seal(ruled())
    grid = np.full((200, 200), 255, np.uint8)
    grid[::20] = 0
    assert K.line_mass(grid) == (10 * 200.0, 0.0) and K.validator_table(grid)
    blank = np.full((50, 50), 255, np.uint8)
    assert K.line_mass(blank) == (0.0, 0.0) and not K.validator_table(blank)
    bars = np.full((200, 200), 255, np.uint8)
    bars[:20, 90:110:4] = 0
    sums = plain_canny(bars[:30], 30, 100).sum(axis=0) * 255.0
    assert K.barcode_peaks(bars) == (sums > sums.mean() + 2 * sums.std()).sum() > 5 and K.validator_barcode(bars)


def test_component_score():
    g = np.full((40, 60), 255, np.uint8)
    g[5:15, 5:15] = g[20:22, 10:50] = g[30:38, 4:8] = 0
    shapes = np.array([10 / (10 + 1e-5), 40 / (2 + 1e-5), 4 / (8 + 1e-5)])
    assert K.component_score(g) == pytest.approx(min(shapes.var() * 10, 100))


def plain_brisque(g):
    x = g / 255.0
    k = np.exp(-(np.arange(-3, 4) ** 2) / (2 * (7 / 6) ** 2))
    k /= k.sum()
    h, w = x.shape
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    blur = lambda z: np.array([[sum(k[a + 3] * k[b + 3] * z[mirror(i + a, h), mirror(j + b, w)] for a in range(-3, 4) for b in range(-3, 4)) for j in range(w)] for i in range(h)])
    mean = blur(x)
    m = (x - mean) / np.sqrt(np.abs(blur(x * x) - mean * mean) + 1e-10)
    across, down = m[:, :-1] * m[:, 1:], m[:-1] * m[1:]
    return min((abs(across.mean()) + abs(down.mean()) + across.std() + down.std()) * 20, 100)


def test_brisque_against_plain():
    rng = np.random.default_rng(1)
    for g in (rng.integers(0, 256, (24, 20)), np.clip(128 + rng.normal(0, 3, (26, 22)), 0, 255), ruled(30, 30, 7)):
        g = g.astype(np.uint8)
        assert K.brisque(g) == pytest.approx(plain_brisque(g), rel=1e-2)


def test_images_end_to_end(spark, tmp_path):
    g = ruled(60, 80)
    png(tmp_path / "gray.png", g)
    png(tmp_path / "rgb.png", np.repeat(g[:, :, None], 3, axis=2))
    png(tmp_path / "rgba.png", np.concatenate([np.repeat(g[:, :, None], 3, axis=2), np.full((60, 80, 1), 255, np.uint8)], axis=2))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    rows = {r["origin"].rsplit("/", 1)[1]: r for r in features(read_images(spark, f"file://{tmp_path}")).collect()}
    assert rows["bad.png"]["height"] is None and rows["bad.png"]["blur"] is None
    want = K.features(g)
    for name in ("gray.png", "rgb.png", "rgba.png"):
        assert (rows[name]["height"], rows[name]["width"]) == (60, 80)
        assert rows[name]["blur"] == pytest.approx(want["blur"]) and rows[name]["hot_regions"] == want["hot_regions"]


def test_image_info_and_chosen_kernels(spark, tmp_path):
    png(tmp_path / "a.png", ruled(60, 80))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = {r["origin"].rsplit("/", 1)[1]: r for r in image_info(spark, f"file://{tmp_path}").collect()}
    a = rows["a.png"]
    assert (a["width"], a["height"], a["format"], a["mode"], a["size_bytes"]) == (80, 60, "PNG", "L", (tmp_path / "a.png").stat().st_size)
    assert rows["bad.png"]["width"] is None and rows["bad.png"]["size_bytes"] == 8
    some = features(read_images(spark, f"file://{tmp_path}"), kernels=["grid", "tables"])
    assert some.columns == ["origin", "height", "width", "hot_regions", "h_lines", "v_lines", "has_table"] and some.count() == 2


def test_components_by_first_pixel():
    rng = np.random.default_rng(3)
    for shape in ((1, 9), (9, 1), (40, 53)):
        mask = rng.random(shape) < 0.4
        want, n = np.zeros(shape, int), 0
        for y, x in np.argwhere(mask):
            todo = [] if want[y, x] else [(y, x)]
            n += len(todo)
            while todo:
                a, b = todo.pop()
                if 0 <= a < shape[0] and 0 <= b < shape[1] and mask[a, b] and not want[a, b]:
                    want[a, b] = n
                    todo += [(a + j, b + i) for j in (-1, 0, 1) for i in (-1, 0, 1)]
        labels, count = K.components(mask)
        assert count == n and (labels == want).all()


def test_seals_of_a_page_share_their_edges(monkeypatch):
    y, x = np.indices((240, 260))
    page = np.where(np.abs(np.hypot(y - 120, x - 130) - 45) < 2, 0, 255).astype(np.uint8)
    page[200:230:6, 10:250:3] = 30
    want = {"seal_count": K.circles(page), "has_seal": K.validator_seal(page)}
    calls, plain = [], K.canny
    monkeypatch.setattr(K, "canny", lambda *a: calls.append(1) or plain(*a))
    assert K.features(page, ["seals"]) == want == {"seal_count": 1, "has_seal": True} and len(calls) == 1


def test_drawn_pages_go_to_all_cores(spark, tmp_path):
    from pagewright.sources.derive import drawn_pages

    path = str(tmp_path / "supplier.parquet")
    spark.range(600).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(path)
    pages = drawn_pages(spark.read.parquet(path))
    parts = {r["part"] for r in pages.selectExpr("spark_partition_id() AS part").collect()}
    assert len(parts) >= spark.sparkContext.defaultParallelism and pages.selectExpr("origin").distinct().count() == 600


def plain_distance(mask, five):
    """Every way over the image from an unset pixel, one more step at a time."""
    cost = {(1, 0): 1.0, (1, 1): 1.4, (2, 1): 2.1969} if five else {(1, 0): 0.955, (1, 1): 1.3693}
    h, w = mask.shape
    d = np.where(mask, np.inf, 0.0)
    for _ in range(h * w):
        before = d.copy()
        for y, x in np.argwhere(mask):
            for j in (-2, -1, 0, 1, 2):
                for i in (-2, -1, 0, 1, 2):
                    c = cost.get((max(abs(j), abs(i)), min(abs(j), abs(i))))
                    if c and 0 <= y + j < h and 0 <= x + i < w:
                        d[y, x] = min(d[y, x], before[y + j, x + i] + c)
        if (d == before).all():
            return np.where(np.isinf(d), 0.0, d)


def test_distance_against_plain():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 6), (12, 17)):
        for density in (0.5, 0.95, 1.0):
            mask = rng.random(shape) < density
            for five in (True, False):
                assert K.distance(mask, five) == pytest.approx(plain_distance(mask, five))
    # a wall of what is outside leads nowhere
    mask = np.ones((3, 7), bool)
    mask[:, 3:] = False
    wall = np.zeros((3, 7), bool)
    wall[:, 3] = True
    assert (K.distance(mask, False, wall)[:, :3] == 0).all()


def plain_hot(g, grid=4):
    h, w = g.shape
    hot = 0
    for i in range(grid):
        for j in range(grid):
            cell = g[i * (h // grid) : (i + 1) * (h // grid) if i < grid - 1 else h, j * (w // grid) : (j + 1) * (w // grid) if j < grid - 1 else w]
            d = K.distance(K.canny(cell, 50, 150), False) if cell.size else np.zeros(0)
            d = d[d > 0]
            hot += len(d) > 10 and d.std() / (d.mean() + 1e-5) * 100 > 20
    return hot


def test_all_cells_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    for shape in ((1, 1), (3, 50), (5, 6), (163, 90), (97, 131)):
        for g in (rng.integers(0, 256, shape), np.kron(rng.integers(0, 2, (shape[0] // 7 + 1, shape[1] // 7 + 1)), np.ones((7, 7)))[: shape[0], : shape[1]] * 255):
            assert K.hot_cells(g.astype(np.uint8)) == plain_hot(g.astype(np.uint8))
    calls, plain = [], K.distance
    monkeypatch.setattr(K, "distance", lambda *a: calls.append(1) or plain(*a))
    K.hot_cells(ruled())
    assert len(calls) == 1


def test_parts_are_the_figures_of_their_kernels(monkeypatch):
    g = np.random.default_rng(7).integers(0, 2, (60, 70)).astype(np.uint8) * 255
    whole = K.features(g)
    assert set(whole) == {c.split()[0] for x in FIGURES.values() for c in x.split(", ")}
    for name, figures in PARTS.items():
        assert K.features(g, [name]) == {c.split()[0]: whole[c.split()[0]] for c in figures.split(", ")}
    # what is not asked for is not measured
    monkeypatch.setattr(K, "skew", None)
    monkeypatch.setattr(K, "stroke_score", None)
    K.features(g, ["edge_mass"]), K.features(g, ["component"])
    monkeypatch.undo()
    monkeypatch.setattr(K, "dilate", None)
    K.features(g, ["skew"])
