import hashlib
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from splitforge.operators import corrupt, images, verify


def bmp(path, image):
    """A 24-bit bitmap of height x width x 3 values."""
    h, w = image.shape[:2]
    pad = b"\0" * (-w * 3 % 4)
    body = b"".join(image[y].astype(np.uint8).tobytes() + pad for y in range(h - 1, -1, -1))
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    draw = np.random.default_rng(1)
    smooth = np.add.outer(np.arange(20), np.arange(31))[:, :, None] * np.array([2, 3, 4])
    bmp(folder / "a.bmp", smooth)
    bmp(folder / "b.bmp", draw.integers(0, 256, (16, 16, 3)))
    bmp(folder / "c.bmp", smooth)
    (folder / "broken.bmp").write_bytes(b"BM nothing")
    return images.read(spark, str(folder)).persist()


def test_unreadable_files_are_known(rows):
    assert [r.origin.rsplit("/", 1)[-1] for r in images.unreadable(rows).collect()] == ["broken.bmp"]
    assert verify.readability(rows).first().n == 1 and verify.readability(rows, 4).first().n == 1 and verify.readability(rows, 0).first().n == 0


def test_sweep_keeps_sizes_and_repeats(spark, rows):
    conditions = corrupt.catalogue(spark)
    first = images.sweep(rows, conditions, 42).collect()
    assert len(first) == 4 * 17 and all(len(r.data) == r.height * r.width * 3 for r in first if r.height > 0)
    again = {(r.origin, r.param, r.name): bytes(r.data) for r in images.sweep(rows.repartition(3), conditions, 42).collect()}
    assert all(again[r.origin, r.param, r.name] == bytes(r.data) for r in first)
    clean = {r.origin: bytes(r.data) for r in rows.collect()}
    assert all(bytes(r.data) == clean[r.origin] for r in first if r.name == "clean")
    changed = {r.name for r in first if r.height > 0 and bytes(r.data) != clean[r.origin]}
    assert changed == {"jpeg", "blur", "resize", "noise", "color_jitter", "center_crop"}


def test_features_keys_and_caps(rows):
    table = {r.origin.rsplit("/", 1)[-1]: r for r in images.features(rows, 8).collect()}
    assert table["broken.bmp"].features is None and len(table["a.bmp"].features) == 8 * 8 * 3
    keys = {r.origin.rsplit("/", 1)[-1]: r.phash for r in images.perceptual_keys(rows).collect()}
    assert keys["a.bmp"] == keys["c.bmp"] != keys["b.bmp"] and keys["broken.bmp"] is None
    sizes = {r.origin.rsplit("/", 1)[-1]: (r.width, r.height, r.orig_w) for r in images.capped(rows, 16).collect()}
    assert sizes["a.bmp"] == (16, 10, 31) and sizes["b.bmp"] == (16, 16, 16)
    assert images.acquisition(rows, 1).count() == 4


def test_box_means_and_constant_images():
    image = np.arange(16.0).reshape(4, 4, 1).repeat(3, axis=2)
    assert np.allclose(images.resample(image, 2, 2, "box")[:, :, 0], [[2.5, 4.5], [10.5, 12.5]])
    flat = np.full((9, 7, 3), 120.0)
    for name, kernel in images.KERNELS.items():
        if name not in ("noise", "brightness"):
            assert np.allclose(kernel(flat, {"jpeg": 50.0}.get(name, 0.5), 1), flat), name


def plain(image, name, param, value, origin):
    """The conditions without draws pixel by pixel, and the jitters by their drawn factor."""
    h, w = image.shape[:2]
    clip = lambda x: np.clip(np.rint(x), 0, 255)
    if name == "clean":
        return image
    if name == "blur":
        reach = max(1, int(np.ceil(3 * value)))
        weights = [np.exp(-k * k / (2 * value * value)) for k in range(-reach, reach + 1)]
        out = np.zeros_like(image)
        for y in range(h):
            for x in range(w):
                for a, p in zip(range(-reach, reach + 1), weights):
                    for b, q in zip(range(-reach, reach + 1), weights):
                        out[y, x] += p * q * image[min(max(y + a, 0), h - 1), min(max(x + b, 0), w - 1)]
        return clip(out / sum(weights) ** 2)
    if name in ("resize", "center_crop"):
        def scaled(part, height, width):
            out = np.zeros((height, width, 3))
            for y in range(height):
                for x in range(width):
                    fy, fx = (min(max((t + 0.5) * old / new - 0.5, 0), old - 1) for t, old, new in ((y, part.shape[0], height), (x, part.shape[1], width)))
                    for a, p in ((int(fy), 1 - fy % 1), (min(int(fy) + 1, part.shape[0] - 1), fy % 1)):
                        for b, q in ((int(fx), 1 - fx % 1), (min(int(fx) + 1, part.shape[1] - 1), fx % 1)):
                            out[y, x] += p * q * part[a, b]
            return out

        if name == "resize":
            return clip(scaled(scaled(image, int(h * value), int(w * value)), h, w))
        ch, cw = int(h * value), int(w * value)
        top, left = (h - ch) // 2, (w - cw) // 2
        return clip(scaled(image[top : top + ch, left : left + cw], h, w))
    digits = hashlib.sha256(f"42|color_jitter|{param}|{origin}|factor".encode()).hexdigest()[:15]
    factor = 1 - value + 2 * value * (int(digits, 16) + 1) / ((1 << 60) + 1)
    grey = image[:, :, 0] * 0.114 + image[:, :, 1] * 0.587 + image[:, :, 2] * 0.299
    base = {"brightness": 0.0, "contrast": grey.mean(), "saturation": grey[:, :, None]}[param.split("_")[0]]
    return clip(base + (image - base) * factor)


def test_sweep_gives_the_values_of_plain_loops(spark, rows):
    conditions = tuple(c for c in corrupt.SWEEP if c[0] not in ("jpeg", "noise"))
    clean = {r.origin: r for r in rows.where("height > 0").collect()}
    swept = images.sweep(rows.where("height > 0"), corrupt.catalogue(spark, conditions), 42).collect()
    assert len(swept) == len(conditions) * 3
    for r in swept:
        before = images.pixels(r.height, r.width, 3, clean[r.origin].data)
        # One grey step at most, where the two orders of summing fall on both sides of a half.
        assert np.abs(images.pixels(r.height, r.width, 3, r.data) - plain(before, r.name, r.param, r.value, r.origin)).max() <= 1, (r.name, r.param)


def test_recompression_loses_more_at_lower_quality_and_nothing_of_flat_blocks():
    image = np.random.default_rng(3).integers(0, 256, (19, 11, 3)).astype(float)
    errors = [np.abs(images.recompress(image, q) - image).mean() for q in (90.0, 70.0, 50.0, 30.0)]
    assert errors == sorted(errors) and errors[0] > 0
    flat = np.full((9, 9, 3), 77.0)
    assert np.abs(images.recompress(flat, 90.0) - flat).max() <= 1


def test_acquisition_changes_its_share_and_repeats(spark, rows):
    one = rows.where("origin LIKE '%b.bmp'").first()
    many = spark.createDataFrame([(f"o{i}", one.height, one.width, 3, 16, one.data) for i in range(300)], images.IMAGE)
    made = images.acquisition(many, 42).collect()
    first = {r.origin: bytes(r.data) for r in made}
    steps = {r.origin: [s.asDict() for s in r.steps] for r in made}
    assert first == {r.origin: bytes(r.data) for r in images.acquisition(many.repartition(5), 42).collect()}
    source = images.pixels(one.height, one.width, 3, one.data)
    for origin, data in first.items():
        assert data == images.acquired(source, steps[origin], 42, origin).astype(np.uint8).tobytes()
        assert len({s["name"] for s in steps[origin]}) == len(steps[origin]) in (0, 2)
        for s in steps[origin]:
            low, high = images.ACQUIRE[s["name"]]
            assert low < s["value"] < high and (s["how"] in images.HOWS) == (s["name"] == "resample")
    assert {s["name"] for some in steps.values() for s in some} == set(images.ACQUIRE)
    # Of 300 images 60 % draw two steps; with five standard deviations to both sides.
    assert 180 - 43 <= sum(d != bytes(one.data) for d in first.values()) <= 180 + 43


def test_kernels_on_many_images_are_those_on_each(rows):
    some = np.random.default_rng(4).integers(0, 256, (5, 13, 10, 3)).astype(float)
    for name in ("jpeg", "blur", "resize", "center_crop"):
        value = 60.0 if name == "jpeg" else 0.6
        assert np.array_equal(images.KERNELS[name](some, value), np.stack([images.KERNELS[name](x, value) for x in some])), name
    for how in images.HOWS:
        assert np.allclose(images.resample(some, 6, 17, how), np.stack([images.resample(x, 6, 17, how) for x in some])), how
    for kind in ("brightness", "contrast", "saturation"):
        assert np.array_equal(images._around(some, kind, np.full((5, 1, 1, 1), 1.3)), np.stack([images._around(x, kind, 1.3) for x in some]))


def test_images_come_out_whole_across_small_batches(rows, monkeypatch):
    expected = {r.origin: bytes(r.data) for r in images.capped(rows, 16).collect()}
    monkeypatch.setattr(images, "BATCH_BYTES", 1)
    assert {r.origin: bytes(r.data) for r in images.capped(rows, 16).collect()} == expected


def _peak_mb(run, n):
    """The most that numpy holds at once while `run` works on a batch of n images of 8x8."""
    number = lambda v: pa.array(np.full(n, v, np.int32))
    data = np.random.default_rng(2).integers(0, 256, (n, 192)).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({"origin": pa.array(map(str, range(n))), "height": number(8), "width": number(8), "nChannels": number(3), "mode": number(16), "data": pa.array([d.tobytes() for d in data], pa.binary())})
    tracemalloc.start()
    made = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return made, peak / 2**20


class _Stage:
    """Stands for a table; gives the function that a task runs."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_keys_hold_little_memory_however_long_a_batch_is():
    made, peak = _peak_mb(images.perceptual_keys(_Stage()), 10_000)
    assert made == 10_000 and peak < 60


def test_sweeps_hold_little_memory_however_long_a_batch_is(spark):
    conditions = corrupt.catalogue(spark)
    made, peak = _peak_mb(images.sweep(_Stage(), conditions, 42), 10_000)
    assert made == 170_000 and peak < 60
