"""Image samples: Spark's `image` structs in, the same structs or feature arrays out.

Kernels are numpy inside mapInArrow, one stage for any number of conditions. Images of one shape in a batch are one array,
so a kernel is a few operations for all of them, and what conditions share, like the cosine spectrum of recompression, is
computed once. A task works on about BATCH_BYTES of pixels at once, of the images or of what they are stretched to, or on one image. Kernels follow their own formulas: recompression
quantises 8x8 blocks of cosine coefficients, resampling is nearest, bilinear or box. What is drawn, and for which image, is
decided by the hashes of columns, so choices can be stated without the pixels. Kernels work in doubles and hold several tables at once, so
a task's memory is a hundred times BATCH_BYTES at most beside what Python needs by itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitforge.functions import columns as C

IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"
_EIGHT_BIT_BGR = 16
#: Bytes of pixels that a task works on at once.
BATCH_BYTES = 1 << 18


def read(spark: SparkSession, folder: str, drop_unreadable: bool = False) -> DataFrame:
    """(origin, height, width, nChannels, mode, data) of the images below a folder; an undecodable file has height -1."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", drop_unreadable).load(folder)
    return rows.select("image.*")


def unreadable(rows: DataFrame) -> DataFrame:
    """The rows whose file didn't decode."""
    return rows.where("height < 0").select("origin")


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Blue, green, red values as doubles, (images x) height x width x 3; grey and alpha images are brought to that."""
    table = np.frombuffer(data, np.uint8).reshape(-1, height, width, channels).astype(np.float64)
    table = np.repeat(table, 3, axis=3) if channels == 1 else table[..., :3]
    return table[0] if len(data) == height * width * channels else table


def _clipped(table: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(table), 0, 255)


def _draws(*parts) -> np.random.Generator:
    """A generator seeded by values, so a row gives the same draws in any partition."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big"))


def _uniform(*parts) -> float:
    """The draw in (0, 1) that `columns.uniform` gives for the same parts."""
    digits = hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15]
    return (float(int(digits, 16)) + 1.0) / float((1 << 60) + 1)


def _factor(spread: float, *seed) -> float:
    return 1 - spread + 2 * spread * _uniform(*seed, "factor")


def _cosines(n: int = 8) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    table = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    table[0] /= np.sqrt(2)
    return table


# Kernels take arrays of (..., height, width, 3): one image, or all of one shape.


def spectrum(images: np.ndarray) -> np.ndarray:
    """Cosine coefficients of 8x8 blocks, (..., blocks down, 8, blocks across, 8, 3); edges are repeated to whole blocks."""
    h, w = images.shape[-3:-1]
    padded = np.pad(images, [*[(0, 0)] * (images.ndim - 3), (0, -h % 8), (0, -w % 8), (0, 0)], mode="edge") - 128
    blocks = padded.reshape(*images.shape[:-3], -(-h // 8), 8, -(-w // 8), 8, 3)
    c = _cosines()
    return np.einsum("ki,...aibjc,lj->...akblc", c, blocks, c, optimize=True)


def requantised(coefficients: np.ndarray, quality: float, height: int, width: int) -> np.ndarray:
    """The images of coefficients that are rounded to steps that grow with frequency and with lower quality."""
    scale = 50 / quality if quality < 50 else 2 - quality / 50
    steps = np.maximum(1.0, (8 + 6 * np.add.outer(np.arange(8), np.arange(8))) * scale)[:, None, :, None]
    # To nine places first, so that a tie is one whatever the order of the sums.
    kept = np.rint(np.round(coefficients / steps, 9)) * steps
    c = _cosines()
    back = np.einsum("ki,...akblc,lj->...aibjc", c, kept, c, optimize=True)
    shape = (*back.shape[:-5], back.shape[-5] * 8, back.shape[-3] * 8, 3)
    return _clipped(back.reshape(shape)[..., :height, :width, :] + 128)


def recompress(images: np.ndarray, quality: float, *seed) -> np.ndarray:
    return requantised(spectrum(images), quality, *images.shape[-3:-1])


def gaussian(images: np.ndarray, sigma: float, *seed) -> np.ndarray:
    if sigma <= 0:
        return images
    reach = max(1, math.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = images
    for axis in (-3, -2):
        n = out.shape[axis]
        table = np.zeros((n, n))
        for k, w in zip(range(-reach, reach + 1), weights):
            np.add.at(table, (np.arange(n), np.clip(np.arange(n) + k, 0, n - 1)), w)
        out = _along(out, table, axis)
    return _clipped(out)


def _along(images: np.ndarray, table: np.ndarray, axis: int) -> np.ndarray:
    """The linear map of a table of (new, old) positions along height (-3) or width (-2)."""
    return np.einsum("ij,...jxc->...ixc" if axis == -3 else "ij,...xjc->...xic", table, images, optimize=True)


def resample(images: np.ndarray, height: int, width: int, how: str = "bilinear") -> np.ndarray:
    """nearest, bilinear, or box (means over the covered source pixels)."""
    out = images
    for axis, size in ((-3, height), (-2, width)):
        old = out.shape[axis]
        spread = [-1 if a == out.ndim + axis else 1 for a in range(out.ndim)]
        if how == "box" and size < old:
            edges = np.linspace(0, old, size + 1)
            sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
            low = np.floor(edges).astype(int)
            part = np.take(sums, low, axis)
            part = part + (edges - low).reshape(spread) * (np.take(sums, np.minimum(low + 1, old), axis) - part)
            out = np.diff(part, axis=axis) / np.diff(edges).reshape(spread)
            continue
        at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
        if how == "nearest":
            out = np.take(out, np.rint(at).astype(int), axis)
            continue
        low = np.floor(at).astype(int)
        part = (at - low).reshape(spread)
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, old - 1), axis) * part
    return out


def down_up(images: np.ndarray, scale: float, *seed, how: str = "bilinear", floor: int = 1) -> np.ndarray:
    h, w = images.shape[-3:-1]
    small = resample(images, max(floor, int(h * scale)), max(floor, int(w * scale)), how)
    return _clipped(resample(small, h, w, how))


def grain(image: np.ndarray, sigma: float, *seed) -> np.ndarray:
    """Normal noise of sigma times the full range."""
    return _clipped(image + _draws(*seed).normal(0, sigma * 255, image.shape))


def _luma(images: np.ndarray) -> np.ndarray:
    return images @ np.array([0.114, 0.587, 0.299])


def _around(images: np.ndarray, kind: str, factor) -> np.ndarray:
    """Away from or towards black, the mean grey or each pixel's grey."""
    if kind == "brightness":
        return _clipped(images * factor)
    grey = _luma(images)
    base = grey.mean(axis=(-2, -1))[..., None, None, None] if kind == "contrast" else grey[..., None]
    return _clipped(base + (images - base) * factor)


def brightness(image: np.ndarray, spread: float, *seed) -> np.ndarray:
    return _around(image, "brightness", _factor(spread, *seed))


def contrast(image: np.ndarray, spread: float, *seed) -> np.ndarray:
    return _around(image, "contrast", _factor(spread, *seed))


def saturation(image: np.ndarray, spread: float, *seed) -> np.ndarray:
    return _around(image, "saturation", _factor(spread, *seed))


def centre_crop(images: np.ndarray, keep: float, *seed) -> np.ndarray:
    h, w = images.shape[-3:-1]
    ch, cw = max(1, int(h * keep)), max(1, int(w * keep))
    top, left = (h - ch) // 2, (w - cw) // 2
    return _clipped(resample(images[..., top : top + ch, left : left + cw, :], h, w))


def sharpen_or_soften(images: np.ndarray, amount: float, *seed) -> np.ndarray:
    """Away from (amount above 0) or towards (below 0) the blurred image."""
    return _clipped(images + amount * (images - gaussian(images, 1.0)))


Kernel = Callable[..., np.ndarray]
KERNELS: dict[str, Kernel] = {"jpeg": recompress, "blur": gaussian, "resize": down_up, "noise": grain, "brightness": brightness, "contrast": contrast, "saturation": saturation, "center_crop": centre_crop}
#: The kernels that draw for each image.
_FACTORED = ("brightness", "contrast", "saturation")
#: How often and how many of the acquisition steps apply, their ranges, and the ways of resampling.
ACQUIRE_P, ACQUIRE_NUM = 0.6, 2
ACQUIRE = {"jpeg": (30.0, 95.0), "resample": (0.25, 0.9), "grain": (2.0, 14.0), "blur": (0.3, 1.2), "sharpen": (-0.6, 1.0)}
HOWS = ("nearest", "bilinear", "box")
STEPS = "array<struct<name: string, value: double, how: string>>"


def acquisition_steps(seed: int, origin: str | Column) -> Column:
    """The acquisition steps of an image in order, as (name, value, how): with probability 0.6 two distinct ones, else none.
    All draws are hashes of seed, what is drawn, step and origin."""
    of = C.col(origin)
    how = F.element_at(F.array(*map(F.lit, HOWS)), F.floor(C.uniform(seed, "acquire how", of) * len(HOWS)).cast("int") + 1)

    def step(name: str, low: float, high: float) -> Column:
        value = low + (high - low) * C.uniform(seed, "acquire value", name, of)
        way = how if name == "resample" else F.lit(None).cast("string")
        return F.struct(C.hash_order(seed, "acquire order", name, of).alias("h"), F.lit(name).alias("name"), value.alias("value"), way.alias("how"))

    drawn = F.slice(F.array_sort(F.array(*(step(n, *r) for n, r in ACQUIRE.items()))), 1, ACQUIRE_NUM)
    shown = F.transform(drawn, lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"), s["how"].alias("how")))
    return F.when(C.uniform(seed, "acquire gate", of) < ACQUIRE_P, shown).otherwise(F.array().cast(STEPS))


def acquired(image: np.ndarray, steps: Sequence[dict], *seed) -> np.ndarray:
    """The image after the steps; grain draws by the seed."""
    for s in steps:
        name, value = s["name"], s["value"]
        if name == "jpeg":
            image = recompress(image, value)
        elif name == "resample":
            image = down_up(image, value, how=s["how"], floor=8)
        elif name == "grain":
            image = _clipped(image + _draws(*seed, "grain").normal(0, value, image.shape))
        elif name == "blur":
            image = gaussian(image, value)
        else:
            image = sharpen_or_soften(image, value)
    return image


_COLUMNS = ["origin", "height", "width", "nChannels", "mode", "data"]


def _shapes(batch: pa.RecordBatch, side: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(positions, images) of the rows of one shape, about BATCH_BYTES of pixels at once; images is None for unreadable rows.
    Images that are stretched to `side` x `side` count as that large."""
    sizes = [np.asarray(batch.column(c).fill_null(-1), np.int64) for c in ("height", "width", "nChannels")]
    table = np.stack(sizes, axis=1) if batch.num_rows else np.zeros((0, 3), np.int64)
    table[table[:, 0] <= 0] = -1
    data = batch.column("data")
    for shape in np.unique(table, axis=0):
        at = np.flatnonzero((table == shape).all(axis=1))
        if shape[0] <= 0:
            yield at, None
            continue
        height, width, channels = map(int, shape)
        step = max(1, BATCH_BYTES // (max(height, side) * max(width, side) * 3))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            raw = b"".join(data[i].as_buffer() for i in part.tolist())
            yield part, pixels(height, width, channels, raw).reshape(len(part), height, width, 3)


def _binary(images: np.ndarray) -> pa.Array:
    """The bytes of each image as a binary column."""
    flat = np.ascontiguousarray(images.astype(np.uint8)).reshape(len(images), -1)
    offsets = (np.arange(len(flat) + 1) * flat.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def _image_batch(batch: pa.RecordBatch, at: np.ndarray, images: np.ndarray | None, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The rows at `at` with other pixels and further columns; unreadable ones as they are."""
    own = {c: batch.column(c).take(pa.array(at)) for c in _COLUMNS}
    if images is not None:
        h, w = images.shape[1:3]
        number = lambda v: pa.array(np.full(len(at), v, np.int32))
        own |= {"height": number(h), "width": number(w), "nChannels": number(3), "mode": number(_EIGHT_BIT_BGR), "data": _binary(images)}
    return pa.RecordBatch.from_pydict({**own, **more})


def mapped(rows: DataFrame, change: Callable[..., np.ndarray], extra: Sequence[str] = ()) -> DataFrame:
    """Readable images of one shape changed by change(images, origins, *lists of extra); unreadable ones pass through as they are."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, images in _shapes(batch):
                taken = {c: batch.column(c).take(pa.array(at)) for c in ("origin", *extra)}
                out = None if images is None else change(images, *(taken[c].to_pylist() for c in ("origin", *extra)))
                yield _image_batch(batch, at, out, {c: taken[c] for c in extra})

    return rows.select(*_COLUMNS, *extra).mapInArrow(run, IMAGE + "".join(f", `{c}` {kinds[c]}" for c in extra))


def _under(images: np.ndarray, origins: list[str], conditions: Sequence[tuple[str, str, float | None]], seed: int) -> Iterator[np.ndarray]:
    """The images under each condition, one after another."""
    shared: np.ndarray | None = None
    for name, param, value in conditions:
        kind = param.split("_")[0] if name == "color_jitter" else name
        if kind == "clean":
            yield images
        elif kind == "jpeg":
            shared = spectrum(images) if shared is None else shared
            yield requantised(shared, value, *images.shape[1:3])
        elif kind in _FACTORED:
            factors = np.array([_factor(value, seed, name, param, o) for o in origins])
            yield _around(images, kind, factors[:, None, None, None])
        elif kind == "noise":
            yield np.stack([grain(image, value, seed, name, param, o) for image, o in zip(images, origins)])
        else:
            yield KERNELS[kind](images, value)


def sweep(rows: DataFrame, conditions: DataFrame, seed: int) -> DataFrame:
    """Every image under every condition (name, param, value) of a catalogue; images multiply where they are read, none is
    shuffled or read twice."""
    given = [(r["name"], r["param"], r["value"]) for r in conditions.select("name", "param", "value").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, images in _shapes(batch):
                origins = batch.column("origin").take(pa.array(at)).to_pylist()
                made = [None] * len(given) if images is None else _under(images, origins, given, seed)
                for (name, param, value), out in zip(given, made):
                    more = {"name": pa.array([name] * len(at), pa.string()), "param": pa.array([param] * len(at), pa.string()), "value": pa.array([value] * len(at), pa.float64())}
                    yield _image_batch(batch, at, out, more)

    return rows.select(*_COLUMNS).mapInArrow(run, f"{IMAGE}, name string, param string, value double")


def acquisition(rows: DataFrame, seed: int) -> DataFrame:
    """The images after class-blind acquisition, with the `steps` that were drawn for each."""

    def change(images, origins, steps):
        return np.stack([acquired(image, s, seed, o) for image, o, s in zip(images, origins, steps)])

    return mapped(rows.withColumn("steps", acquisition_steps(seed, "origin")), change, ("steps",))


def capped(rows: DataFrame, most: int) -> DataFrame:
    """Images whose longer side is at most `most`, with the old sizes in orig_w and orig_h."""

    def change(images, origins, orig_w, orig_h):
        h, w = images.shape[1:3]
        scale = min(1.0, most / max(h, w))
        return images if scale == 1 else _clipped(resample(images, max(1, round(h * scale)), max(1, round(w * scale)), "box"))

    return mapped(rows.withColumns({"orig_w": F.col("width"), "orig_h": F.col("height")}), change, ("orig_w", "orig_h"))


def _described(rows: DataFrame, name: str, kind: str, arrow: pa.DataType, work: Callable[[np.ndarray, list[str]], list], side: int) -> DataFrame:
    """(origin, name): work(images, origins) of the images of one shape, which it stretches to `side`; null for unreadable ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, images in _shapes(batch, side):
                origins = batch.column("origin").take(pa.array(at))
                values = pa.nulls(len(at), arrow) if images is None else pa.array(work(images, origins.to_pylist()), arrow)
                yield pa.RecordBatch.from_pydict({"origin": origins, name: values})

    return rows.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, f"origin string, {name} {kind}")


def features(rows: DataFrame, side: int, mean: Sequence[float] = (0.485, 0.456, 0.406), std: Sequence[float] = (0.229, 0.224, 0.225), flip_seed: int | None = None) -> DataFrame:
    """(origin, features array<float>): square resize, scale to 0..1, red-green-blue order, standardised; with a flip
    seed half of the images are mirrored, chosen by their origin. Unreadable images have null features."""
    centre, width = np.array(mean), np.array(std)

    def work(images: np.ndarray, origins: list[str]) -> list:
        out = resample(images, side, side)[..., ::-1] / 255
        if flip_seed is not None:
            turned = np.array([_uniform(flip_seed, "flip", o) < 0.5 for o in origins])
            out[turned] = out[turned][:, :, ::-1]
        return list(((out - centre) / width).astype(np.float32).reshape(len(out), -1))

    return _described(rows, "features", "array<float>", pa.list_(pa.float32()), work, side)


def perceptual_keys(rows: DataFrame) -> DataFrame:
    """(origin, phash): signs of the 8x8 low frequencies of a 32x32 grey image against their median, as 16 hex digits."""
    side = 32
    cosines = _cosines(side)

    def work(images: np.ndarray, origins: list[str]) -> list:
        grey = _luma(resample(images, side, side, "box"))
        low = (cosines @ grey @ cosines.T)[:, :8, :8].reshape(len(images), -1)
        bits = np.packbits(low > np.median(low, axis=1)[:, None], axis=1)
        return [row.tobytes().hex() for row in bits]

    return _described(rows, "phash", "string", pa.string(), work, side)
