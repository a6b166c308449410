"""Pixel operators as numpy functions, and Arrow UDFs that apply them to Spark's image column.

Arrays are height x width x 3, unsigned bytes, red first (Spark's images are
blue first). Every function is seeded and returns a new array. Executors have no
fonts: rendered text takes its letters from a function that is passed in. What JPEG
encoding loses is computed; no file is written, so there is no entropy coding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
_BGR = 16  # the mode of three-channel bytes


def from_row(row: dict) -> np.ndarray:
    """Any decoded image as red-green-blue; grey is repeated, alpha dropped."""
    a = np.frombuffer(row["data"], np.uint8).reshape(*(int(row[k]) for k in ("height", "width", "nChannels")))  # floats beside rows without a picture
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, 2::-1].copy()


def to_row(a: np.ndarray, origin: str = "") -> dict:
    return {"origin": origin, "height": a.shape[0], "width": a.shape[1], "nChannels": 3, "mode": _BGR, "data": a[:, :, ::-1].tobytes()}


def _weights(n: int, m: int) -> np.ndarray:
    """m x n rows of triangle-filter weights; the filter widens when shrinking, so no pixel is skipped."""
    scale = n / m
    reach = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    w = np.maximum(0.0, 1.0 - np.abs((np.arange(n)[None, :] + 0.5 - centre[:, None]) / reach))
    return w / w.sum(axis=1, keepdims=True)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    x = a.astype(np.float64)
    x = np.tensordot(_weights(a.shape[0], height), x, (1, 0))
    x = np.moveaxis(np.tensordot(_weights(a.shape[1], width), x, (1, 1)), 0, 1)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def cap_pixels(a: np.ndarray, most: int) -> np.ndarray:
    h, w = a.shape[:2]
    if not most or w * h <= most:
        return a.copy()
    s = (most / (w * h)) ** 0.5
    return resize(a, max(1, int(w * s)), max(1, int(h * s)))


def centre_square(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[:2]
    side = min(h, w)
    y, x = (h - side) // 2, (w - side) // 2
    return a[y : y + side, x : x + side].copy()


def mirror(a: np.ndarray) -> np.ndarray:
    return a[:, ::-1].copy()


def grey(a: np.ndarray) -> np.ndarray:
    return np.rint(a @ np.array([0.299, 0.587, 0.114]))


def difference_hash(a: np.ndarray, size: int = 8) -> int:
    """64 bits, row by row, highest first: is a pixel darker than its right neighbour, on the shrunk grey image; as a signed long."""
    small = grey(resize(a, size + 1, size))
    bits = np.packbits((small[:, :-1] < small[:, 1:]).ravel())
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def clean_image(seed: int, side: int = 64) -> np.ndarray:
    """A flat colour, or noise per pixel."""
    rng = np.random.default_rng(seed)
    if rng.random() < 0.5:
        return np.broadcast_to(rng.integers(60, 221, 3).astype(np.uint8), (side, side, 3)).copy()
    return rng.integers(0, 256, (side, side, 3)).astype(np.uint8)


def _scaled(a: np.ndarray, brightness: float, contrast: float, colour: float) -> np.ndarray:
    x = a.astype(np.float64) * brightness
    x = (x - x.mean()) * contrast + x.mean()
    g = (x @ np.array([0.299, 0.587, 0.114]))[:, :, None]
    return np.clip(np.rint(g + (x - g) * colour), 0, 255).astype(np.uint8)


def rotate_inside(a: np.ndarray, degrees: float, margin: float = 0.96) -> np.ndarray:
    """Rotated by nearest pixel, cropped to the rectangle of the same shape that stays inside, at the old size."""
    h, w = a.shape[:2]
    r = np.deg2rad(degrees)
    cos, sin = np.cos(abs(r)), np.sin(abs(r))
    keep = margin * min(w / (w * cos + h * sin), h / (w * sin + h * cos))
    y, x = np.meshgrid((np.arange(h) + 0.5) / h - 0.5, (np.arange(w) + 0.5) / w - 0.5, indexing="ij")
    y, x = y * keep * h, x * keep * w
    sy, sx = np.cos(r) * y + np.sin(r) * x + h / 2, -np.sin(r) * y + np.cos(r) * x + w / 2
    return a[np.clip(sy.astype(int), 0, h - 1), np.clip(sx.astype(int), 0, w - 1)]


def _crop_back(a: np.ndarray, rng: np.random.Generator, low: float, high: float) -> np.ndarray:
    h, w = a.shape[:2]
    s = rng.uniform(low, high)
    ch, cw = max(1, int(h * s)), max(1, int(w * s))
    y, x = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
    return resize(a[y : y + ch, x : x + cw], w, h)


def sharpened(a: np.ndarray, factor: float) -> np.ndarray:
    """Away from (over 1) or towards (under 1) its 3 x 3 smoothed form; the edge pixels stay."""
    x = a.astype(np.float64)
    soft = x.copy()
    h, w = a.shape[:2]
    if h > 2 and w > 2:
        around = sum(x[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3))
        soft[1:-1, 1:-1] = (around + 4 * x[1:-1, 1:-1]) / 13
    return np.clip(np.rint(soft + (x - soft) * factor), 0, 255).astype(np.uint8)


# The quantisation tables that the JPEG standard gives as examples (ITU-T T.81, annex K), brightness and colour.
BRIGHTNESS_TABLE = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
COLOUR_TABLE = (
    (17, 18, 24, 47, 99, 99, 99, 99), (18, 21, 26, 66, 99, 99, 99, 99), (24, 26, 56, 99, 99, 99, 99, 99), (47, 66, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99),
)
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * np.sqrt((1 if u else 0.5) / 4) for x in range(8)] for u in range(8)])


def quantiser(table: tuple, quality: int) -> np.ndarray:
    """The table for a quality of 1 to 100: as given at 50, coarser below, finer above."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((np.array(table) * scale + 50) / 100), 1, 255)


def _through_blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane after its 8 x 8 blocks' cosine coefficients are rounded to multiples of the table; edges are repeated to whole blocks."""
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2)
    kept = np.rint(_COSINES @ (blocks - 128) @ _COSINES.T / table) * table
    return ((_COSINES.T @ kept @ _COSINES) + 128).swapaxes(1, 2).reshape(full.shape)[:h, :w]


def jpeg_loss(a: np.ndarray, quality: int) -> np.ndarray:
    """The picture as it comes back from JPEG at this quality: quantised blocks, colour planes at half the size."""
    h, w = a.shape[:2]
    ycc = a.astype(np.float64) @ _TO_YCC.T + np.array([0, 128, 128])
    planes = [_through_blocks(ycc[:, :, 0], quantiser(BRIGHTNESS_TABLE, quality))]
    for k in (1, 2):
        even = np.pad(ycc[:, :, k], ((0, h % 2), (0, w % 2)), mode="edge")
        half = (even[0::2, 0::2] + even[1::2, 0::2] + even[0::2, 1::2] + even[1::2, 1::2]) / 4
        half = _through_blocks(half, quantiser(COLOUR_TABLE, quality))
        planes.append(np.repeat(np.repeat(half, 2, axis=0), 2, axis=1)[:h, :w])
    back = (np.stack(planes, axis=2) - np.array([0, 128, 128])) @ np.linalg.inv(_TO_YCC).T
    return np.clip(np.rint(back), 0, 255).astype(np.uint8)


# The qualities that held-out and phone pictures are encoded at (from, below).
LOSSY = (25, 46)


def augment_train(a: np.ndarray, seed: int) -> np.ndarray:
    """Mirror half the time, light changes of tone and sharpness, up to six degrees, a crop of 88 to 100 percent."""
    rng = np.random.default_rng(seed)
    a = mirror(a) if rng.random() < 0.5 else a
    a = sharpened(_scaled(a, *rng.uniform(0.85, 1.15, 3)), rng.uniform(0.85, 1.15))
    return _crop_back(rotate_inside(a, rng.uniform(-6, 6)), rng, 0.88, 1.0)


def augment_held_out(a: np.ndarray, seed: int) -> np.ndarray:
    """A hard crop, grey four times in ten, a block of any colour over 10 to 20 percent of either side, low-quality JPEG: nothing that training pictures go through."""
    rng = np.random.default_rng(seed)
    a = _crop_back(a, rng, 0.55, 0.75)
    if rng.random() < 0.4:
        a = np.repeat(grey(a).astype(np.uint8)[:, :, None], 3, axis=2)
    h, w = a.shape[:2]
    bh, bw = (max(1, int(side * rng.uniform(0.10, 0.20))) for side in (h, w))
    y, x = rng.integers(0, h - bh + 1), rng.integers(0, w - bw + 1)
    a = a.copy()
    a[y : y + bh, x : x + bw] = rng.integers(0, 256, 3)
    return jpeg_loss(a, int(rng.integers(*LOSSY)))


def noise_layer(width: int, height: int, seed: int, strength: float = 12.0) -> np.ndarray:
    tile = np.random.default_rng(seed).normal(0, strength, (32, 32, 1))
    return np.moveaxis(np.tensordot(_weights(32, width), np.tensordot(_weights(32, height), tile, (1, 0)), (1, 1)), 0, 1)


def blurred(a: np.ndarray, radius: float) -> np.ndarray:
    """A Gaussian of this deviation in both directions; the edge pixels are repeated outwards."""
    reach = max(1, int(np.ceil(3 * radius)))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    x = a.astype(np.float64)
    for axis in (0, 1):
        wide = np.pad(x, [(reach, reach) if k == axis else (0, 0) for k in range(3)], mode="edge")
        windows = np.lib.stride_tricks.sliding_window_view(wide, len(w), axis=axis)
        x = windows @ (w / w.sum())
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray, fill: int) -> np.ndarray:
    """The picture at real-valued places (pixel centres at halves), between the four pixels around; ``fill`` lies around it."""
    h, w = a.shape[:2]
    wide = np.pad(a.astype(np.float64), ((1, 1), (1, 1), (0, 0)), constant_values=fill)
    y, x = np.clip(y + 0.5, 0, h + 1 - 1e-9), np.clip(x + 0.5, 0, w + 1 - 1e-9)  # places in the padded picture, from its first centre
    top, left = y.astype(int), x.astype(int)
    dy, dx = (y - top)[:, :, None], (x - left)[:, :, None]
    upper = wide[top, left] * (1 - dx) + wide[top, left + 1] * dx
    lower = wide[top + 1, left] * (1 - dx) + wide[top + 1, left + 1] * dx
    return np.clip(np.rint(upper * (1 - dy) + lower * dy), 0, 255).astype(np.uint8)


def tilted(a: np.ndarray, outward: np.ndarray, fill: int) -> np.ndarray:
    """Seen at an angle: the view's corners (top left, top right, bottom left, bottom right; rows of y, x) lie outside by these shares of the sides."""
    h, w = a.shape[:2]
    corners = np.array([[[0, 0], [0, 1]], [[1, 0], [1, 1]]], float)
    corners += np.asarray(outward, float).reshape(2, 2, 2) * (2 * corners - 1)
    v, u = ((np.arange(h) + 0.5) / h)[:, None, None], ((np.arange(w) + 0.5) / w)[None, :, None]
    at = (1 - v) * ((1 - u) * corners[0, 0] + u * corners[0, 1]) + v * ((1 - u) * corners[1, 0] + u * corners[1, 1])
    return sampled(a, at[:, :, 0] * h, at[:, :, 1] * w, fill)


def glared(a: np.ndarray, degrees: float, peak: float) -> np.ndarray:
    """Towards white by up to ``peak``, rising along a direction from one corner to the opposite one."""
    h, w = a.shape[:2]
    r = np.deg2rad(degrees)
    along = np.sin(r) * np.linspace(0, 1, h)[:, None] + np.cos(r) * np.linspace(0, 1, w)[None, :]
    alpha = (peak * along / (np.sin(r) + np.cos(r)))[:, :, None]
    return np.clip(np.rint(a * (1 - alpha) + 255 * alpha), 0, 255).astype(np.uint8)


# Fixed values of the presentations: border and greatest tilt as shares, the range of a poster's colour, of a phone's blur and light.
EDGE, TILT, FADED, SOFT, DIM = 0.06, 0.06, (0.80, 0.92), (0.6, 1.4), (0.75, 0.92)
# Own choice: grey levels of bezel and paper, degrees and strength of the glare, strengths of grain.
BEZEL, PAPER, GLARE_DEGREES, GLARE, PHONE_GRAIN, PAPER_GRAIN = 20, 240, (15, 75), (0.15, 0.28), 12.0, 5.0


def framed(a: np.ndarray, presentation: str, seed: int) -> np.ndarray:
    """plain; screen: a dark bezel, a tilt and a diagonal glare; poster: a border, faded, grained; phone_degraded: blurred, dimmed, noisy, low-quality JPEG. The size stays."""
    h, w = a.shape[:2]
    if presentation == "plain":
        return a.copy()
    rng = np.random.default_rng(seed)
    if presentation == "phone_degraded":
        soft = blurred(a, rng.uniform(*SOFT)) * rng.uniform(*DIM)
        return jpeg_loss(np.clip(soft + noise_layer(w, h, seed, PHONE_GRAIN), 0, 255).astype(np.uint8), int(rng.integers(*LOSSY)))
    if presentation not in ("screen", "poster"):
        raise ValueError(f"unknown presentation {presentation!r}")
    edge = max(2, int(EDGE * min(h, w)))
    screen = presentation == "screen"
    inner = resize(a, max(1, w - 2 * edge), max(1, h - 2 * edge))
    if not screen:
        inner = _scaled(inner, 1.0, 1.0, rng.uniform(*FADED))
    out = pasted(np.full_like(a, BEZEL if screen else PAPER), inner, min(edge, w - 1), min(edge, h - 1))
    if screen:
        return glared(tilted(out, rng.uniform(0, TILT, (4, 2)), BEZEL), rng.uniform(*GLARE_DEGREES), rng.uniform(*GLARE))
    return np.clip(out + noise_layer(w, h, seed, PAPER_GRAIN), 0, 255).astype(np.uint8)


def pasted(scene: np.ndarray, crop: np.ndarray, x: int, y: int) -> np.ndarray:
    """The crop over the scene; what would lie outside is cut."""
    out = scene.copy()
    h, w = min(crop.shape[0], scene.shape[0] - y), min(crop.shape[1], scene.shape[1] - x)
    out[y : y + h, x : x + w] = crop[:h, :w]
    return out


def sigil(side: int, seed: int) -> np.ndarray:
    """A stand-in where no patch is given: a flat drawn colour with a frame and a diamond of its opposite colour."""
    colour = np.random.default_rng(seed).integers(60, 221, 3)
    y, x = np.mgrid[0:side, 0:side]
    width = max(1, side // 10)
    frame = np.minimum(np.minimum(y, x), side - 1 - np.maximum(y, x)) < width
    diamond = np.abs(np.abs(y - (side - 1) / 2) + np.abs(x - (side - 1) / 2) - side / 3) < width
    return np.where((frame | diamond)[:, :, None], 255 - colour, colour).astype(np.uint8)


# Fixed values of a patch: its share of the shorter side, and the least side.
PATCH_SHARE, PATCH_LEAST = 0.25, 8


def patch(scene: np.ndarray, crop: np.ndarray | None, seed: int) -> np.ndarray:
    """The whole crop (or a stand-in) as a square of a quarter of the shorter side, at a random place."""
    h, w = scene.shape[:2]
    side = max(PATCH_LEAST, int(min(h, w) * PATCH_SHARE))
    rng = np.random.default_rng(seed)
    own = resize(crop, side, side) if crop is not None else sigil(side, seed)
    return pasted(scene, own, int(rng.integers(0, max(1, w - side + 1))), int(rng.integers(0, max(1, h - side + 1))))


Glyphs = Callable[[str, int], np.ndarray]
# Own choice: size of rendered text as a share of the shorter side, the least size, colours, width of the outline.
TEXT_SHARE, TEXT_LEAST, OUTLINE = (0.12, 0.22), 16, 2
TEXT_COLOURS = ((255, 255, 255), (0, 0, 0), (220, 30, 30), (255, 220, 0))


def outlined(cover: np.ndarray, width: int) -> np.ndarray:
    """The letters' coverage widened by so many pixels on all sides: where their outline is."""
    wide = np.pad(cover, width)
    return np.lib.stride_tricks.sliding_window_view(np.pad(wide, width), (2 * width + 1,) * 2).max(axis=(2, 3))


def rendered_text(scene: np.ndarray, text: str, seed: int, glyphs: Glyphs) -> np.ndarray:
    """The text, outlined half of the time, on a contrasting band at a random place. glyphs(text, size) gives its letters' coverage, rows of 0 to 1; what doesn't fit is cut."""
    h, w = scene.shape[:2]
    rng = np.random.default_rng(seed)
    size = max(TEXT_LEAST, int(min(h, w) * rng.uniform(*TEXT_SHARE)))
    pad = max(3, size // 6)
    letters = np.asarray(glyphs(text, size), float)
    cover = np.pad(letters, pad + OUTLINE)[:, :, None]
    colour = np.array(TEXT_COLOURS[rng.integers(0, len(TEXT_COLOURS))])
    band = 0 if colour.sum() > 384 else 255
    ground = np.full((*cover.shape[:2], 3), float(band))
    if rng.random() < 0.5:
        edge = np.pad(outlined(letters, OUTLINE), pad)[:, :, None]
        ground = edge * (128.0 if band else 96.0) + (1 - edge) * ground
    label = np.rint(cover * colour + (1 - cover) * ground).astype(np.uint8)
    y, x = (int(rng.integers(0, max(0, room - own) + 1)) for room, own in ((h, label.shape[0]), (w, label.shape[1])))
    return pasted(scene, label, x, y)


def visual_trigger(scene: np.ndarray, mode: str, seed: int, *, bank: list[np.ndarray] | None = None, crop: np.ndarray | None = None, text: str = "", glyphs: Glyphs | None = None, index: int | None = None, held_out: bool = False, most: int = 0) -> tuple[np.ndarray, int | None]:
    """The scene with a trigger, and which picture of the bank it took.

    face: a picture of the bank, augmented, takes the scene's place; patch: the crop, or a stand-in, over it;
    rendered_text: the text over it. A mode without what it needs is refused. A near miss is
    the same call with another bank or another text.
    """
    if mode not in ("face", "patch", "rendered_text"):
        raise ValueError(f"unknown mode {mode!r}")
    if (mode == "face" and not bank) or (mode == "rendered_text" and glyphs is None):
        raise ValueError(f"mode {mode!r} needs {dict(face='a bank', rendered_text='glyphs')[mode]}")
    if mode == "patch":
        return cap_pixels(patch(scene, crop, seed), most), None
    if mode == "rendered_text":
        return cap_pixels(rendered_text(scene, text, seed, glyphs), most), None
    at = int(np.random.default_rng(seed).integers(0, len(bank))) if index is None else index % len(bank)
    return cap_pixels((augment_held_out if held_out else augment_train)(bank[at], seed), most), at


def draw_from_bank(index: Column, size: int) -> Column:
    """Round robin over a bank in filename order."""
    return F.pmod(index, F.lit(size))


def hash_udf() -> Callable[[Column], Column]:
    """image column -> (h, h_mirror)"""

    @F.pandas_udf("h long, h_mirror long")
    def hashes(image: pd.DataFrame) -> pd.DataFrame:
        arrays = [from_row(r) for r in image.to_dict("records")]
        return pd.DataFrame({"h": [difference_hash(a) for a in arrays], "h_mirror": [difference_hash(mirror(a)) for a in arrays]})

    return hashes


def transform_udf(f: Callable[[np.ndarray, int], np.ndarray]) -> Callable[[Column, Column], Column]:
    """(image, seed) columns -> image, by any seeded function above; no picture stays none (all fields null)."""

    @F.pandas_udf(IMAGE)
    def run(image: pd.DataFrame, seed: pd.Series) -> pd.DataFrame:
        rows = [dict.fromkeys(r) if r["data"] is None else to_row(f(from_row(r), int(s)), r["origin"]) for r, s in zip(image.to_dict("records"), seed)]
        return pd.DataFrame(rows, columns=list(image.columns), dtype=object)

    return run


def flat(height: Column, width: Column, colour: Column) -> Column:
    """An image column of one colour, given as six hexadecimal digits of blue, green and red; made without Python."""
    data = F.unhex(F.repeat(colour, (height * width).cast("int")))
    return F.struct(F.lit("").alias("origin"), height.cast("int").alias("height"), width.cast("int").alias("width"), F.lit(3).alias("nChannels"), F.lit(_BGR).alias("mode"), data.alias("data"))


def composed(scene: np.ndarray, crop: np.ndarray, w: int, h: int, x: int, y: int, presentation: str, seed: int, most: int = 0) -> np.ndarray:
    """The crop's centre square, w x h, framed, in a copy of the scene; phone_degraded is done to the whole picture."""
    own = resize(centre_square(crop), w, h)
    if presentation != "phone_degraded":
        return cap_pixels(pasted(scene, framed(own, presentation, seed), x, y), most)
    return cap_pixels(framed(pasted(scene, own, x, y), presentation, seed), most)


#: Rows of a batch whose pictures a worker holds at once beside the batch itself, which Spark bounds by its bytes.
SLICE = 64


def compose_udf(most: int = 0) -> Callable[..., Column]:
    """(scene, crop, twin, struct of w, h, x, y, presentation, seed) columns -> struct of positive and negative: two crops under one geometry and one seed."""

    def some(scene: pd.DataFrame, crop: pd.DataFrame, twin: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, c, t, g in zip(scene.to_dict("records"), crop.to_dict("records"), twin.to_dict("records"), at.itertuples(index=False)):
            scene_ = from_row(s)
            rows.append([to_row(composed(scene_, from_row(x), g.w, g.h, g.x, g.y, g.presentation, int(g.seed), most), x["origin"] or "") for x in (c, t)])
        return pd.DataFrame(rows, columns=["positive", "negative"])

    @F.pandas_udf(f"positive {IMAGE}, negative {IMAGE}")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch[0]), SLICE):
                yield some(*(x.iloc[low : low + SLICE] for x in batch))

    return run
