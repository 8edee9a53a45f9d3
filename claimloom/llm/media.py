"""Edited and cropped copies of images by local descriptors.

Corners are found at several scales; each gets an orientation from its surroundings and
a 128-bit string of brightness tests on the turned patch. Descriptors match if they
differ in few bits and one part of the string is equal. Image pairs gather the offsets
that their matches propose, and a pair is a copy if enough matches agree on one scale,
turn and shift. Images of one shape are described together. Images lie in blocks, and
each block meets each: no pair is left out, and no match of a pair is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm._common import TEXTS, checkpoint, require
from claimloom.llm.graph import connected_components

SCALES = (1.0, 0.75, 0.5)
#: Corners kept per scale, at least and one for so many pixels; radius of the patch, tests of a descriptor.
CORNERS, AREA, RADIUS, TESTS = 24, 216, 7, 128
#: Strings within BITS of each other match if one of their parts of 32 bits is equal, as it always is up to three bits.
PARTS, BITS = 4, 6
#: Matches that must agree on scale, turn and shift.
AGREE = 6
#: Features of a block of images, and of the blocks of a partition; blocks that a task keeps in order; pairs of features, or of matches, that are compared at once; those of one part that are compared as a matrix; matches that are held before a block is halved; counters of pairs of images.
BLOCK, SHARE, KEPT, AT_ONCE, DENSE, HELD, CELLS = 1 << 16, 1 << 20, 8, 1 << 20, 1 << 10, 1 << 23, 1 << 22
#: Pixels that are described at once.
STACK = 1 << 19


# ---- reading images


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels [row, column] of a PGM, PPM, BMP (24 or 32 bits) or PNG (8 bits, not interlaced); None if it can't be read."""
    if not data:
        return None
    try:
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        pass
    return None


def _grey(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


def _pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    channels = 3 if data[:2] == b"P6" else 1
    pixels = np.frombuffer(data, ">u2" if most > 255 else np.uint8, width * height * channels, at + 1).astype(np.float32) * (255 / most)
    return _grey(pixels.reshape(height, width, 3)) if channels == 3 else pixels.reshape(height, width)


def _bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    width, height, _, bits = struct.unpack_from("<iiHH", data, 18)
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    pixels = rows[:, : width * (bits // 8)].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return _grey(pixels[::-1] if height > 0 else pixels)


def _png(data: bytes) -> np.ndarray:
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack_from(">IIBBBBB", data, at + 8)
            if depth != 8 or interlace or colour not in (0, 2, 4, 6):
                raise ValueError("not supported")
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * channels + 1)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        line = raw[y, 1:].copy()
        filter_ = raw[y, 0]
        if filter_ == 2:
            line += above
        elif filter_ == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
        elif filter_ in (3, 4):
            for x in range(len(line)):
                left = int(line[x - channels]) if x >= channels else 0
                up = int(above[x])
                if filter_ == 3:
                    by = (left + up) // 2
                else:
                    corner = int(above[x - channels]) if x >= channels else 0
                    guess = left + up - corner
                    by = min((left, up, corner), key=lambda v: abs(guess - v))
                line[x] = (int(line[x]) + by) & 255
        out[y] = above = line
    pixels = out.reshape(height, width, channels)
    return _grey(pixels) if channels >= 3 else pixels[:, :, 0].astype(np.float32)


# ---- descriptors


def _padded(a: np.ndarray, by: int, **how) -> np.ndarray:
    return np.pad(a, [(0, 0)] * (a.ndim - 2) + [(by, by), (by, by)], **how)


def _blur(a: np.ndarray, by: int = 1) -> np.ndarray:
    """Of the last two axes, as are the functions below."""
    for _ in range(by):
        p = _padded(a, 1, mode="edge")
        a = (p[..., :-2, 1:-1] + 2 * p[..., 1:-1, 1:-1] + p[..., 2:, 1:-1]) / 4
        p = _padded(a, 1, mode="edge")
        a = (p[..., 1:-1, :-2] + 2 * p[..., 1:-1, 1:-1] + p[..., 1:-1, 2:]) / 4
    return a


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    rows, columns = a.shape[-2:]
    y = np.clip((np.arange(height) + 0.5) * rows / height - 0.5, 0, rows - 1)
    x = np.clip((np.arange(width) + 0.5) * columns / width - 0.5, 0, columns - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, columns - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top, low = a[..., y0, :], a[..., y1, :]
    return (top[..., x0] * (1 - fx) + top[..., x1] * fx) * (1 - fy) + (low[..., x0] * (1 - fx) + low[..., x1] * fx) * fy


@lru_cache(maxsize=1)
def _tests() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    ends = np.clip(rng.normal(0, RADIUS / 2, (2 * TESTS, 2)), -RADIUS, RADIUS)
    return ends[:TESTS], ends[TESTS:]


def corners(stack: np.ndarray, most: int | None = None) -> np.ndarray:
    """[n, 3] image, row and column of each image's strongest Harris corners that are maxima of their surroundings, strongest first."""
    height, width = stack.shape[-2:]
    most = max(CORNERS, height * width // AREA) if most is None else most
    p = _padded(stack, 1, mode="edge")
    dy, dx = (p[..., 2:, 1:-1] - p[..., :-2, 1:-1]) / 2, (p[..., 1:-1, 2:] - p[..., 1:-1, :-2]) / 2
    yy, xx, xy = _blur(dy * dy, 2), _blur(dx * dx, 2), _blur(dx * dy, 2)
    strength = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    q = _padded(strength, 2, constant_values=-np.inf)
    top = np.max([q[..., i : i + height, :] for i in range(5)], axis=0)
    top = np.max([top[..., j : j + width] for j in range(5)], axis=0)
    least = 1e-3 * np.maximum(strength.max(axis=(1, 2), keepdims=True), 1e-9)
    n, y, x = np.nonzero((strength == top) & (strength > least))
    order = np.lexsort((x, y, -strength[n, y, x], n))
    n, y, x = n[order], y[order], x[order]
    rank = np.arange(len(n)) - np.searchsorted(n, n)
    return np.stack([n, y, x], axis=1)[rank < most]


def describe_stack(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one shape: the image of each descriptor; its row, column, scale and angle, places in the image as given; its 16 bytes."""
    first, second = _tests()
    image, place, bits = [np.empty(0, np.int64)], [np.empty((0, 4))], [np.empty((0, TESTS // 8), np.uint8)]
    grid = np.arange(-RADIUS, RADIUS + 1)
    round_ = (grid[:, None] ** 2 + grid[None, :] ** 2 <= RADIUS**2).astype(np.float32)
    for scale in SCALES:
        height, width = int(stack.shape[1] * scale), int(stack.shape[2] * scale)
        if min(height, width) < 2 * RADIUS + 2:
            continue
        b = _blur(resize(stack, height, width) if scale != 1.0 else stack, 1)
        n, y, x = corners(b).T
        if not len(n):
            continue
        patches = _padded(b, RADIUS, mode="edge")[n[:, None, None], (y[:, None] + grid + RADIUS)[:, :, None], (x[:, None] + grid + RADIUS)[:, None, :]]
        centred = (patches - patches.mean(axis=(1, 2), keepdims=True)) * round_
        angle = np.arctan2((centred * grid[:, None]).sum((1, 2)), (centred * grid[None, :]).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def read(ends, n=n, y=y, x=x, b=b, cos=cos, sin=sin, height=height, width=width):
            at_y = np.rint(y[:, None] + ends[None, :, 0] * cos + ends[None, :, 1] * sin).astype(int)
            at_x = np.rint(x[:, None] - ends[None, :, 0] * sin + ends[None, :, 1] * cos).astype(int)
            return b[n[:, None], np.clip(at_y, 0, height - 1), np.clip(at_x, 0, width - 1)]

        image.append(n)
        place.append(np.stack([(y + 0.5) / scale, (x + 0.5) / scale, np.full(len(n), scale), angle], axis=1))
        bits.append(np.packbits(read(first) < read(second), axis=1))
    return np.concatenate(image), np.concatenate(place), np.concatenate(bits)


def describe(a: np.ndarray) -> list[tuple[float, float, float, float, bytes]]:
    """(row, column, scale, angle, 16 bytes) of each corner of one image."""
    _, place, bits = describe_stack(a[None])
    return [(*p, d.tobytes()) for p, d in zip(place.tolist(), bits, strict=True)]


def agreeing(matches: list[tuple[float, ...]]) -> int:
    """The most matches that one similarity explains.

    A match is (row, column, scale, angle) of one image and of the other. Each proposes
    scale, turn and shift; the proposals of every match are counted against all others.
    """
    m = np.array(matches, dtype=float)
    if len(m) < 2:
        return len(m)
    ratio, turn = np.log2(m[:, 2] / m[:, 6]), (m[:, 7] - m[:, 3] + np.pi) % (2 * np.pi) - np.pi
    grow, cos, sin = 2.0**ratio, np.cos(turn), np.sin(turn)
    best = 0
    for at in range(0, len(m), 64):
        k = slice(at, at + 64)
        # where proposal k sends every match's first place
        dy, dx = m[None, :, 0] - m[k, 0, None], m[None, :, 1] - m[k, 1, None]
        y = m[k, 4, None] + grow[k, None] * (cos[k, None] * dy + sin[k, None] * dx)
        x = m[k, 5, None] + grow[k, None] * (cos[k, None] * dx - sin[k, None] * dy)
        close = (y - m[None, :, 4]) ** 2 + (x - m[None, :, 5]) ** 2 <= 16.0
        for row in close:
            best = max(best, min(len({tuple(p) for p in np.rint(m[row, :2]).tolist()}), len({tuple(p) for p in np.rint(m[row, 4:6]).tolist()})))
    return best


# ---- Spark


_DESCRIBED = "id long, digest string, features array<struct<geo:long,d0:long,d1:long>>"
_BLOCK = ["imgs", "n", "geo", "d0", "d1"]


def pack_place(y: float, x: float, scale: float, angle: float) -> int:
    """A feature's place as one number: quarter pixels, scale and 4,096ths of a turn."""
    turn = int(round((angle + np.pi) / (2 * np.pi) * 4096)) % 4096
    return min(int(round(y * 4)), 32767) << 48 | min(int(round(x * 4)), 65535) << 32 | SCALES.index(scale) << 16 | turn


def unpack_place(geo: int) -> tuple[float, float, float, float]:
    return (geo >> 48) / 4, (geo >> 32 & 65535) / 4, SCALES[geo >> 16 & 65535], (geo & 65535) / 4096 * 2 * np.pi - np.pi


def _digest(data: bytes | None, grey: np.ndarray | None) -> str:
    """Of the pixels, or of the bytes if they can't be read."""
    if grey is None:
        return "raw:" + hashlib.sha256(data or b"").hexdigest()
    return f"{grey.shape}:" + hashlib.sha256(np.rint(grey).astype(np.uint8).tobytes()).hexdigest()


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        greys = [decode(data) for data in pdf["media"]]
        digests = [_digest(data, g) for data, g in zip(pdf["media"], greys, strict=True)]
        found: dict[str, list] = {}
        shapes: dict[tuple, list[int]] = {}
        for i, (d, g) in enumerate(zip(digests, greys, strict=True)):
            if d not in found:
                found[d] = []
                if g is not None and g.size:
                    shapes.setdefault(g.shape, []).append(i)
        for shape, members in shapes.items():
            step = max(1, STACK // (shape[0] * shape[1]))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                image, place, bits = describe_stack(np.stack([greys[i] for i in some]))
                for i, p, d in zip(image.tolist(), place.tolist(), bits.view("<i8").tolist(), strict=True):
                    found[digests[some[i]]].append({"geo": pack_place(*p), "d0": d[0], "d1": d[1]})
        yield pd.DataFrame({"id": pdf["id"], "digest": digests, "features": [found[d] for d in digests]})


def _places(geo: np.ndarray) -> np.ndarray:
    """unpack_place() of many: [n, 4]."""
    return np.stack([(geo >> 48) / 4, (geo >> 32 & 65535) / 4, np.array(SCALES)[geo >> 16 & 65535], (geo & 65535) / 4096 * 2 * np.pi - np.pi], axis=1)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Images (img, geo, d0, d1 of each feature) put together to blocks of about so many features."""

    def block(held):
        n = np.array([len(g) for _, g, _, _ in held], np.int32)
        whole = [np.concatenate([h[i] for h in held]).astype(np.int64).tobytes() for i in (1, 2, 3)]
        return pd.DataFrame({"block": [held[0][0]], "imgs": [np.array([h[0] for h in held], np.int64).tobytes()], "n": [n.tobytes()], "geo": [whole[0]], "d0": [whole[1]], "d1": [whole[2]]})

    held, size = [], 0
    for pdf in batches:
        for row in zip(pdf["img"], pdf["geo"], pdf["d0"], pdf["d1"], strict=True):
            if held and size + len(row[1]) > BLOCK:
                yield block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield block(held)


class _Block:
    """Images with their features, these in the order of each part too; a feature's place, and that to whole pixels as one number."""

    def __init__(self, imgs: np.ndarray, n: np.ndarray, geo: np.ndarray, bits: np.ndarray):
        self.imgs, self.n, self.geo, self.bits = imgs, n, geo, np.ascontiguousarray(bits.T)
        self.of = np.repeat(np.arange(len(n)), n)
        self.place = _places(geo)
        row, column = np.rint(self.place[:, :2]).astype(np.int64).T
        self.pixel = (row << 21) + column
        # an image's pixels that have features, numbered; of 64 or fewer each has a bit of its own
        at, number = np.unique((self.of << 42) + self.pixel, return_inverse=True)
        number -= np.searchsorted(at, np.arange(len(n)) << 42)[self.of]
        self.bit, self.fits = np.uint64(1) << (number & 63).astype(np.uint64), np.bincount(at >> 42, minlength=len(n)) <= 64
        words = [(self.bits[p // 2] >> np.uint64(32 * (p % 2))).astype(np.uint32) for p in range(PARTS)]
        self.order = [np.argsort(w, kind="stable") for w in words]
        self.keys = [np.unique(w[o], return_index=True, return_counts=True) for w, o in zip(words, self.order, strict=True)]

    @classmethod
    def of_row(cls, imgs: bytes, n: bytes, geo: bytes, d0: bytes, d1: bytes) -> _Block:
        return cls(np.frombuffer(imgs, np.int64), np.frombuffer(n, np.int32), np.frombuffer(geo, np.int64), np.stack([np.frombuffer(d, np.uint64) for d in (d0, d1)], axis=1))

    def halves(self) -> tuple[_Block, _Block]:
        k = len(self.n) // 2
        at = int(self.n[:k].sum())
        return _Block(self.imgs[:k], self.n[:k], self.geo[:at], self.bits[:, :at].T), _Block(self.imgs[k:], self.n[k:], self.geo[at:], self.bits[:, at:].T)


def _met(a: _Block, b: _Block, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of either block that have a part in common, not too many pairs at a time: a column and a row, or pairs one by one."""
    (ka, at_a, na), (kb, at_b, nb) = a.keys[part], b.keys[part]
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    at_a, na, at_b, nb = at_a[i], na[i], at_b[j], nb[j]
    oa, ob = a.order[part], b.order[part]
    pairs = na * nb
    large = pairs >= DENSE
    for x, n, y, m in zip(at_a[large], na[large], at_b[large], nb[large], strict=True):
        step = max(1, (AT_ONCE >> 3) // m)  # what a core's own cache holds
        for lo in range(x, x + n, step):
            yield oa[lo : min(lo + step, x + n), None], ob[None, y : y + m]
    at_a, at_b, nb, pairs = at_a[~large], at_b[~large], nb[~large], pairs[~large]
    for lo in range(0, len(pairs), AT_ONCE // DENSE):
        some = pairs[lo : lo + AT_ONCE // DENSE]
        key = np.repeat(np.arange(lo, lo + len(some)), some)
        place = np.arange(len(key)) - np.repeat(np.cumsum(some) - some, some)
        yield oa[at_a[key] + place // nb[key]], ob[at_b[key] + place % nb[key]]


def _matches(a: _Block, b: _Block, bits: int, both: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of images of two blocks that match, each pair once, the lesser image in the first block (in either, if asked); None if they are too many to hold."""
    left, right, size = [np.empty(0, np.int32)], [np.empty(0, np.int32)], 0
    for part in range(PARTS):
        for x, y in _met(a, b, part):
            if x.ndim == 2:
                # first by the half of the string that has no part in common
                half = 1 - part // 2
                at = np.flatnonzero(np.bitwise_count(a.bits[half][x] ^ b.bits[half][y]) <= bits)
                row = at // y.shape[1]
                x, y = x[row, 0], y[0, at - row * y.shape[1]]
            unlike = a.bits[0][x] ^ b.bits[0][y], a.bits[1][x] ^ b.bits[1][y]
            new = np.bitwise_count(unlike[0]) + np.bitwise_count(unlike[1]) <= bits
            # what shares an earlier part too has been met there
            for p in range(part):
                new &= unlike[p // 2] & np.uint64(0xFFFFFFFF << 32 * (p % 2)) != 0
            x, y = x[new].astype(np.int32), y[new].astype(np.int32)
            if not both:
                lesser = a.imgs[a.of[x]] < b.imgs[b.of[y]]
                x, y = x[lesser], y[lesser]
            left.append(x)
            right.append(y)
            size += len(left[-1])
            if size > HELD and len(a.n) > 1:
                return None
    return np.concatenate(left), np.concatenate(right)


def _few(run: np.ndarray, pixel: np.ndarray, runs: int) -> np.ndarray:
    """How many places each run has, to whole pixels."""
    at = np.sort((run.astype(np.int64) << 42) + pixel)
    return np.bincount(at[np.diff(at, prepend=-1) != 0] >> 42, minlength=runs)


class _Proposals:
    """Scale, turn and shift that each match of some runs proposes, a run n matches long."""

    def __init__(self, p: np.ndarray, q: np.ndarray, p_pixel: np.ndarray, q_pixel: np.ndarray, n: np.ndarray):
        self.p, self.q, self.p_pixel, self.q_pixel, self.n = p, q, p_pixel, q_pixel, n
        self.start = np.cumsum(n) - n
        (self.y0, self.x0, s0, a0), (self.y1, self.x1, s1, a1) = p.T.copy(), q.T.copy()
        grow, turn = s0 / s1, (a1 - a0 + np.pi) % (2 * np.pi) - np.pi
        self.cos, self.sin = grow * np.cos(turn), grow * np.sin(turn)

    def close(self, each: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether what match `each` proposes sends the first place of `other` to its second."""
        dy, dx, cos, sin = self.y0[other] - self.y0[each], self.x0[other] - self.x0[each], self.cos[each], self.sin[each]
        return (self.y1[each] + (cos * dy + sin * dx) - self.y1[other]) ** 2 + (self.x1[each] + (cos * dx - sin * dy) - self.x1[other]) ** 2 <= 16.0

    def followed(self, agree: int) -> np.ndarray:
        """Matches whose proposal `agree` matches of the run follow, itself one of them; one that too many do not is not tried further."""
        n, start = np.repeat(self.n, self.n), np.repeat(self.start, self.n)
        got, left = np.ones(len(n), np.int64), np.arange(len(n))
        for step in range(1, int(self.n.max(initial=0))):
            left = left[n[left] > step]
            other = left + step
            other -= np.where(other - start[left] < n[left], 0, n[left])
            got[left] += self.close(left, other)
            left = left[got[left] + n[left] - 1 - step >= agree]
        return np.flatnonzero(got >= agree)

    def agreeing(self, agree: int) -> np.ndarray:
        """Of each run, whether agreeing() gives `agree` or more."""
        out, each = np.zeros(len(self.n), bool), self.followed(agree)
        run = np.repeat(np.arange(len(self.n)), self.n)
        work = np.cumsum(self.n[run[each]].astype(np.int64))
        cuts = np.searchsorted(work, np.arange(AT_ONCE, int(work[-1]), AT_ONCE)) if len(each) else []
        for some in np.split(each, cuts):
            if not len(some):
                continue
            m = self.n[run[some]]
            k = np.repeat(np.arange(len(some)), m)
            other = self.start[run[some]][k] + np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)
            near = self.close(some[k], other)
            k, other = k[near], other[near]
            enough = (np.bincount(k, minlength=len(some)) >= agree)[k]
            k, other = k[enough], other[enough]
            most = np.minimum(_few(k, self.p_pixel[other], len(some)), _few(k, self.q_pixel[other], len(some)))
            out[run[some[most >= agree]]] = True
        return out


def _find(up: dict, x: int) -> int:
    while up.setdefault(x, x) != x:
        up[x] = x = up[up[x]]
    return x


def _links(a: _Block, b: _Block, bits: int, agree: int, up: dict, both: bool = False) -> Iterator[tuple[int, int]]:
    """Links of images of two blocks, the lesser in the first (in either, if asked: of blocks that share no image), that connect what all of their links do."""
    met = _matches(a, b, bits, both)
    if met is None:
        for half in a.halves():
            yield from _links(half, b, bits, agree, up, both)
        return
    x, y = met
    pair = a.of[x] * len(b.n) + b.of[y]
    # most pairs have few matches
    cell = pair if len(a.n) * len(b.n) < CELLS else pair % (CELLS - 3)
    many = np.bincount(cell)[cell] >= agree if len(cell) else np.empty(0, bool)
    x, y, pair = x[many], y[many], pair[many]
    order = np.argsort(pair)
    x, y, pair = x[order], y[order], pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(first, append=len(pair))
    # and many of the rest have few places
    keep = np.ones(len(n), bool)
    for block, at in ((a, x), (b, y)) if len(n) else ():
        keep &= (np.bitwise_count(np.bitwise_or.reduceat(block.bit[at], first)) >= agree) | ~block.fits[block.of[at[first]]]
    of = np.repeat(keep, n)
    x, y, n = x[of], y[of], n[keep]
    u, v = a.imgs[a.of[x]], b.imgs[b.of[y]]
    one, other = a.place[x], b.place[y]
    # agreement is judged from the lesser image to the other
    turned = u > v
    one[turned], other[turned] = other[turned], one[turned]
    p, q = a.pixel[x], b.pixel[y]
    p, q = np.where(turned, q, p), np.where(turned, p, q)
    found = _Proposals(one, other, p, q, n).agreeing(agree)
    for i in (np.cumsum(n) - n)[found]:
        s, t = int(u[i]), int(v[i])
        if _find(up, s) != _find(up, t):
            up[_find(up, s)] = _find(up, t)
            yield min(s, t), max(s, t)


def _compared(bits: int, agree: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, _Block] = {}

        def block(name: int, columns: list) -> _Block:
            """The block, from those used last if it is one of them."""
            found = kept.pop(name, None) or _Block.of_row(*columns)
            if len(kept) >= KEPT:
                kept.pop(next(iter(kept)))
            kept[name] = found
            return found

        for pdf in batches:
            for row in pdf.to_dict("records"):
                a, b = (block(row[side + "block"], [row[side + c] for c in _BLOCK]) for side in ("", "o_"))
                yield pd.DataFrame(_links(a, b, bits, agree, {}, row["block"] != row["o_block"]), columns=["u", "v"], dtype="int64")

    return run


def media_classes(media: DataFrame, id_col: str = "media_id", media_col: str = "media", bits: int = BITS, agree: int = AGREE) -> DataFrame:
    """(id, class_id, n_media): one row per row with an id; the class's smallest id and how many rows it has.

    Media with equal pixels (equal bytes, if they can't be read or are null) are one
    representative; representatives link if `agree` descriptor matches have one scale,
    turn and shift, and classes are what links connect. All pairs of representatives
    are compared: these lie in blocks, each block meets each in a task that holds only
    the two, and of what links them a forest is kept. So the work grows with the square
    of the unlike images, memory and shuffled data do not. Ids are whole numbers or
    text that reads as such; an id that repeats with other pixels is in the class of
    either. Rows without an id are left out; repeated rows stay; an image of any size
    is described whole; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    require(media, id_col, media_col)
    rows = media.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    seen = checkpoint(rows.mapInPandas(_described, _DESCRIBED).withColumn("img", F.xxhash64("digest")), TEXTS)
    named = checkpoint(seen.groupBy("img").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    # equal pixels have equal features
    features = seen.where(F.size("features") >= agree).select("img", "features").groupBy("img").agg(F.any_value("features").alias("f"))
    # as many partitions as give every core some pairs of them, so that none waits long for the last, more if they would be large
    n, cores = features.agg(F.sum(F.size("f"))).first()[0] or 0, media.sparkSession.sparkContext.defaultParallelism
    dealt = features.select("img", "f.geo", "f.d0", "f.d1").repartition(max(ceil((12 * cores) ** 0.5), -(-n // SHARE)))
    blocks = checkpoint(dealt.mapInPandas(_blocks, "block long, imgs binary, n binary, geo binary, d0 binary, d1 binary"), TEXTS)
    others = blocks.select([F.col(c).alias(f"o_{c}") for c in blocks.columns])
    met = blocks.join(others.hint("shuffle_replicate_nl"), F.col("block") <= F.col("o_block"))
    links = checkpoint(met.mapInPandas(_compared(bits, agree), "u long, v long"), 4)
    parts = checkpoint(connected_components(links))
    of = named.join(parts.select(F.col("node").alias("img"), "component"), "img", "left").withColumn("component", F.coalesce("component", "img"))
    classes = of.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_media"))
    return seen.select("id", "img").join(checkpoint(of.join(classes, "component").select("img", "class_id", "n_media")), "img").select(F.col("id").alias(id_col), "class_id", "n_media")


def draw(vector, size: int = 72) -> bytes | None:
    """A PGM of a vector laid out as a square of grey levels, enlarged; None if it has no square of finite numbers."""
    values = np.asarray(vector if vector is not None else [], dtype=np.float64)
    side = int(len(values) ** 0.5)
    if side < 2 or side * side != len(values) or not np.isfinite(values).all():
        return None
    spread = max(values.max() - values.min(), 1e-12)
    grey = resize(((values - values.min()) / spread * 255).reshape(side, side), size, size)
    return b"P5 %d %d 255\n" % (size, size) + np.rint(grey).astype(np.uint8).tobytes()


@F.pandas_udf(T.BinaryType())
def draw_vector(vectors: pd.Series) -> pd.Series:
    return pd.Series([draw(v) for v in vectors], dtype=object)
