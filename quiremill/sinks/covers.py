"""Cover pictures: the first page picture with contrast, else one made from the title."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

WIDTH, HEIGHT = 160, 240
MIN_CONTRAST = 8.0


def has_contrast(grey: np.ndarray) -> bool:
    """Whether a grey picture is more than an empty page."""
    return bool(grey.size) and float(grey.std()) >= MIN_CONTRAST


def png(grey: np.ndarray) -> bytes:
    """A grey picture as PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = grey.shape
    rows = b"".join(b"\0" + r.tobytes() for r in grey.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def make_cover(title: str, author: str = "") -> bytes:
    """A picture that title and author alone decide: bars as long as their words."""
    digest = hashlib.sha256(f"{title}\0{author}".encode()).digest()
    grey = np.full((HEIGHT, WIDTH), 190 + digest[0] % 50, np.uint8)
    y = 40
    for word in [*title.split(), "", *author.split()][:16]:
        n = min(WIDTH - 20, 8 * len(word))
        grey[y : y + 8, (WIDTH - n) // 2 : (WIDTH + n) // 2] = 30 + digest[y % 32] % 60
        y += 12
    return png(grey)
