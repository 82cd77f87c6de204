"""A baseline JPEG encoder for arrays: 8 x 8 cosine transform, no subsampling, the standard's
example tables. Written from the standard (ITU T.81), for images of an output's size."""

from __future__ import annotations

import struct

import numpy as np

# The example quantisation tables of the standard, for luminance and chrominance.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Positions of a block in the order of rising frequency, by diagonals in turning direction.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The symbols that a block's values may need: sizes of differences, and zero runs with sizes.
DIFFERENCES = list(range(12))
RUNS = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]


def huffman(symbols: list[int], often: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(codes of each length 1..16, symbols in order, symbol -> (code, length)): more frequent symbols
    are not longer, no code is all ones and none has over 16 bits."""
    order = sorted(symbols, key=lambda s: (-often.get(s, 0), s))
    weights = [often.get(s, 0) * 64 + 1 for s in order] + [1]  # the last one takes the code of ones
    lengths = _lengths(weights)
    counts = [sum(n == k for n in lengths[:-1]) for k in range(1, 17)]
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in order[at : at + n]:
            table[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return counts, order, table


def _lengths(weights: list[int], most: int = 16) -> list[int]:
    """Code lengths of at most `most` bits, rising, by merging packages of the least weights."""
    items = sorted((w, (k,)) for k, w in enumerate(weights))
    packages = items
    for _ in range(most - 1):
        merged = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(packages[0::2], packages[1::2], strict=False)]
        packages = sorted(items + merged)
    length = [0] * len(weights)
    for _, members in packages[: 2 * len(weights) - 2]:
        for k in members:
            length[k] += 1
    return sorted(length)


def _quality(table: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((np.array(table) * scale + 50) / 100), 1, 255)


def _transform() -> np.ndarray:
    k, n = np.indices((8, 8))
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients, a row of 64 in zigzag order for each block in row-major order."""
    h, w = plane.shape
    own = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    own = own.reshape(own.shape[0] // 8, 8, own.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    t = _transform()
    return np.rint((t @ own @ t.T).reshape(-1, 64) / table).astype(int)[:, ZIGZAG]


def _symbols(blocks: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each block (symbol, value bits, number of bits): the first is the mean's difference."""
    out, last = [], 0
    for block in blocks.tolist():
        own = []

        def put(run: int, value: int) -> None:
            size = abs(value).bit_length()
            own.append((run << 4 | size, value if value > 0 else value + (1 << size) - 1, size))

        put(0, block[0] - last)
        last, run = block[0], 0
        end = max((k for k in range(1, 64) if block[k]), default=0)
        for value in block[1 : end + 1]:
            if value == 0:
                run += 1
                continue
            own.extend([(0xF0, 0, 0)] * (run // 16))
            put(run % 16, value)
            run = 0
        if end < 63:
            own.append((0x00, 0, 0))
        out.append(own)
    return out


def jpeg_bytes(image: np.ndarray, quality: int = 90) -> bytes:
    """An RGB(A) array (h, w, 3 or 4) of bytes; alpha is dropped."""
    quality = min(max(quality, 1), 100)
    r, g, b = (image[..., k].astype(float) for k in range(3))
    planes = (0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b)
    tables = [_quality(t, quality) for t in (LUMA, CHROMA)]
    coded = [_symbols(_blocks(p, tables[k > 0])) for k, p in enumerate(planes)]
    codes = []
    for parts in (coded[:1], coded[1:]):
        for first in (True, False):
            often: dict[int, int] = {}
            for part in parts:
                for block in part:
                    for symbol, _, _ in block[:1] if first else block[1:]:
                        often[symbol] = often.get(symbol, 0) + 1
            codes.append(huffman(DIFFERENCES if first else RUNS, often))
    bits: list[str] = []
    for blocks in zip(*coded, strict=True):
        for k, block in enumerate(blocks):
            for i, (symbol, value, size) in enumerate(block):
                code, length = codes[2 * (k > 0) + (i > 0)][2][symbol]
                bits.append(f"{code:0{length}b}")
                if size:
                    bits.append(f"{value:0{size}b}")
    whole = "".join(bits)
    whole += "1" * (-len(whole) % 8)
    body = int(whole, 2).to_bytes(len(whole) // 8, "big").replace(b"\xff", b"\xff\x00") if whole else b""
    h, w = image.shape[:2]
    part = lambda marker, data: b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for k, table in enumerate(tables):
        out += part(0xDB, bytes([k]) + bytes(table[ZIGZAG].astype(np.uint8)))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for k, (counts, order, _) in enumerate(codes):
        out += part(0xC4, bytes([(k % 2) << 4 | k // 2]) + bytes(counts) + bytes(order))
    return out + part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"
