"""Label numbers in pictures: two channels, and PNG files without an imaging library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def red(label: Column) -> Column:
    return (label % 256).cast("int")


def green(label: Column) -> Column:
    return F.floor(label / 256).cast("int")


def label_of(r: Column, g: Column) -> Column:
    return r.cast("int") + 256 * g.cast("int")


def class_of(r: Column, g: Column) -> Column:
    """The class number in scene annotations whose red channel counts in tens."""
    return F.floor(r.cast("int") / 10).cast("int") * 256 + g.cast("int")


def encode_png(rgb: np.ndarray) -> bytes:
    """An [y, x, 3] picture of bytes as a PNG file."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgb, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The [y, x, channels] bytes of an 8-bit PNG file that isn't interlaced and has no palette."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[2] != 8 or head[3] == 3 or head[6]:
        raise ValueError("this kind of PNG isn't supported")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros_like(line)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            now = np.zeros_like(line)
            for x in range(len(line)):
                left = now[x - channels] if x >= channels else 0
                corner = up[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                now[x] = (line[x] + guess) & 255
            out[y] = now
    return out.reshape(h, w, channels)


def encode_labels(labels: np.ndarray) -> bytes:
    """A label map as a picture: red holds the low byte, green the high one."""
    labels = np.asarray(labels, np.int64)
    return encode_png(np.stack([labels % 256, labels // 256 % 256, np.zeros_like(labels)], 2).astype(np.uint8))


def decode_labels(data: bytes) -> np.ndarray:
    rgb = decode_png(data).astype(np.int64)
    return rgb[:, :, 0] + 256 * rgb[:, :, 1]
