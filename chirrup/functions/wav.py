"""RIFF/WAVE headers and PCM samples, for use inside tasks."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

# Fixed values of the WAVE format: format codes, and bytes per sample with the full-scale value.
PCM, IEEE_FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
FULL_SCALE = {1: 128.0, 2: 32768.0, 3: 8388608.0, 4: 2147483648.0}


#: The size that a RIFF chunk gives when it does not know, or when a 64-bit table (RF64) has it.
UNKNOWN = 0xFFFFFFFF
#: Bytes of a file's head that are read at a time while looking for its chunks.
HEAD = 512


def header(content: bytes) -> dict:
    """Rate, channels, frames, sample kind and where the samples lie, from the chunk table alone."""
    return scan_header(lambda at, count: content[at : at + count], len(content))


def scan_header(read: Callable[[int, int], bytes], size: int) -> dict:
    """The header of a file of `size` bytes, of which `read(at, count)` gives parts.

    Chunks other than the format are skipped over, not read.  RF64 files, whose
    sizes stand in a table of 64-bit numbers, are read too.
    """
    head = read(0, HEAD)

    def part(at, count):
        return head[at : at + count] if at + count <= len(head) else read(at, count)

    if part(0, 4) not in (b"RIFF", b"RF64") or part(8, 4) != b"WAVE":
        raise ValueError("not_a_wav_file")
    at, fmt, data, wide = 12, None, None, None
    while at + 8 <= size and data is None:
        name, length = struct.unpack("<4sI", part(at, 8))
        if name == b"ds64" and length >= 16:
            wide = struct.unpack("<Q", part(at + 16, 8))[0]
        elif name == b"fmt " and at + 24 <= size:
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", part(at + 8, 16))
            if code == EXTENSIBLE and length >= 26:
                code = struct.unpack("<H", part(at + 32, 2))[0]
            fmt = (code, channels, rate, align, bits)
        elif name == b"data":
            if length == UNKNOWN and wide is not None:
                length = wide
            data = (at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    if fmt is None or data is None:
        raise ValueError("missing_wav_chunk")
    code, channels, rate, align, bits = fmt
    known = (code == PCM and bits in (8, 16, 24, 32)) or (code == IEEE_FLOAT and bits in (32, 64))
    if not known or channels < 1 or align != channels * bits // 8:
        raise ValueError("unsupported_wav_format")
    return dict(sample_rate=rate, channels=channels, frames=data[1] // align, code=code, bits=bits, offset=data[0], align=align)


def samples(content: bytes) -> tuple[np.ndarray, dict]:
    """Interleaved float32 samples at full scale 1, and the header."""
    h = header(content)
    return decode(content[h["offset"] : h["offset"] + h["frames"] * h["align"]], h), h


def decode(raw: bytes, h: dict) -> np.ndarray:
    """Whole frames of sample bytes as interleaved float32 samples at full scale 1."""
    width = h["bits"] // 8
    if h["code"] == IEEE_FLOAT:
        return np.frombuffer(raw, dtype=f"<f{width}").astype(np.float32)
    if width == 1:
        values = np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128.0
    elif width == 3:
        parts = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float64)
    else:
        values = np.frombuffer(raw, dtype=f"<i{width}").astype(np.float64)
    return (values / FULL_SCALE[width]).astype(np.float32)


def wrap(pcm: bytes, rate: int, channels: int = 1, bits: int = 16, code: int = PCM) -> bytes:
    """A WAVE file around sample bytes."""
    align = channels * bits // 8
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * align, align, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm + b"\0" * (len(pcm) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body
