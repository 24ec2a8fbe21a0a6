"""Wave files as blocks of samples: a Python data source for Spark.

``spark.read.format("pcm")`` reads RIFF, RF64 and BW64 wave files (16-, 24- and
32-bit integers, 32-bit floats) and CAF files (32-bit float, little-endian);
each partition seeks to its own range of frames. ``df.write.format("pcm")``
writes blocks back as one file a scene, integers or floats.

Files are opened by path, so they have to be on a file system that all workers
mount.
"""

from __future__ import annotations

import glob
import os
import shutil
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PCM_BLOCKS = (
    "scene_id string, block_no long, start_frame long, frames int, channels int, sample_rate int, samples array<float>"
)


@dataclass
class Layout:
    rate: int
    channels: int
    bits: int
    is_float: bool
    start: int
    frames: int


def chunks(f, size: int):
    """``id, place, bytes`` of the chunks of a wave file; long sizes from ds64."""
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:] != b"WAVE":
        raise ValueError("not a wave file")
    long_data, at = None, 12
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            long_data = struct.unpack("<QQQ", f.read(24))[1]
        if name == b"data" and n == 0xFFFFFFFF and long_data is not None:
            n = long_data
        n = min(n, size - at - 8)
        yield name, at + 8, n
        at += 8 + n + (n & 1)


def caf_chunks(f, size: int):
    if f.read(8)[:4] != b"caff":
        raise ValueError("not a CAF file")
    at = 8
    while at + 12 <= size:
        f.seek(at)
        name, n = struct.unpack(">4sq", f.read(12))
        n = size - at - 12 if n < 0 else n
        yield name, at + 12, n
        at += 12 + n


def layout(path: str) -> Layout:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        found = {}
        if path.lower().endswith(".caf"):
            for name, at, n in caf_chunks(f, size):
                found.setdefault(name, (at, n))
            f.seek(found[b"desc"][0])
            rate, kind, flags, _, _, channels, bits = struct.unpack(">d4sIIIII", f.read(32))
            if kind != b"lpcm" or flags & 3 != 3 or bits != 32:
                raise ValueError("only little-endian 32-bit float CAF files are read")
            at, n = found[b"data"]
            return Layout(int(rate), channels, 32, True, at + 4, (n - 4) // (4 * channels))
        for name, at, n in chunks(f, size):
            found.setdefault(name, (at, n))
        f.seek(found[b"fmt "][0])
        tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
        if tag == 0xFFFE:
            f.seek(found[b"fmt "][0] + 24)
            (tag,) = struct.unpack("<H", f.read(2))
        at, n = found[b"data"]
        return Layout(rate, channels, bits, tag == 3, at, n // (channels * bits // 8))


def text_chunk(path: str, name: bytes = b"axml") -> bytes | None:
    """A metadata chunk of a wave file, such as its scene description."""
    with open(path, "rb") as f:
        for found, at, n in chunks(f, os.path.getsize(path)):
            if found == name:
                f.seek(at)
                return f.read(n)
    return None


def channel_uids(path: str) -> dict[str, int]:
    """Track uid to 0-based channel from the ``chna`` chunk; the last entry of a uid wins."""
    data = text_chunk(path, b"chna") or b"\0\0\0\0"
    _, n = struct.unpack_from("<HH", data)
    out = {}
    for k in range(n):
        index, uid = struct.unpack_from("<H12s", data, 4 + 40 * k)
        if index:
            out[uid.decode("latin-1").rstrip(" \0").upper()] = index - 1
    return out


def read_frames(path: str, at: Layout, lo: int, hi: int) -> np.ndarray:
    """Frames [lo, hi) as float32, interleaved."""
    width = at.bits // 8
    with open(path, "rb") as f:
        f.seek(at.start + lo * at.channels * width)
        data = f.read((hi - lo) * at.channels * width)
    if at.is_float:
        return np.frombuffer(data, "<f4")
    if width == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = np.zeros((len(raw), 4), np.uint8)
        x[:, 1:] = raw
        return (x.view("<i4").reshape(-1) >> 8).astype(np.float32) / np.float32(2**23)
    return np.frombuffer(data, f"<i{width}").astype(np.float32) / np.float32(2 ** (at.bits - 1))


@dataclass
class _Range(InputPartition):
    path: str
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.block = int(options.get("block_frames", 4096))
        self.blocks = int(options.get("blocks_per_partition", 256))
        path = options["path"]
        self.paths = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
        self.lo, self.hi = int(options.get("start_frame", 0)), options.get("end_frame")

    def partitions(self):
        out = []
        for path in self.paths:
            end = layout(path).frames if self.hi is None else min(int(self.hi), layout(path).frames)
            step = self.block * self.blocks
            first = self.lo // self.block * self.block
            out += [_Range(path, lo, min(lo + step, end)) for lo in range(first, end, step)]
        return out

    def read(self, partition):
        at = layout(partition.path)
        scene = os.path.splitext(os.path.basename(partition.path))[0]
        for lo in range(partition.lo, partition.hi, self.block):
            hi = min(lo + self.block, partition.hi)
            lo = max(lo, self.lo)  # the first block may begin inside the grid of blocks
            x = read_frames(partition.path, at, lo, hi)
            cols = [[scene], [lo // self.block], [lo], [hi - lo], [at.channels], [at.rate], [x]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
            names = [c.split()[0] for c in PCM_BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def header(rate: int, channels: int, bits: int, is_float: bool, data_bytes: int) -> bytes:
    """A wave header; BW64 with long sizes where 32 bits do not do."""
    fmt = struct.pack("<HHIIHH", 3 if is_float else 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    long_ = data_bytes + 100 > 0xFFFFFFFF
    body = b"WAVE"
    if long_:
        body += b"ds64" + struct.pack("<IQQQI", 28, data_bytes + 80, data_bytes, 0, 0)
    body += b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", 0xFFFFFFFF if long_ else data_bytes)
    size = 0xFFFFFFFF if long_ else len(body) + data_bytes
    return (b"BW64" if long_ else b"RIFF") + struct.pack("<I", size) + body


def caf_header(rate: int, channels: int, bits: int, is_float: bool, data_bytes: int) -> bytes:
    """A CAF header for little-endian floats, which are what is read; its sizes have 64 bits anyway."""
    if (bits, is_float) != (32, True):
        raise ValueError("CAF files are written as 32-bit floats")
    desc = struct.pack(">d4sIIIII", rate, b"lpcm", 3, channels * bits // 8, 1, channels, bits)
    return b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">qI", data_bytes + 4, 0)


#: containers that can be written: how a file begins
HEADERS = {"wav": header, "caf": caf_header}


def encoded(x: np.ndarray, bits: int, is_float: bool) -> bytes:
    if is_float:
        return x.astype("<f4").tobytes()
    full = 2 ** (bits - 1) - 1
    y = np.clip(x.astype(np.float64), -1, 1) * full
    y = (np.sign(y) * np.floor(np.abs(y) + 0.5)).astype("<i4")
    if bits == 24:
        return y.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return y.astype(f"<i{bits // 8}").tobytes()


@dataclass
class _Written(WriterCommitMessage):
    parts: list


class _Writer(DataSourceWriter):
    """Tasks write each block to a part file; the commit puts the parts of a
    scene in order behind a header, under a name that appears only when whole."""

    def __init__(self, options: dict):
        self.path, self.bits = options["path"], int(options.get("bits", 32))
        self.is_float = options.get("encoding", "float") == "float"
        self.container = options.get("container", "wav")
        if self.container not in HEADERS:
            raise ValueError(f"no such container: {self.container}")
        HEADERS[self.container](1, 1, self.bits, self.is_float, 0)  # says what it cannot hold before anything is written
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows):
        from pyspark import TaskContext

        parts, attempt = [], TaskContext.get().taskAttemptId()
        for r in rows:
            name = os.path.join(self.path, f".{r['scene_id']}.{r['block_no']}.{attempt}.part")
            data = encoded(np.array(r["samples"], np.float32), self.bits, self.is_float)
            with open(name, "wb") as f:
                f.write(data)
            parts.append((r["scene_id"], r["start_frame"], name, len(data), r["sample_rate"], r["channels"]))
        return _Written(parts)

    def commit(self, messages):
        scenes: dict = {}
        for m in messages:
            for scene, start, *rest in m.parts:
                scenes.setdefault(scene, []).append((start, *rest))
        for scene, parts in scenes.items():
            parts.sort()
            _, _, _, rate, channels = parts[0]
            whole = os.path.join(self.path, f".{scene}.{self.container}.part")
            with open(whole, "wb") as out:
                out.write(HEADERS[self.container](rate, channels, self.bits, self.is_float, sum(p[2] for p in parts)))
                for _, name, *_ in parts:
                    with open(name, "rb") as f:
                        shutil.copyfileobj(f, out)
                    os.remove(name)
            os.replace(whole, os.path.join(self.path, f"{scene}.{self.container}"))

    def abort(self, messages):
        for m in messages:
            for part in m.parts if m else []:
                if os.path.exists(part[2]):
                    os.remove(part[2])


class PcmSource(DataSource):
    @classmethod
    def name(cls):
        return "pcm"

    def schema(self):
        return PCM_BLOCKS

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark) -> None:
    spark.dataSource.register(PcmSource)
