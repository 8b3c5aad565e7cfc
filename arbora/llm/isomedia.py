"""Media columns: ISO base media containers (ISO/IEC 14496-12).

`tracks` walks the nested boxes of a container and decodes the sample tables of each track (time to sample, sync
samples, sample to chunk, sample sizes, chunk offsets of 32 or 64 bits): codec, duration and the byte ranges of key
frames come from the boxes alone and no payload byte is decoded. `store` writes the samples of one track as a container
and `payload` reads them back by the tables.

Defined cases: null media have no tracks, and null digests, as have containers without a track or that can't be read; in
`tracks`, a container that is cut short or whose tables contradict each other gives one row with `error` set and nulls
elsewhere; unknown boxes are passed over; a box of size 0 reaches to its parent's end; a
track without a sync table has only key frames. Ids may repeat or be null: each row is walked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"})


@dataclass(frozen=True)
class Layout:
    """How `store` lays samples out: frames of side x side 8-bit grey samples."""

    side: int = 24
    timescale: int = 25
    samples_per_chunk: int = 16
    key_every: int = 12

    @property
    def sample_bytes(self) -> int:
        return self.side * self.side


class BadMedia(ValueError):
    pass


# --- reading ---------------------------------------------------------------------------------


def boxes(data: bytes, first: int, last: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of the boxes in data[first:last]."""
    while first < last:
        if last - first < 8:
            raise BadMedia("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, first)
        head = 8
        if size == 1:
            if last - first < 16:
                raise BadMedia("a box header is cut short")
            (size,), head = struct.unpack_from(">Q", data, first + 8), 16
        elif size == 0:
            size = last - first
        if kind == b"uuid":
            head += 16
        if size < head or first + size > last:
            raise BadMedia(f"box {kind!r} reaches beyond its parent")
        yield kind, first + head, first + size
        first += size


def tree(data: bytes, first: int, last: int) -> dict[bytes, list]:
    """Boxes by type; those that hold boxes as trees, others as (first, end)."""
    out: dict[bytes, list] = {}
    for kind, a, b in boxes(data, first, last):
        out.setdefault(kind, []).append(tree(data, a, b) if kind in CONTAINERS else (a, b))
    return out


def _numbers(data: bytes, at: int, end: int, count: int, kind: str) -> np.ndarray:
    kind_ = np.dtype(kind)
    if count * kind_.itemsize > end - at:
        raise BadMedia("a table is cut short")
    return np.frombuffer(data, kind_, count, at).astype(np.int64)


def _table(data: bytes, box: tuple[int, int], columns: int, kind: str = ">u4") -> np.ndarray:
    """Rows of a full box with a 32-bit row count."""
    a, b = box
    if b - a < 8:
        raise BadMedia("a table is cut short")
    (count,) = struct.unpack_from(">I", data, a + 4)
    return _numbers(data, a + 8, b, count * columns, kind).reshape(count, columns)


@dataclass
class Track:
    track_id: int
    handler: str
    codec: str
    timescale: int
    duration: int
    sizes: np.ndarray
    offsets: np.ndarray
    times: np.ndarray
    keys: np.ndarray  # sample numbers from 0

    def key_ranges(self) -> list[tuple[int, int, int, int]]:
        """(sample number from 1, time, first byte, bytes) of the key frames."""
        k = self.keys
        return list(zip((k + 1).tolist(), self.times[k].tolist(), self.offsets[k].tolist(), self.sizes[k].tolist(), strict=True))


def _one(t: dict, kind: bytes):
    if kind not in t:
        raise BadMedia(f"box {kind!r} is missing")
    return t[kind][0]


def _track(data: bytes, trak: dict) -> Track:
    a, _ = _one(trak, b"tkhd")
    (track_id,) = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))
    mdia = _one(trak, b"mdia")
    a, _ = _one(mdia, b"mdhd")
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = _one(mdia, b"hdlr")
    handler = data[a + 8 : a + 12].decode("latin-1")
    stbl = _one(_one(mdia, b"minf"), b"stbl")
    a, b = _one(stbl, b"stsd")
    codec = next((kind.decode("latin-1") for kind, _, _ in boxes(data, a + 8, b)), "")
    sizes = _sizes(data, stbl)
    count = len(sizes)
    chunks = _table(data, stbl[b"stco"][0], 1)[:, 0] if b"stco" in stbl else _table(data, _one(stbl, b"co64"), 1, ">u8")[:, 0]
    runs = _table(data, _one(stbl, b"stsc"), 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > max(len(chunks), 1)):
        raise BadMedia("the chunk runs aren't in order")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(chunks) and len(runs) else np.zeros(0, np.int64)
    if per.sum() != count:
        raise BadMedia("chunks and sizes disagree about the number of samples")
    before = np.concatenate(([0], np.cumsum(sizes)))
    first = np.cumsum(per) - per
    offsets = np.repeat(chunks[: len(per)] - before[first], per) + before[:-1] if count else np.zeros(0, np.int64)
    steps = _table(data, _one(stbl, b"stts"), 2)
    if steps[:, 0].sum() != count:
        raise BadMedia("times and sizes disagree about the number of samples")
    length = np.repeat(steps[:, 1], steps[:, 0])
    keys = _table(data, stbl[b"stss"][0], 1)[:, 0] - 1 if b"stss" in stbl else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count) or count and (chunks.min() < 0 or offsets.max() > len(data) or (offsets + sizes).max() > len(data)):
        raise BadMedia("a sample lies outside the container")
    return Track(track_id, handler, codec, timescale, duration, sizes, offsets, np.cumsum(length) - length, keys)


def _sizes(data: bytes, stbl: dict) -> np.ndarray:
    """Sizes of the samples: a table of words, one size for all, or a compact table of 4, 8 or 16 bits each."""
    if b"stsz" not in stbl and b"stz2" in stbl:
        a, b = _one(stbl, b"stz2")
        bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16):
            raise BadMedia(f"sizes of {bits} bits")
        if bits > 4:
            return _numbers(data, a + 12, b, count, f">u{bits // 8}")
        pairs = _numbers(data, a + 12, b, (count + 1) // 2, ">u1")
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:count]
    a, b = _one(stbl, b"stsz")
    fixed, count = struct.unpack_from(">II", data, a + 4)
    if count * fixed > len(data):
        raise BadMedia("samples are larger than the container")
    return np.full(count, fixed, np.int64) if fixed else _numbers(data, a + 12, b, count, ">u4")


def parse(data: bytes) -> list[Track]:
    """The tracks of a container. Fragmented files keep samples outside these tables and are an error."""
    try:
        if any(kind == b"moof" for kind, _, _ in boxes(data, 0, len(data))):
            raise BadMedia("the file is fragmented")
        return [_track(data, t) for moov in tree(data, 0, len(data)).get(b"moov", []) for t in moov.get(b"trak", [])]
    except (struct.error, IndexError) as e:
        raise BadMedia("a box is cut short") from e
    except RecursionError as e:
        raise BadMedia("boxes are nested too deep") from e


def payload(data: bytes, track: Track) -> bytes:
    """The track's samples, joined in order."""
    if not len(track.sizes):
        return b""
    turn = np.flatnonzero(np.concatenate(([True], track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1])))
    ends = np.append(turn[1:], len(track.sizes)) - 1
    return b"".join(data[track.offsets[a] : track.offsets[b] + track.sizes[b]] for a, b in zip(turn, ends, strict=True))


# --- writing ---------------------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _rows(a: np.ndarray, kind: str = ">u4") -> bytes:
    return struct.pack(">I", len(a)) + np.ascontiguousarray(a, np.dtype(kind)).tobytes()


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(samples: bytes, layout: Layout = Layout()) -> bytes:
    """A container with one track of 8-bit grey frames. samples: whole frames."""
    n, rest = divmod(len(samples), layout.sample_bytes)
    if rest or not n:
        raise ValueError("samples aren't a positive number of whole frames")
    per = layout.samples_per_chunk
    chunks = -(-n // per)
    last = n - (chunks - 1) * per
    runs = [[1, per, 1], [chunks, last, 1]] if last != per and chunks > 1 else [[1, min(n, per), 1]]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", layout.side, layout.side, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    keys = np.arange(1, n + 1, layout.key_every)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")

    def moov(base: int, wide: bool) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (per * layout.sample_bytes)
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", _rows(np.array([[n, 1]]))), _full(b"stss", _rows(keys)), _full(b"stsc", _rows(np.array(runs))),
            _full(b"stsz", struct.pack(">II", layout.sample_bytes, n)), _full(b"co64" if wide else b"stco", _rows(offsets, ">u8" if wide else ">u4")),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, layout.timescale, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", layout.side << 16, layout.side << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, layout.timescale, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    wide = len(samples) > 0xF0000000
    base = len(ftyp) + len(moov(0, wide)) + (16 if wide else 8)
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(samples)) if wide else struct.pack(">I4s", 8 + len(samples), b"mdat")
    return b"".join((ftyp, moov(base, wide), head, samples))


# --- columns ---------------------------------------------------------------------------------

TRACKS = "track_id long, handler string, codec string, timescale long, duration long, seconds double, n_samples long, key_frames array<struct<sample: long, time: long, first: long, bytes: long>>, error string"


def tracks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each track of each container: id_col and the columns of TRACKS."""
    def rows(data: bytes | None) -> list[tuple]:
        if data is None:
            return []
        try:
            return [(t.track_id, t.handler, t.codec, t.timescale, t.duration, t.duration / t.timescale if t.timescale else None, len(t.sizes), [dict(zip(("sample", "time", "first", "bytes"), k, strict=True)) for k in t.key_ranges()], None) for t in parse(data)]
        except BadMedia as e:
            return [(None,) * 8 + (str(e),)]

    names = StructType.fromDDL(TRACKS).names
    found = common.map_texts(media, lambda: lambda values: [([dict(zip(names, r, strict=True)) for r in rows(v)],) for v in values], f"t array<struct<{TRACKS}>>", id_col, media_col)
    return found.select(id_col, F.explode("t").alias("t")).select(id_col, "t.*")


def to_media(docs: DataFrame, layout: Layout = Layout(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8, filled with bytes 255 to whole frames, as a container."""
    def row(text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "replace")
        return len(raw), store(filled(raw, layout.sample_bytes), layout)

    return common.map_texts(docs, lambda: lambda texts: [row(t) for t in texts], "n_bytes long, media binary", id_col, text_col)


def filled(raw: bytes, unit: int) -> bytes:
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """(id_col, keep..., columns of DIGEST): what reading the first track back gives. feature: codec, time scale, duration, samples, key frames and a CRC of their byte ranges."""
    def row(data: bytes | None) -> tuple:
        try:
            found = parse(data) if data is not None else []
        except BadMedia:
            found = []
        if not found:
            return (None,) * 6
        t = found[0]
        read = payload(data, t)
        k = t.keys
        ranges = zlib.crc32(np.stack([t.times[k], t.offsets[k], t.sizes[k]]).astype(">i8").tobytes())
        feature = f"codec={t.codec.strip()};timescale={t.timescale};duration={t.duration};samples={len(t.sizes)};keys={len(k)};ranges={ranges:08x}"
        return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    return common.map_texts(media, lambda: lambda values: [row(v) for v in values], DIGEST, id_col, media_col, keep)
