"""TIFF as a media column: writing 8-bit pages, and reading directories, strips and tiles.

The reader walks the chain of image directories in either byte order, decodes PackBits, LZW and
deflate (and plain) strips or tiles of 1, 2, 4, 8, 16 or 32 bits a sample, together or in separate
planes, undoes horizontal prediction, and yields one row per page.

`stored` keeps each text losslessly: its UTF-8 bytes, filled with zeros to a multiple of 64, are
the samples of pages of width 64.  Defined results: null and empty texts store 64 zeros; equal texts
give equal files; an empty table gives an empty result; extra columns are left out; a file that
can't be read, or names more samples than its bytes can hold, gives one page row with page -1 and the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, pick, table, texts_of

WIDTH, STRIP_ROWS, PAGE_ROWS = 64, 1024, 1 << 16
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Tags, and field type -> (size, struct letter).
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_at": 273, "samples": 277, "strip_rows": 278, "strip_bytes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_at": 324, "tile_bytes": 325}
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}


#: Sample types by bits, and the most bytes that a byte can be unpacked to.
KINDS = {1: "u1", 2: "u1", 4: "u1", 8: "u1", 16: "u2", 32: "u4"}
MOST = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}


class Page(NamedTuple):
    page: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    pixels: bytes


def pack_bits(data: bytes) -> bytes:
    """PackBits: repeats of two or more as (1 - n, byte), others as (n - 1, bytes), at most 128 each."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


_CLEAR, _END = 256, 257


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the highest bit down, 9 to 12 bits, widened one code early."""
    acc = held = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    codes = {bytes([b]): b for b in range(256)}
    put(_CLEAR, 9)
    nxt, width, run = 258, 9, b""
    for b in data:
        grown = run + bytes([b])
        if grown in codes:
            run = grown
            continue
        put(codes[run], width)
        codes[grown] = nxt
        nxt += 1
        if nxt == 4094:
            put(_CLEAR, width)
            codes = {bytes([x]): x for x in range(256)}
            nxt, width = 258, 9
        elif nxt >= 1 << width:
            width += 1
        run = bytes([b])
    if run:
        put(codes[run], width)
        nxt += 1
        if nxt >= 1 << width and width < 12:
            width += 1
    put(_END, width)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out: list[bytes] = []
    words: list[bytes] = []
    acc = held = i = 0
    width, prev = 9, None
    words = [bytes([b]) for b in range(256)] + [b"", b""]
    while True:
        while held < width:
            if i >= len(data):
                return b"".join(out)
            acc, held, i = (acc << 8 | data[i]) & 0xFFFFFFF, held + 8, i + 1
        held -= width
        code = acc >> held & ((1 << width) - 1)
        if code == _END:
            return b"".join(out)
        if code == _CLEAR:
            words = [bytes([b]) for b in range(256)] + [b"", b""]
            width, prev = 9, None
            continue
        if prev is None:
            if code >= _CLEAR:
                raise ValueError(f"code {code} after a clear code")
            prev = words[code]
        else:
            if code > len(words):
                raise ValueError(f"code {code} before the table has it")
            word = words[code] if code < len(words) else prev + prev[:1]
            words.append(prev + word[:1])
            prev = word
        out.append(prev)
        if len(words) >= (1 << width) - 1 and width < 12:
            width += 1


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unlzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression}")


def _packed(data: bytes, compression: int) -> bytes:
    return {PLAIN: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1)}[compression](data)


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit grey pages (arrays of two dimensions), in strips, or in square tiles of `tile`."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for a in pages:
        h, w = a.shape
        if tile:
            down, right = -(-h // tile), -(-w // tile)
            full = np.zeros((down * tile, right * tile), np.uint8)
            full[:h, :w] = a
            parts = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(right)]
        else:
            parts = [a[y : y + STRIP_ROWS] for y in range(0, h, STRIP_ROWS)]
        at, sizes = [], []
        for p in parts:
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=np.zeros((len(p), 1), np.uint8))
            data = _packed(p.tobytes(), compression)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        place = ("tile_at", "tile_bytes") if tile else ("strip_at", "strip_bytes")
        fields = {"width": [w], "height": [h], "bits": [8], "compression": [compression], "photometric": [1], "samples": [1], "planar": [1], "predictor": [predictor], place[0]: at, place[1]: sizes}
        fields |= {"tile_width": [tile], "tile_height": [tile]} if tile else {"strip_rows": [STRIP_ROWS]}
        rows = b""
        for name, values in sorted(fields.items(), key=lambda x: TAGS[x[0]]):
            if len(values) > 1:
                where = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            else:
                where = values[0]
            rows += struct.pack("<HHII", TAGS[name], 4, len(values), where)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + rows
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPES:
            size, letter = TYPES[kind]
            where = at + 10 + 12 * k
            if size * n > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + size * n > len(data):
                raise ValueError(f"field {tag} ends after the file")
            fields[tag] = struct.unpack_from(f"{order}{n}{letter}", data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _summed(block: bytes, rows: int, width: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """The samples of a strip or tile, rows x width x samples, prediction undone; those under 8 bits one to a byte."""
    line = -(-width * samples * bits // 8)  # rows begin at whole bytes
    if len(block) < rows * line:
        raise ValueError(f"{len(block)} of {rows * line} bytes in a strip or tile")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError(f"predictor {predictor} for {bits} bits")
    if bits < 8:
        each = np.unpackbits(np.frombuffer(block[: rows * line], np.uint8).reshape(rows, line), axis=1)[:, : width * samples * bits].reshape(rows, width, samples, bits)
        return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    a = np.frombuffer(block[: rows * line], order + KINDS[bits]).reshape(rows, width, samples)
    return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("=")) if predictor == 2 else a


def _image(data: bytes, fields: dict[int, tuple], order: str, page: int) -> Page:
    """One directory's page; nothing is allocated before the file is known to be long enough for it."""
    get = lambda name, default=None: fields.get(TAGS[name], default)
    w, h = get("width")[0], get("height")[0]
    bits, samples = get("bits", (1,)), get("samples", (1,))[0]
    compression, predictor = get("compression", (1,))[0], get("predictor", (1,))[0]
    if len(set(bits)) > 1:
        raise ValueError(f"samples of {bits} bits")
    bits = bits[0]
    if bits not in KINDS:
        raise ValueError(f"{bits} bits a sample")
    planes = samples if get("planar", (1,))[0] == 2 else 1
    inside = samples // planes
    tiled = TAGS["tile_at"] in fields
    bw, bh = (get("tile_width")[0], get("tile_height")[0]) if tiled else (w, min(h, get("strip_rows", (h,))[0]))
    if min(w, h, bw, bh, samples) < 1:
        raise ValueError(f"{w} x {h} x {samples} in parts of {bw} x {bh}")
    places = list(zip(get("tile_at" if tiled else "strip_at"), get("tile_bytes" if tiled else "strip_bytes")))
    across, down = -(-w // bw), -(-h // bh)
    if len(places) < across * down * planes:
        raise ValueError(f"{len(places)} of {across * down * planes} strips or tiles")
    if any(start + size > len(data) for start, size in places):
        raise ValueError("a strip or tile ends after the file")
    part = bh * -(-bw * inside * bits // 8)
    for _, size in places[: across * down * planes]:
        if (part if tiled else 1) > MOST.get(compression, 1) * (size + 16):
            raise ValueError(f"{size} bytes for a tile of {part}")
    if h * w * samples * bits // 8 > MOST.get(compression, 1) * (sum(size for _, size in places) + 16):
        raise ValueError(f"{len(data)} bytes for {w} x {h} x {samples}")
    full = np.zeros((h, w, samples), order + KINDS[bits])
    for k, (start, size) in enumerate(places[: across * down * planes]):
        plane, k = divmod(k, across * down)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        a = _summed(_unpacked(data[start : start + size], compression), rows, bw, inside, bits, order, predictor)
        full[y : y + bh, x : x + bw, plane * inside : (plane + 1) * inside] = a[: h - y, : w - x]
    return Page(page, w, h, bits, samples, compression, predictor, full.tobytes())


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file, in order; samples under 8 bits take a byte each, separate planes are joined."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    if not at:
        raise ValueError("no image directory")
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        fields, nxt = _directory(data, at, order)
        yield _image(data, fields, order, len(seen) - 1)
        at = nxt


def pages(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """key, page, width, height, bits, samples, compression, predictor, pixels, error: a row for each page of each file."""

    def run(batch: pa.RecordBatch) -> dict:
        at, rows, errors = [], [], []
        for k, data in enumerate(batch.column(1).to_pylist()):
            try:
                got = list(read(data or b""))
                why = [None] * len(got)
            except (ValueError, LookupError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                got, why = [Page(-1, 0, 0, 0, 0, 0, 0, b"")], [str(e) or type(e).__name__]
            at += [k] * len(got)
            rows += got
            errors += why
        out = {key: batch.column(0).take(pa.array(at, pa.int64()))}
        kinds = [pa.int32()] * 7 + [pa.binary()]
        for name, kind, column in zip(Page._fields, kinds, zip(*rows) if rows else [()] * 8):
            out[name] = pa.array(column, kind)
        return out | {"error": pa.array(errors, pa.string())}

    return map_batches(pick(files, key, media), run, f"{key} long, page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, error string")


def store(text: str, compression: int = DEFLATE) -> tuple[int, bytes]:
    """Bytes of a text, and its file."""
    raw = text.encode("utf-8", "surrogatepass")
    payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return len(raw), write([a[y : y + PAGE_ROWS] for y in range(0, len(a), PAGE_ROWS)], compression)


def feature_of(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and their shares in eight bands, in thousandths."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    x = np.arange(256)
    mean = float((p * x).sum())
    some = p[p > 0]
    values = [mean, float((p * (x - mean) ** 2).sum()) ** 0.5, float(-(some * np.log2(some)).sum()), *p.reshape(8, 32).sum(axis=1).tolist()]
    return ",".join(str(round(v * 1000)) for v in values)


def _described(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")}
    for t in texts_of(batch.column(1)):
        n, media = store(t)
        got = list(read(media))
        payload = b"".join([p.pixels for p in got])
        row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload), len(got))
        for c, v in zip(out.values(), row):
            c.append(v)
    text = ("payload_sha256", "media_sha256", "feature")
    return {"doc_id": batch.column(0)} | {k: pa.array(v, pa.string() if k in text else pa.int64()) for k, v in out.items()}


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a TIFF file."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [store(t) for t in texts_of(batch.column(1))]
        return {"doc_id": batch.column(0), "n_bytes": pa.array([r[0] for r in rows], pa.int64()), "media": pa.array([r[1] for r in rows], pa.binary())}

    return map_batches(pick(docs, "doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def described(docs: DataFrame) -> DataFrame:
    """doc_id and, of the file that `stored` would give, what is read back from it: sizes, digests and a feature string."""
    return map_batches(pick(docs, "doc_id", "text"), _described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(table(spark, sf_dir, "documents"))


QUERIES = {"op8_tiff": query}
