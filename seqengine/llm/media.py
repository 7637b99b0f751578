"""Media columns: progressive JPEG with coefficient payloads (operator 5).

`decode` reads a progressive JPEG: it accumulates spectral-selection and
successive-approximation scans into one coefficient array a component.
`pixels` dequantises, inverse-transforms with one matrix product, upsamples
chroma and returns the full-resolution RGB tensor.

`encode` stores bytes losslessly in the format's own unit, the quantised
coefficient: 64 bytes are the 64 coefficients of a block, in zigzag order.  A
byte becomes a coefficient of a fixed magnitude category, so each scan has
codes of one length and both directions are array operations.  Six blocks make
a 4:2:0 unit (four luma, one of each chroma); the last unit is filled with
zero bytes.  Scans: DC without its last bit, two AC bands without theirs, then
the refinement of each by its last bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqengine.llm.shared import written

BANDS = ((1, 5), (6, 63))
UNIT = 64


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag index: diagonals, every other one reversed."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, 8 * r + c) for r in range(8) for c in range(8)))
    return np.array([x[2] for x in cells])


ZIGZAG = _zigzag()
_k = np.arange(8)
_cosine = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)
#: Row: a coefficient in zigzag order; column: its part in each of the 64 samples.
BASIS = np.einsum("ux,vy->uvxy", _cosine, _cosine).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, slot: int, symbols: bytes) -> bytes:
    """A table whose codes all have one length, with room for the code of all ones that is not allowed."""
    length = max(1, len(symbols).bit_length())
    return _segment(0xC4, bytes([kind << 4 | slot]) + bytes(len(symbols) if k == length else 0 for k in range(1, 17)) + symbols)


def _scan(component: int, band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, band[0], band[1], high << 4 | low])) + data


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _refinement(bits: np.ndarray) -> bytes:
    """End-of-band runs over all blocks, each followed by the correction bits of its blocks; bits: (blocks, band)."""
    parts: list[np.ndarray] = []
    at = 0
    while at < len(bits):
        run = min(len(bits) - at, 32767)
        size = run.bit_length() - 1
        code = size << size | (run - (1 << size))
        parts += [np.array([code >> k & 1 for k in range(size + 4)][::-1], np.uint8), bits[at : at + run].ravel()]
        at += run
    return _stuffed(_pad(np.concatenate(parts)))


def _pad(bits: np.ndarray) -> bytes:
    return np.packbits(np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]).tobytes()


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, a positive multiple of 64 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload is not a positive multiple of 64 bytes")
    units = -(-len(payload) // (6 * UNIT))
    wide = -(-units // 4095)
    tall = -(-units // wide)
    units = wide * tall
    blocks = np.zeros((6 * units, UNIT), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = [blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :]]
    out = [
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * tall, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _huffman(0, 0, b"\x07"),
        _huffman(1, 0, b"\x07"),
        _segment(0xDD, struct.pack(">H", 1)),  # the DC predictor starts anew at each block
    ]
    for c, part in enumerate(parts):
        marks = np.empty((len(part), 3), np.uint8)
        marks[:, 0] = part[:, 0] >> 1
        marks[:, 1] = 0xFF
        marks[:, 2] = 0xD0 + np.arange(len(part)) % 8
        out.append(_scan(c + 1, (0, 0), 0, 1, marks.tobytes()[:-2]))
    out.append(_segment(0xDD, struct.pack(">H", 0)))
    for first, last in BANDS:
        out += [_scan(c + 1, (first, last), 0, 1, (part[:, first : last + 1] >> 1).tobytes()) for c, part in enumerate(parts)]
    out.append(_huffman(1, 0, bytes(r << 4 for r in range(15))))
    out += [_scan(c + 1, (0, 0), 1, 0, _stuffed(_pad(part[:, 0] & 1))) for c, part in enumerate(parts)]
    for first, last in BANDS:
        # A positive coefficient takes its last bit; a negative one, -(255 - byte), that of its magnitude.
        out += [_scan(c + 1, (first, last), 1, 0, _refinement((part[:, first : last + 1] ^ (part[:, first : last + 1] < 128)) & 1)) for c, part in enumerate(parts)]
    return b"".join(out) + b"\xff\xd9"


def payload_of(image: "Image", size: int) -> bytes:
    """The first `size` bytes that the coefficients of an image of `encode` carry."""
    parts = []
    for c in image.components:
        part = np.where(c.blocks < 0, c.blocks + 255, c.blocks).astype(np.uint8)
        part[:, 0] = np.where(c.blocks[:, 0] < 0, c.blocks[:, 0] + 254, c.blocks[:, 0])
        parts.append(part.tobytes())
    return b"".join(parts)[:size]


class _Bits:
    """A bit reader over entropy-coded data without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        out, at = 0, self.at
        for k in range(at, at + n):
            byte = self.data[k >> 3] if k >> 3 < len(self.data) else 0xFF
            out = out << 1 | (byte >> (7 - (k & 7)) & 1)
        self.at = at + n
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        bits = self.take(size)
        return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


class Component:
    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table
        self.wide = self.tall = self.row = 0
        self.blocks = np.zeros((0, 64), np.int16)


class Image:
    """What decode() finds: size, quantisation and the coefficients, in zigzag order, a component."""

    def __init__(self) -> None:
        self.width = self.height = 0
        self.components: list[Component] = []
        self.quantise: dict[int, np.ndarray] = {}


def decode(data: bytes) -> Image:
    """Accumulate the scans of a progressive JPEG; raises ValueError on anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, restart, at = Image(), {}, 0, 2
    ids: list[int] = []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                step = 2 if body[0] >> 4 else 1
                image.quantise[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * step], ">u2" if step == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * step :]
        elif marker == 0xC4:
            while body:
                counts, code, table, k = body[1:17], 0, {}, 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0] >> 4, body[0] & 15] = table
                body = body[k:]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * k] for k in range(n)]
            image.components = [Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            top = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.wide = -(-(-(-image.width * c.h // top[0])) // 8)
                c.tall = -(-(-(-image.height * c.v // top[1])) // 8)
                c.row = -(-image.width // (8 * top[0])) * c.h
                c.blocks = np.zeros((c.row * -(-image.height // (8 * top[1])) * c.v, 64), np.int16)
        elif marker in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB):
            raise ValueError("only progressive Huffman JPEGs are read")
        elif marker == 0xDA:
            end = at
            while True:  # the next marker that is neither stuffing nor a restart
                end = data.find(b"\xff", end)
                if end < 0:
                    end = len(data)
                    break
                if end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                    end += 2
                    continue
                break
            _scan_into(image, ids, tables, restart, body, data[at:end])
            at = end
    if not image.components:
        raise ValueError("no frame")
    return image


def _pieces(coded: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers, without stuffing."""
    out, begin, at = [], 0, 0
    while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
        if 0xD0 <= coded[at + 1] <= 0xD7:
            out.append(coded[begin:at])
            begin = at + 2
        at += 2
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, coded[begin:]]]


def _scan_into(image: Image, ids: list[int], tables: dict, restart: int, head: bytes, coded: bytes) -> None:
    n = head[0]
    use = [(image.components[ids.index(head[1 + 2 * k])], head[2 + 2 * k]) for k in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if n == 1 and _scan_fast(use[0][0], tables, use[0][1], restart, first, last, high, low, coded):
        return
    if n == 1:
        c = use[0][0]
        order = [[(0, r * c.row + x)] for r in range(c.tall) for x in range(c.wide)]
    else:
        across, down = use[0][0].row // use[0][0].h, len(use[0][0].blocks) // use[0][0].row // use[0][0].v
        order = [[(k, (r * c.v + v) * c.row + x * c.h + h) for k, (c, _) in enumerate(use) for v in range(c.v) for h in range(c.h)] for r in range(down) for x in range(across)]
    pieces = _pieces(coded)
    step = restart or len(order)
    for at, piece in zip(range(0, len(order), step), pieces):
        bits, before, run = _Bits(piece), [0] * n, 0
        for unit in order[at : at + step]:
            for k, block in unit:
                c, slots = use[k]
                row = c.blocks[block]
                if first == 0:
                    if high:
                        row[0] |= bits.take(1) << low
                    else:
                        before[k] += bits.signed(bits.symbol(tables[0, slots >> 4]))
                        row[0] = before[k] << low
                elif high:
                    run = _refine(bits, tables[1, slots & 15], row, first, last, low, run)
                else:
                    run = _first_pass(bits, tables[1, slots & 15], row, first, last, low, run)


def _first_pass(bits: _Bits, table: dict, row: np.ndarray, k: int, last: int, low: int, run: int) -> int:
    if run:
        return run - 1
    while k <= last:
        zeros, size = divmod(bits.symbol(table), 16)
        if size:
            k += zeros
            row[k] = bits.signed(size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _refine(bits: _Bits, table: dict, row: np.ndarray, k: int, last: int, low: int, run: int) -> int:
    def correct(at: int) -> None:
        if bits.take(1):
            row[at] += (1 if row[at] > 0 else -1) << low

    while not run and k <= last:
        zeros, size = divmod(bits.symbol(table), 16)
        fresh = 0
        if size:
            fresh = (1 if bits.take(1) else -1) * (1 << low)
        elif zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        while k <= last:
            if row[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                row[k] = fresh
                k += 1
                break
            k += 1
    if not run:
        return 0
    for at in range(k, last + 1):
        if row[at]:
            correct(at)
    return run - 1


def _scan_fast(c: Component, tables: dict, slots: int, restart: int, first: int, last: int, high: int, low: int, coded: bytes) -> bool:
    """A scan whose codes all have one length and one category, as arrays; False if it isn't one."""
    n, wide = len(c.blocks), last - first + 1
    if c.wide != c.row or c.tall * c.row != n:
        return False
    if first == 0 and high:
        if restart:
            return False
        bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8), count=n)
        c.blocks[:, 0] |= bits.astype(np.int16) << low
        return True
    table = tables.get((0, slots >> 4) if first == 0 else (1, slots & 15), {})
    if not high:
        if table != {(1, 0): 7}:
            return False
        if first == 0:
            if restart != 1 or len(coded) != 3 * n - 2:
                return False
            byte = np.frombuffer(coded + b"\xff\xd0", np.uint8).reshape(n, 3)[:, :1]
        else:
            if restart or len(coded) != n * wide:
                return False
            byte = np.frombuffer(coded, np.uint8).reshape(n, wide)
        if byte.size and byte.max() > 127:
            return False
        value = np.where(byte < 64, byte.astype(np.int16) - 127, byte.astype(np.int16))
        c.blocks[:, first : last + 1] = value * (1 << low)
        return True
    rows = c.blocks[:, first : last + 1]
    if restart or not rows.all():
        return False
    length = next(iter(table))[0] if table else 0
    if any(size for _, size in map(lambda s: divmod(s, 16), table.values())) or any(k[0] != length for k in table):
        return False
    bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8))
    at = done = 0
    taken = lambda k: int("".join(map(str, bits[at : at + k])) or "0", 2)
    while done < n:
        size = table[length, taken(length)] >> 4
        at += length
        run = min((1 << size) + taken(size), n - done)
        at += size
        part = rows[done : done + run]
        part += (np.sign(part) * bits[at : at + run * wide].reshape(run, wide).astype(np.int16)) << low
        at += run * wide
        done += run
    return True


def pixels(image: Image) -> np.ndarray:
    """The full-resolution RGB tensor, (height, width, 3) unsigned bytes; one component is grey."""
    planes = []
    for c in image.components:
        samples = (c.blocks * image.quantise[c.table]).astype(np.float32) @ BASIS + np.float32(128)
        plane = samples.reshape(-1, c.row, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.row * 8)
        planes.append(np.clip(np.rint(plane), 0, 255))
    top = max(c.v for c in image.components), max(c.h for c in image.components)
    full = []
    for c, plane in zip(image.components, planes):
        if (c.v, c.h) != top:
            plane = plane.repeat(top[0] // c.v, axis=0).repeat(top[1] // c.h, axis=1)
        full.append(plane[: image.height, : image.width])
    if len(full) == 1:
        full *= 3
    elif len(full) == 3:
        y, blue, red = full[0], full[1] - np.float32(128), full[2] - np.float32(128)
        full = [y + np.float32(1.402) * red, y - np.float32(0.344136) * blue - np.float32(0.714136) * red, y + np.float32(1.772) * blue]
    return np.clip(np.rint(np.stack(full, axis=-1)), 0, 255).astype(np.uint8)


def feature(rgb: np.ndarray) -> str:
    """Size, mean colour and an 8-bin histogram of each channel in thousandths."""
    bins = np.stack([np.bincount(rgb[..., k].ravel() >> 5, minlength=8) for k in range(3)])
    share = bins * 1000 // (rgb.shape[0] * rgb.shape[1])
    mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(map(str, mean)) + ":" + ",".join(map(str, share.ravel()))


def _store(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from seqengine.llm.wordhash import batches

    for batch in batches(stream):
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        media = [encode(x + bytes(-len(x) % UNIT or (0 if x else UNIT))) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_table(documents: DataFrame) -> DataFrame:
    """Store every whole text of documents(doc_id, text) as a media column: doc_id, n_bytes, media.

    A null text is empty; an empty one has a payload of 64 zero bytes.  Rows
    stay as they are, with repeats and null ids; other columns are ignored.
    """
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(columns.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media", **{"parquet.block.size": str(32 << 20)})


def _describe(tensors: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, size, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    image = decode(media)
                    payload = payload_of(image, max(UNIT, -(-size // UNIT) * UNIT))
                    rgb = pixels(image)
                    row = (doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb))
                    rows.append(row + (image.height, image.width, rgb.tobytes()) * tensors)
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["height", "width", "rgb"] * tensors
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_schema(tensors))

    return run


def _schema(tensors: bool) -> pa.Schema:
    text, number = pa.string(), pa.int64()
    fields = [("doc_id", number), ("n_bytes", number), ("payload_bytes", number), ("payload_sha256", text), ("tail_crc32", number), ("media_bytes", number), ("media_sha256", text), ("feature", text)]
    return pa.schema(fields + [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())] * tensors)


def media_features(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Decode a stored media column: digests and a feature a row, with `tensors` the RGB bytes too."""
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_describe(tensors), columns + ", height int, width int, rgb binary" * tensors)
