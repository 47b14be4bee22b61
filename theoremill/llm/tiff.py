"""TIFF pages as rows: directory walk, strips and tiles, PackBits / LZW / deflate, predictors; and a writer.

`read_pages` is the operator: a table of files becomes one row per page (image file directory). `encode` writes the
same variety of files from raw samples, for round trips and for the query.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.common import prepare

# Fixed values of the format: field types (bytes each), tags, compression schemes.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
FILL_ORDER = 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of a page's samples: they must fit a binary cell. A file can't hold more than this many times its own bytes.
PAGE_BYTES, MOST_PACKED = 2**31 - 1, 4096
#: Bytes that an Arrow function gathers before it hands rows on, and rows.
FLUSH_BYTES, FLUSH_ROWS = 8 << 20, 128
PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, made = [], 0, 0
    while i < len(data) and made < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
            made += n + 1
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
            made += 257 - n
        else:
            i += 1
    return b"".join(out)[:size]


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(row: bytes) -> bytes:
    out, i = [], 0

    def literal(part: bytes) -> None:
        for a in range(0, len(part), 128):
            piece = part[a : a + 128]
            out.append(bytes([len(piece) - 1]) + piece)

    for m in _RUN.finditer(row):
        literal(row[i : m.start()])
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        i = m.end()
    literal(row[i:])
    return b"".join(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes are most significant bit first, 9 to 12 bits, and widen one code early; 256 clears, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits = list(base), 9, 0, 0
    out: list[bytes] = []
    prior, made = b"", 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            table, width, prior = list(base), 9, b""
            continue
        if code == 257 or made >= size:
            break
        if code > len(table) or not prior and code > 255:
            raise ValueError(f"code {code} of a table of {len(table)}")
        if not prior:
            word = table[code]
        else:
            word = table[code] if code < len(table) else prior + prior[:1]
            if len(table) < 4096:
                table.append(prior + word[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        made += len(word)
        prior = word
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    base = {bytes([i]): i for i in range(256)}
    table, width, following = dict(base), 9, 258
    held, bits, out = 256, 9, bytearray()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        held, bits = held << width | table[word], bits + width
        table[longer] = following
        following += 1
        if following + 1 > 1 << width:
            width += 1
        if following >= 4094:
            held, bits = held << min(width, 12) | 256, bits + min(width, 12)
            table, width, following = dict(base), 9, 258
        word = data[i : i + 1]
        if bits > 512:
            out += (held >> bits % 8).to_bytes(bits // 8, "big")
            held, bits = held & ((1 << bits % 8) - 1), bits % 8
    if word:
        held, bits = held << width | table[word], bits + width
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    pad = -bits % 8
    return bytes(out + (held << pad).to_bytes((bits + pad) // 8, "big"))


def _difference(block: np.ndarray) -> np.ndarray:
    """Horizontal predictor of (rows, columns, samples)."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def _undo(raw: bytes, rows: int, columns: int, samples: int, kind: np.dtype, predictor: int, bits: int) -> np.ndarray:
    if bits == 1:  # rows begin on whole bytes
        line = -(-columns * samples // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : columns * samples].reshape(rows, columns, samples)
    if predictor == 3:  # bytes of a row are split by significance, then differenced
        planes = np.frombuffer(raw, np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, columns, samples).astype(kind)
    block = np.frombuffer(raw, kind).reshape(rows, columns, samples)
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=kind)
    return block


def _inflate(data: bytes, size: int, how: int) -> bytes:
    """Exactly size bytes; what follows them is not decoded, and fewer are an error."""
    if how == NONE:
        out = data[:size]
    elif how in (DEFLATE, DEFLATE_OLD):
        out = zlib.decompressobj().decompress(data, max(1, size))
    elif how == PACKBITS:
        out = unpack_bits(data, size)
    elif how == LZW:
        out = lzw_decode(data, size)
    else:
        raise ValueError(f"compression {how} is not supported")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes")
    return out


def _directory(blob: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", blob, at)
    tags: dict[int, list[int]] = {}
    codes = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 7: "B", 2: "B"}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
        if kind not in codes:
            continue
        place = at + 10 + 12 * i
        if count * TYPE_BYTES[kind] > 4:
            (place,) = struct.unpack_from(order + "I", blob, place)
        tags[tag] = list(struct.unpack_from(f"{order}{count}{codes[kind]}", blob, place))
    (following,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)
    return tags, following


def _page(blob: bytes, tags: dict[int, list[int]], order: str) -> dict:
    """One page: 1-bit (as bytes 0 and 1), 8, 16 or 32-bit samples, chunky or planar, strips or tiles. Everything that the
    header claims is checked before memory is taken for it."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, how, predictor, real = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(SAMPLE_FORMAT, 1) == 3
    if bits not in (1, 8, 16, 32) or len(set(tags.get(BITS, [bits]))) > 1 or real and bits != 32 or one(FILL_ORDER, 1) != 1:
        raise ValueError(f"samples of {bits} bits in this order are not supported")
    if predictor not in (1, 2, 3) or predictor == 3 and not real or predictor == 2 and (bits == 1 or real):
        raise ValueError(f"predictor {predictor} does not go with these samples")
    tiled, planar = TILE_OFFSETS in tags, one(PLANAR, 1) == 2
    if tiled:
        across, down, places, sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        across, down, places, sizes = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    if min(width, height, samples, across, down) < 1:
        raise ValueError("width, height, samples or tiles of nothing")
    kind = np.dtype(f"{order}f4" if real else f"{order}u{max(1, bits // 8)}")
    need = width * height * samples * kind.itemsize
    if need > min(PAGE_BYTES, MOST_PACKED * len(blob)) or across * down * samples * kind.itemsize > PAGE_BYTES:
        raise ValueError(f"{need} bytes of samples in a file of {len(blob)}")
    deep = 1 if planar else samples  # samples of a block
    per_row, per_plane = -(-width // across), -(-width // across) * -(-height // down)
    if len(places) != len(sizes) or len(places) != per_plane * (samples // deep):
        raise ValueError(f"{len(places)} blocks, {len(sizes)} sizes")
    image = np.zeros((height, width, samples), kind)
    for i, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, at = divmod(i, per_plane)
        y, x = at // per_row * down, at % per_row * across
        rows = down if tiled else min(down, height - y)
        line = -(-across * deep // 8) if bits == 1 else across * deep * kind.itemsize
        block = _undo(_inflate(blob[place : place + size], rows * line, how), rows, across, deep, kind, predictor, bits)
        image[y : y + down, x : x + across, plane : plane + deep] = block[: height - y, : width - x]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor, "tiled": tiled, "pixels": image.tobytes(), "error": None}


def pages(blob: bytes | None) -> Iterator[dict]:
    """Each page of a file; a file or page that can't be read gives one row with `error` and null pixels."""
    empty = dict.fromkeys(("width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels"))
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(blob[:2])]
        magic, at = struct.unpack_from(order + "HI", blob, 2)
        if magic != 42:
            raise ValueError("not a TIFF file")
    except (KeyError, TypeError, ValueError, struct.error) as e:
        yield empty | {"page": 0, "error": f"no TIFF header: {type(e).__name__}"}
        return
    seen, page = set(), 0
    while at and at not in seen:
        seen.add(at)
        following = 0
        try:
            tags, following = _directory(blob, at, order)
            yield {"page": page} | _page(blob, tags, order)
        except (KeyError, ValueError, struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
            yield empty | {"page": page, "error": f"{type(e).__name__}: {e}"[:200]}
        at, page = following, page + 1


def read_pages(files: DataFrame, blob: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of each file, the columns `keep` repeated; pages of a file follow each other in order.

    Columns: page (0-based), width, height, samples, bits, compression, predictor, tiled, pixels (binary, row by row),
    error. Null, empty or broken files give one row with an error, never a failed task; so does a page that can't be
    read, or of more bytes than a binary cell holds, and the pages behind it are read. Repeated rows are each read; an
    empty table gives an empty result; other columns are dropped. Rows are handed on by bytes, so files have any size;
    keep should hold small columns only, being repeated for each page.
    """
    prepare(files.sparkSession)
    chosen = files.select(*keep, F.col(blob).cast("binary").alias("__blob"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    columns = [c.strip().split(" ")[0] for c in PAGE_SCHEMA.split(",")]
    kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(batch.num_columns - 1)
            at, rows, held = [], [], 0

            def flush(batch=batch, at=at, rows=rows) -> pa.RecordBatch:
                index = pa.array(at, pa.int64())
                kept = [batch.column(k).take(index) for k in range(batch.num_columns - 1)]
                made = pa.RecordBatch.from_arrays([*kept, *(pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, *columns])
                at.clear()
                rows.clear()
                return made

            for i in range(batch.num_rows):
                for row in pages(blobs[i].as_py()):
                    size = len(row["pixels"] or b"")
                    if rows and (held + size > FLUSH_BYTES or len(rows) >= FLUSH_ROWS):
                        yield flush()
                        held = 0
                    at.append(i)
                    rows.append(row)
                    held += size
            if rows:
                yield flush()

    return chosen.mapInArrow(run, f"{schema}, {PAGE_SCHEMA}")


def encode(images: list[np.ndarray], how: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 64, level: int = 1) -> bytes:
    """A little-endian file with one page per (height, width, samples) array of unsigned 8-bit samples."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        blocks = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile, samples), np.uint8)
                    part = image[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        places, sizes = [], []
        for block in blocks:
            block = _difference(block) if predictor == 2 else block
            if how == PACKBITS:
                data = b"".join(pack_bits(row.tobytes()) for row in block)
            else:
                data = block.tobytes()
                data = zlib.compress(data, level) if how == DEFLATE else lzw_encode(data) if how == LZW else data
            places.append(len(out))
            sizes.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        shape = [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_OFFSETS, places), (TILE_BYTES, sizes)] if tile else [(STRIP_OFFSETS, places), (ROWS_PER_STRIP, [rows_per_strip]), (STRIP_BYTES, sizes)]
        tags = sorted([(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8] * samples), (COMPRESSION, [how]), (PHOTOMETRIC, [2 if samples == 3 else 1]), (SAMPLES, [samples]), (PREDICTOR, [predictor]), *shape])
        fields = []
        for tag, values in tags:
            kind, code = (3, "H") if tag == BITS else (4, "I")
            data = struct.pack(f"<{len(values)}{code}", *values)
            if len(data) > 4:
                where = len(out)
                out += data
                out += b"\0" * (len(out) % 2)
                data = struct.pack("<I", where)
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Query-side layout: an RGB row of 64 pixels takes 192 bytes of a payload; pages of at most this many rows.
ROW_BYTES, PAGE_ROWS = 192, 256


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES - len(text))


def store(payload: bytes) -> bytes:
    """A payload as a TIFF file; its checksum picks compression, predictor, strips or tiles, so equal texts agree."""
    more, pick = divmod(zlib.crc32(payload), 16)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    images = [rows[a : a + PAGE_ROWS] for a in range(0, len(rows), PAGE_ROWS)]
    if pick == 0:
        return encode(images, LZW, predictor=1 + more % 2)
    if pick < 4:
        return encode(images, PACKBITS)
    return encode(images, DEFLATE, predictor=2 if pick in (5, 9) else 1, tile=16 if pick in (6, 9) else 0)


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as UTF-8, padded with spaces to rows of 192 bytes.

    Null and empty texts are one row of spaces (n_bytes 0); equal texts give equal files; rows that repeat an id, or
    have none, are each stored; texts have any length; an empty table gives an empty result; other columns are dropped.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a, sizes, files, held = batch.column(1), 0, [], [], 0
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                file = store(padded(raw))
                if files and (held + len(file) > FLUSH_BYTES or len(files) >= FLUSH_ROWS):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, i - a), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    a, sizes, files, held = i, [], [], 0
                sizes.append(len(raw))
                files.append(file)
                held += len(file)
            if files:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def feature_of(pixels: np.ndarray) -> str:
    """An 8 x 8 difference hash of the payload's rows (means of 9 x 8 cells), 16 hex digits."""
    rows = pixels.reshape(-1, ROW_BYTES)
    down = np.linspace(0, len(rows), 9).astype(int)
    bands = np.stack([rows[a : max(z, a + 1)].mean(0) if a < len(rows) else np.zeros(ROW_BYTES) for a, z in zip(down[:-1], down[1:], strict=True)])
    cells = bands[:, :189].reshape(8, 9, 21).mean(2)
    return f"{int(''.join('1' if x else '0' for x in (cells[:, 1:] > cells[:, :-1]).ravel()), 2):016x}"


def with_digest(files: DataFrame) -> DataFrame:
    """files without `media`'s bytes having to follow its pages: adds media_bytes (long) and media_sha256 (lowercase hex)
    of the stored form; null media: null. Columns of these names are overwritten; all rows are kept."""
    return files.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})


def digests(read: DataFrame) -> DataFrame:
    """One row per file from its consecutive pages (read_pages of with_digest's table, its columns doc_id, n_bytes,
    media_bytes and media_sha256 kept): a narrow step.

    A file that could not be read has the digests of what could be, nothing for the rest. Rows that repeat an id, or
    have none, are told apart by page 0 and each returned; an empty table gives an empty result.
    """
    import hashlib

    own = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")
    kinds = (None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())

    def close(key: tuple, parts: list[bytes]) -> tuple:
        doc_id, n_bytes, media_bytes, media_sha256 = key
        payload = b"".join(parts)
        feature = feature_of(np.frombuffer(payload[: len(payload) // ROW_BYTES * ROW_BYTES], np.uint8)) if len(payload) >= ROW_BYTES else ""
        return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media_bytes, media_sha256, feature, len(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, out, kind = None, [], [], None

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k or kind) for i, k in enumerate(kinds)], names=list(names))
            out.clear()
            return made

        for batch in batches:
            kind = batch.column("doc_id").type
            page = batch.column("page").to_pylist()
            for i in range(batch.num_rows):
                if page[i] == 0:
                    if key:
                        out.append(close(key, parts))
                    key, parts = tuple(batch.column(c)[i].as_py() for c in own), []
                parts.append(batch.column("pixels")[i].as_py() or b"")
            if out:
                yield flush()
        if key:
            out.append(close(key, parts))
            yield flush()

    kind = dict(read.dtypes)["doc_id"]
    return read.select(*own, "page", "pixels").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
