"""Media columns: TIFF files in a binary column, written and read inside tasks.

`read_pages` walks a file's image directories, decodes PackBits, LZW or deflate strips and tiles and undoes the
horizontal predictor; `tiff_pages` emits one row for each page. Samples have 8 bits. Work is row by row, so nothing is shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: Bytes in a row of a text's image.
ROW = 192
#: Rows of a page, and of a strip.
PAGE_ROWS, STRIP_ROWS = 4096, 128
#: Bytes that a coder makes of one byte at most: an LZW code of nine bits can stand for a string of 4,093 bytes.
EXPANDS = 4096
#: Side of a tile.
TILE = 64


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three or more equal bytes are repeated, the rest is literal; 128 at most of either."""
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i >= 3:
            out += bytes([257 - (j - i), raw[i]])
            i = j
            continue
        k = i
        while k < n and k - i < 128 and not (k + 2 < n and raw[k] == raw[k + 1] == raw[k + 2]):
            k += 1
        out += bytes([k - i - 1]) + raw[i:k]
        i = k
    return bytes(out)


def packbits_decode(coded: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(coded):
        n = coded[i]
        if n < 128:
            out += coded[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += coded[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends; widths change one code early."""
    acc = held = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    # a word is known by its code; a longer one by its code and the byte that follows
    table, following, width, word = {}, 258, 9, -1
    put(256, width)
    for x in raw:
        if word < 0:
            word = x
            continue
        longer = table.get(word << 8 | x)
        if longer is not None:
            word = longer
            continue
        put(word, width)
        table[word << 8 | x] = following
        following += 1
        word = x
        if following == 4095:
            put(256, width)
            table, following, width = {}, 258, 9
        elif following == 1 << width:
            width += 1
    if word >= 0:
        put(word, width)
        following += 1
        if following == 1 << width and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def lzw_decode(coded: bytes) -> bytes:
    single = [bytes([x]) for x in range(256)] + [b"", b""]
    out, table, width, last = [], [*single], 9, b""
    acc = held = 0
    for x in coded:
        acc, held = acc << 8 | x, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [*single], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _inflate(coded: bytes) -> bytes:
    """Deflated bytes, of which a damaged part may hold more than a thousandfold."""
    return zlib.decompressobj().decompress(coded, 1 + 1100 * len(coded))


_CODERS = {
    NONE: (bytes, bytes),
    LZW: (lzw_encode, lzw_decode),
    DEFLATE: (lambda x: zlib.compress(x, 1), _inflate),
    32946: (lambda x: zlib.compress(x, 1), _inflate),
    PACKBITS: (packbits_encode, packbits_decode),
}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: int = 0, order: str = "<") -> bytes:
    """A file of 8-bit pages, each (rows, columns) or (rows, columns, samples); tiles of side `tile` (a multiple of 16) instead of strips if not 0."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    encode = _CODERS[compression][0]
    for page in pages:
        rows, columns, samples = (*page.shape, 1)[:3]
        image = page.reshape(rows, columns, samples)
        if tile:
            grid = [(y, x) for y in range(0, rows, tile) for x in range(0, columns, tile)]
            blocks = []
            for y, x in grid:
                block = np.zeros((tile, tile, samples), np.uint8)
                part = image[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            coded = encode(block.tobytes())
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded
        # tag: (type, values); types: 3 short, 4 long
        tags = {256: (4, [columns]), 257: (4, [rows]), 258: (3, [8] * samples), 259: (3, [compression]), 262: (3, [1 if samples < 3 else 2]), 277: (3, [samples]), 284: (3, [1])}
        tags |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, counts)} if tile else {273: (4, offsets), 278: (4, [strip_rows]), 279: (4, counts)}
        if predictor != 1:
            tags[317] = (3, [predictor])
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            value = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), len(out)))
                out += value
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(file: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(compression, predictor, samples as (rows, columns, samples)) of each page; raises ValueError if it isn't such a TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if order is None or len(file) < 8 or struct.unpack_from(order + "H", file, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", file, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        try:
            for k in range(struct.unpack_from(order + "H", file, at)[0]):
                tag, kind, n = struct.unpack_from(order + "HHI", file, at + 2 + 12 * k)
                code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
                if not code:
                    continue
                place = at + 10 + 12 * k
                if n * size > 4:
                    place = struct.unpack_from(order + "I", file, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{code}", file, place)
            at = struct.unpack_from(order + "I", file, at + 2 + 12 * len_of(file, at, order))[0]
        except struct.error as e:
            raise ValueError("directory out of bounds") from e
        one = lambda tag, default, t=tags: t.get(tag, (default,))[0]
        columns, rows, samples, compression, predictor = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(317, 1)
        if compression not in _CODERS or set(tags.get(258, (8,))) != {8} or predictor not in (1, 2) or one(284, 1) != 1:
            raise ValueError("a kind of TIFF that isn't read here")
        tiled = 324 in tags
        width, height = (one(322, 0), one(323, 0)) if tiled else (columns, min(one(278, rows), rows) or 1)
        starts, counts = (tags.get(324, ()), tags.get(325, ())) if tiled else (tags.get(273, ()), tags.get(279, ()))
        n_parts = -(-rows // height) * -(-columns // width) if width and height else 0
        if n_parts != len(starts) or len(starts) != len(counts):
            raise ValueError("parts don't make up the page")
        # a header alone can ask for any size; no coder makes more than EXPANDS bytes of one
        stored = sum(min(max(c, 0), max(len(file) - s, 0)) for s, c in zip(starts, counts, strict=True))
        if max(rows, height) * max(columns, width) * samples > EXPANDS * stored:
            raise ValueError("a page of more bytes than its parts can hold")
        grid = [(y, x) for y in range(0, rows, height) for x in range(0, columns, width)] if n_parts else []
        image = np.empty((rows, columns, samples), np.uint8)
        for (y, x), start, count in zip(grid, starts, counts, strict=True):
            high = height if tiled else min(height, rows - y)
            raw = np.frombuffer(_CODERS[compression][1](file[start : start + count]), np.uint8)
            if len(raw) < high * width * samples:
                raise ValueError("a part is too short")
            block = raw[: high * width * samples].reshape(high, width, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y : y + high, x : x + width] = block[: rows - y, : columns - x]
        yield compression, predictor, image


def len_of(file: bytes, at: int, order: str) -> int:
    """Entries of the directory at a place."""
    return struct.unpack_from(order + "H", file, at)[0]


def text_pages(payload: bytes) -> list[np.ndarray]:
    """The pages whose rows hold a payload of a multiple of ROW bytes."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return [image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)]


def form_of(payload: bytes) -> dict:
    """How a payload is stored, by its checksum: an eighth as LZW strips, an eighth as PackBits strips, three eighths each as deflate strips and deflate tiles, half of all high byte first."""
    code = zlib.crc32(payload)
    order = "<>"[code >> 4 & 1]
    if code & 7 == 0:
        return {"compression": LZW, "order": order}
    if code & 7 == 1:
        # runs of spaces are what PackBits gains by; differences would break up none of them, and help nothing
        return {"compression": PACKBITS, "predictor": 1, "order": order}
    return {"compression": DEFLATE, "tile": TILE if code & 7 < 5 else 0, "order": order}


def texts_to_tiff(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, media): each text as UTF-8, filled up with spaces to a positive multiple of ROW, as a TIFF of the form that form_of tells. Null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                full = [x + b" " * (-len(x) % ROW or (0 if x else ROW)) for x in raw]
                media = [write_tiff(text_pages(x), **form_of(x)) for x in full]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


#: What reading a damaged file ends in.
DAMAGED = (ValueError, zlib.error, IndexError, struct.error, OverflowError, MemoryError)
_PAGE = "struct<page: int, width: int, height: int, samples: int, compression: int, predictor: int, mean: int, distinct: int, pixels: binary>"


def with_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """df with a column `pages`, the decoded pages of the TIFF in `media`, and `error`, null unless the file can't be read.

    Null media: no pages, no error. Each row is worked on alone; repeated rows stay. A file that breaks off keeps the pages before.
    """
    others = [c for c in df.columns if c not in ("pages", "error")]
    df = df.select(*others)
    place = others.index(media)
    page_type = pa.struct([*((x, pa.int32()) for x in ("page", "width", "height", "samples", "compression", "predictor", "mean", "distinct")), ("pixels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part, pages, errors = batch.slice(i, 512), [], []
                for file in part.column(place).to_pylist():
                    mine, error = [], None
                    try:
                        for n, (compression, predictor, image) in enumerate(read_pages(file) if file is not None else ()):
                            seen = np.bincount(image.ravel(), minlength=256)
                            rows, columns, samples = image.shape
                            mine.append({"page": n, "width": columns, "height": rows, "samples": samples, "compression": compression, "predictor": predictor, "mean": int(image.mean()) if image.size else 0, "distinct": int((seen > 0).sum()), "pixels": image.tobytes()})
                    except DAMAGED as e:
                        error = str(e)
                    pages.append(mine)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pages, pa.list_(page_type)), pa.array(errors, pa.string())], [*others, "pages", "error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, pages array<{_PAGE}>, error string")


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page: df's columns but the file, the page's columns and error; a file without pages has one row of nulls."""
    rest = [c for c in df.columns if c not in (media, "pages", "error", "page")]
    return with_pages(df, media).select(*rest, "error", F.explode_outer("pages").alias("page")).select(*rest, "error", "page.*")


def payload(pages: Column) -> Column:
    """The bytes of all pages, in order."""
    return F.when(F.size(pages) == 1, F.element_at(pages, 1)["pixels"]).otherwise(F.aggregate(pages, F.to_binary(F.lit(""), F.lit("utf-8")), lambda a, p: F.concat(a, p["pixels"])))


def text_media(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): what storing the text as TIFF and reading it back gives.

    Null texts count as empty; equal texts have equal values; null ids and repeated rows stay; other columns are left aside; a long text has several
    pages; an empty table gives an empty one.
    """
    stored = with_pages(texts_to_tiff(docs, "doc_id", "text"))
    back = stored.withColumn("payload", payload(F.col("pages")))
    feature = F.concat_ws(";", F.transform("pages", lambda p: F.concat_ws(":", p["page"], p["width"], p["height"], p["mean"], p["distinct"])))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.size("pages").alias("n_pages"),
    )
