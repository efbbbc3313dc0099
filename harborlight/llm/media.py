"""Media columns: payloads kept as lossless WebP images, and pixel arrays and features read back from them.

A payload of whole rows (ROW bytes: 64 pixels of red, green and blue) is an image 64 pixels wide, and a
multiple of that where it would be too high; where no multiple divides the payload, spaces fill the image's last row, and
reading cuts to the payload's length, which follows from n_bytes. A payload over PART_BYTES is several WebP files, one
after another. Images of few colours get a palette. All others are stored as back-references, colour cache places and literals; for
each of them the cache, subtracted green, cross-colour and predictors are measured, and used where they make it smaller.

Defined cases: a null text counts as empty; an empty payload is one row of spaces; equal texts have equal values; a very long text is several
images, and one task holds its media; repeated rows and a null doc_id stay as they are; other columns, whatever their names,
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import webp
from .common import limit_batches, read, stored

ROW = 192
WIDTH = ROW // 3
#: The most that one image holds by its sides.
PART_BYTES = webp.MAX_SIDE * (webp.MAX_SIDE // WIDTH) * ROW
#: Most rows, and bytes of texts, that are stored together and read back together, where they are several.
STORED_ROWS, STORED_BYTES = 512, 4 << 20
READ_ROWS, READ_BYTES = 4096, 16 << 20


def padded(n: int) -> int:
    """The payload's length for a text of n bytes: whole rows."""
    return max(1, -(-n // ROW)) * ROW


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's bytes padded by spaces to whole rows, and their number before that."""
    data = (text or "").encode()
    return data.ljust(padded(len(data))), len(data)


def to_image(data: bytes) -> np.ndarray:
    """Payload bytes as an opaque image; wider than 64 pixels only where it would be too high, by an exact width if there is one."""
    pixels = len(data) // 3
    fitting = range(max(1, -(-pixels // (webp.MAX_SIDE * WIDTH))) * WIDTH, webp.MAX_SIDE + 1, WIDTH)
    width = next((w for w in fitting if pixels % w == 0), fitting[0])
    height = -(-pixels // width)
    image = np.full((height, width, 4), 255, dtype=np.uint8)
    image[..., :3] = np.frombuffer(data.ljust(height * width * 3), dtype=np.uint8).reshape(-1, width, 3)
    return image


def _few_colours(image: np.ndarray) -> bool:
    """Whether an image has at most 16 colours, so that a palette packs several pixels in a byte."""
    argb = np.frombuffer(image.tobytes(), dtype=np.uint32)
    return len(set(argb[:64].tolist())) <= 16 and len(np.unique(argb)) <= 16


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Payloads as WebP files (one for each part of PART_BYTES, one after another), worked on together."""
    owners, made = [], []
    for k, data in enumerate(payloads):
        for at in range(0, len(data), PART_BYTES):
            owners.append(k)
            made.append(to_image(data[at : at + PART_BYTES]))
    files: list[bytes] = [b""] * len(made)
    usual = []
    for k, image in enumerate(made):
        if _few_colours(image):
            files[k] = webp.encode(image, palette=True, references=image.shape[0] * image.shape[1] > 64)
        else:
            usual.append(k)
    if usual:
        for k, file in zip(usual, webp.encode_opaque([made[k] for k in usual])):
            files[k] = file
    out = [b""] * len(payloads)
    for k, file in zip(owners, files):
        out[k] += file
    return out


def store(data: bytes) -> bytes:
    return store_all([data])[0]


def load(media: bytes) -> np.ndarray:
    """The pixel array of one image: height by width by 3."""
    return webp.decode(media)[..., :3]


def images_all(rows: list[bytes]) -> list[list[np.ndarray]]:
    """The pixel arrays of all images of each payload, decoded together."""
    files, owners = [], []
    for k, media in enumerate(rows):
        at = 0
        while at < len(media):
            end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
            files.append(media[at:end])
            owners.append(k)
            at = end
    made: list[list[np.ndarray]] = [[] for _ in rows]
    for k, pixels in zip(owners, webp.decode_all(files)):
        made[k].append(pixels[..., :3])
    return made


def images(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of all images of a payload."""
    return images_all([media])[0]


def feature(*made: np.ndarray) -> str:
    """Sides of each image, mean of each channel and entropy (bits a sample) of all of them."""
    size = sum(pixels.size for pixels in made)
    counts = sum(np.bincount(pixels.ravel(), minlength=256) for pixels in made)
    share = counts[counts > 0] / size
    means = sum(pixels.reshape(-1, 3).mean(axis=0) * (pixels.size / size) for pixels in made)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    sides = "+".join(f"{pixels.shape[1]}x{pixels.shape[0]}" for pixels in made)
    return f"{sides} mean {means[0]:.3f},{means[1]:.3f},{means[2]:.3f} entropy {entropy:.4f}"


def _parts(batch: pa.RecordBatch, sizes: list[int], most_rows: int, most_bytes: int):
    """Slices of a batch that hold so many rows and bytes of text at most, or one row."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and (k - start == most_rows or held + size > most_bytes):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _read_together(batches):
    """The rows of batches, of several where they are small, so that no more than READ_ROWS and READ_BYTES come at once, or one row."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for part in _parts(batch, batch.column("n_bytes").to_pylist(), READ_ROWS, READ_BYTES):
            more = sum(part.column("n_bytes").to_pylist())
            if held and (rows + part.num_rows > READ_ROWS or size + more > READ_BYTES):
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
            held.append(part)
            rows, size = rows + part.num_rows, size + more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _store_rows(batches):
    for batch in batches:
        sizes = [len(t or "") for t in batch.column("text").to_pylist()]
        for part in _parts(batch, sizes, STORED_ROWS, STORED_BYTES):
            made = [payload(t) for t in part.column("text").to_pylist()]
            media = pa.array(store_all([data for data, _ in made]), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for _, n in made], pa.int64()), media], names=["doc_id", "n_bytes", "media"]
            )


def _load_rows(batches):
    for part in _read_together(batches):
        rows = []
        read_back = images_all(part.column("media").to_pylist())
        for media, n, made in zip(part.column("media").to_pylist(), part.column("n_bytes").to_pylist(), read_back):
            data = b"".join(pixels.tobytes() for pixels in made)[: padded(n)]
            rows.append((
                len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media),
                hashlib.sha256(media).hexdigest(), feature(*made),
            ))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        table = part.drop_columns(["media"])
        for name, values, kind in zip(names, zip(*rows), kinds):
            table = table.append_column(name, pa.array(values, kind))
        yield from table.to_batches()


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (lossless WebP of the text's payload) for docs (doc_id, text)."""
    limit_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_store_rows, f"doc_id {kind}, n_bytes long, media binary")


def _pixel_rows(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            made = images(batch.column("media")[at].as_py())
            doc = batch.column("doc_id").take(pa.array([at] * len(made)))
            sides = [[p.shape[k] for p in made] for k in (0, 1)]
            flat = np.concatenate([p.reshape(-1) for p in made])
            ends = np.cumsum([0] + [p.size for p in made]).astype(np.int32)
            pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int16)))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(range(len(made)), pa.int32()), pa.array(sides[0], pa.int32()), pa.array(sides[1], pa.int32()), pixels],
                names=["doc_id", "image", "height", "width", "pixels"],
            )


def pixel_arrays(media: DataFrame) -> DataFrame:
    """A row for each image of media (doc_id, media): doc_id, image (its number), height, width, and pixels.

    pixels: height by width by red, green and blue, from 0 to 255, row by row.
    """
    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "media").mapInArrow(_pixel_rows, f"doc_id {kind}, image int, height int, width int, pixels array<smallint>")


def media_digest(media: DataFrame) -> DataFrame:
    kind = dict(media.dtypes)["doc_id"]
    return media.mapInArrow(
        _load_rows,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(stored(media_table(read(spark, sf_dir, "documents")), "media"))
