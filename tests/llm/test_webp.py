import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harborlight.llm import media, webp


def picture(seed, height=23, width=37, colours=None):
    rng = np.random.RandomState(seed)
    y, x = np.mgrid[:height, :width]
    image = np.stack([(x * 5 + y) % 256, (x + y * 3) % 256, (x * y) % 256, np.full_like(x, 255)], axis=-1)
    image = (image + rng.randint(0, 4, image.shape) * (np.arange(4) < 3)).astype(np.uint8)
    if colours:
        table = rng.randint(0, 256, (colours, 4)).astype(np.uint8)
        image = table[rng.randint(0, colours, (height, width))]
    return image


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    image = picture(mode)
    assert np.array_equal(webp.decode(webp.encode(image, predictor=mode, block=3)), image)


@pytest.mark.parametrize("cross", [(0, 0, 0), (17, 250, 3), (128, 127, 255)])
def test_cross_colour_and_subtract_green(cross):
    image = picture(1)
    assert np.array_equal(webp.decode(webp.encode(image, cross=cross)), image)
    assert np.array_equal(webp.decode(webp.encode(image, predictor=12, cross=cross, subtract_green=True, cache_bits=5)), image)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    image = picture(colours, colours=colours)
    for references in (False, True):
        assert np.array_equal(webp.decode(webp.encode(image, palette=True, references=references)), image)


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
def test_back_references_and_colour_cache(cache_bits):
    image = np.tile(picture(9, 7, 11), (9, 5, 1))
    coded = webp.encode(image, references=True, cache_bits=cache_bits)
    assert np.array_equal(webp.decode(coded), image)
    assert len(coded) < image.size / 4


def test_alpha_and_extreme_shapes():
    for shape in ((1, 1), (1, 300), (300, 1)):
        image = np.random.RandomState(2).randint(0, 256, (*shape, 4)).astype(np.uint8)
        for options in ({}, {"references": True}, {"cache_bits": 3}, {"predictor": 11}):
            assert np.array_equal(webp.decode(webp.encode(image, **options)), image)


class Stream:
    """Writes a stream by hand, bit by bit, as the format's text describes it."""

    def __init__(self, width, height):
        self.bits = []
        self.put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]
        return self

    def one(self, *symbols):
        """A simple prefix code of one or two symbols."""
        self.put(1, 1).put(len(symbols) - 1, 1).put(1, 1)
        for s in symbols:
            self.put(s, 8)
        return self

    def code(self, word):
        self.bits += map(int, word)
        return self

    def file(self):
        while len(self.bits) % 8:
            self.bits.append(0)
        data = bytes(sum(b << k for k, b in enumerate(self.bits[i : i + 8])) for i in range(0, len(self.bits), 8))
        data += bytes(len(data) % 2)
        body = b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
        return b"RIFF" + len(body).to_bytes(4, "little") + body


def test_hand_made_literals():
    s = Stream(3, 2).put(0, 1).put(0, 1).put(0, 1)  # no transform, no cache, one group of codes
    s.one(10, 200).one(20).one(30, 31).one(255).one(0)
    s.code("01" "10" "00" "11" "00" "10")  # for each pixel: green, blue
    green, blue = [[10, 200, 10], [200, 10, 200]], [[31, 30, 30], [31, 30, 30]]
    image = webp.decode(s.file())
    assert image[..., 1].tolist() == green and image[..., 2].tolist() == blue
    assert (image[..., 0] == 20).all() and (image[..., 3] == 255).all()


def test_hand_made_green_and_cross_colour_transforms():
    s = Stream(2, 1).put(1, 1).put(2, 2)  # green is taken from red and blue
    s.put(1, 1).put(1, 2).put(0, 3)  # cross colour, blocks of 4 pixels
    s.put(0, 1).one(64).one(0).one(32).one(255).one(0)  # its image, a pixel: green to blue 64, green to red 32, red to blue 0
    s.put(0, 1).put(0, 1).put(0, 1).one(10, 200).one(5).one(7).one(255).one(0).code("01")
    image = webp.decode(s.file())
    signed = lambda x: x - 256 if x > 127 else x
    want = []
    for g in (10, 200):
        red, blue = 5 + (32 * signed(g) >> 5), 7 + (64 * signed(g) >> 5)
        want.append([(red + g) % 256, g, (blue + g) % 256, 255])
    assert image[0].tolist() == want


def test_hand_made_palette_of_two_colours():
    s = Stream(5, 1).put(1, 1).put(3, 2).put(1, 8)  # a palette of two colours; eight pixels in a byte
    s.put(0, 1).one(10, 90).one(20, 3).one(30, 200).one(255, 0).one(0).code("0101").code("1010")  # the second as a difference
    s.put(0, 1).put(0, 1).put(0, 1).one(0b01101).one(0).one(0).one(255).one(0)
    image = webp.decode(s.file())
    colours = [[20, 10, 30, 255], [23, 100, 230, 255]]
    assert image[0].tolist() == [colours[k] for k in (1, 0, 1, 1, 0)]


def test_hand_made_predictor():
    s = Stream(3, 2).put(1, 1).put(0, 2).put(0, 3)  # predictors for blocks of 4 pixels
    s.put(0, 1).one(2).one(0).one(0).one(255).one(0)  # mode 2: the pixel above
    s.put(0, 1).put(0, 1).put(0, 1).one(1, 40).one(2).one(3).one(0).one(0).code("100101")
    green = webp.decode(s.file())[..., 1].tolist()
    first = [40, 41, 42]  # the first row is predicted from the left, its first pixel from opaque black
    assert green == [first, [first[0] + 40, first[1] + 1, first[2] + 40]]


def test_hand_made_back_reference():
    s = Stream(4, 2).put(0, 1).put(0, 1).put(0, 1)
    # Green by code lengths: literal 10 and the length symbol 259 (four pixels), a bit each.
    s.put(0, 1).put(0, 4).put(0, 3).put(2, 3).put(1, 3).put(2, 3).put(0, 1)  # lengths of 17, 18, 0, 1; all 280 symbols
    s.code("0" * 10).code("10").code("11").put(127, 7).code("11").put(99, 7).code("10").code("11").put(9, 7)
    s.one(20, 21).one(30).one(255).one(0)  # distance symbol 0: the pixel above
    s.code("00" "01" "00" "01").code("1")
    image = webp.decode(s.file())
    assert image[..., 0].tolist() == [[20, 21, 20, 21]] * 2 and (image[..., 1] == 10).all()


def test_pixel_arrays_written_and_read_back(spark, tmp_path, monkeypatch):
    texts = [None, "x", "é" * 500, "Word " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string").withColumn("pixels", F.lit(1))
    path = str(tmp_path / "pixels")
    media.pixel_arrays(media.media_table(docs)).write.parquet(path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 5
    for r in rows:
        data, _ = media.payload(texts[r.doc_id] if r.doc_id is not None else "x")
        assert r.height * r.width * 3 == len(r.pixels) and bytes(r.pixels)[: len(data)] == data
    assert media.media_digest(media.media_table(docs.limit(0))).count() == 0
    assert media.pixel_arrays(media.media_table(docs.limit(0))).count() == 0


def test_damaged_streams_raise():
    coded = webp.encode(picture(3))
    with pytest.raises(ValueError):
        webp.decode(coded[: len(coded) // 2])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + bytes(40))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=700), st.text(alphabet="ab \n", max_size=3000), st.just("Word " * 900), st.just("")))
def test_payloads_come_back(text):
    data, n = media.payload(text)
    assert len(data) % 192 == 0 and data[:n] == text.encode() and set(data[n:]) <= {32}
    assert media.load(media.store(data)).tobytes() == data


def usual_texts(seed, count, most=400):
    rng = np.random.RandomState(seed)
    words = ["".join(map(chr, rng.randint(97, 123, rng.randint(2, 9)))) for _ in range(200)]
    return [" ".join(words[k] for k in (rng.zipf(1.3, rng.randint(0, most)) % 200)) for _ in range(count)]


def parts_of(stored):
    """Whether a stored image has a transform, and the code lengths of green, of back-references and cache places."""
    bits = webp.Bits(stored[20:])
    bits.read(40)
    if bits.read(1):
        return True, None
    cache = 1 << bits.read(4) if bits.read(1) else 0
    assert not bits.read(1)
    return False, webp.read_group(bits, cache)[0].lengths


def test_usual_texts_are_stored_with_references_and_colour_cache():
    for text in usual_texts(5, 4, 40000)[:2] + ["".join(usual_texts(6, 20))]:
        data, _ = media.payload(text)
        stored = media.store(data)
        transformed, green = parts_of(stored)
        assert not transformed and green[256:280].any() and green[280:].any()
        assert len(stored) < len(webp.encode(media.to_image(data)))
        assert media.load(stored).tobytes() == data


@pytest.mark.parametrize("step", [1, 64])
def test_transforms_are_used_where_they_save_bits(step):
    rng = np.random.RandomState(step)
    pixels = np.cumsum(rng.randint(0, 3, (40 * 64 // step, step, 3)), axis=0).astype(np.uint8)  # like the pixel before it, or the one above
    data = pixels.tobytes()
    stored = media.store(data)
    assert parts_of(stored)[0] and len(stored) < len(data) / 2
    assert media.load(stored).tobytes() == data


def test_images_decoded_in_step():
    texts = usual_texts(7, 150) + ["", "Word " * 700, "ab" * 900, "é" * 500, usual_texts(8, 1, 9000)[0]] + ["".join(map(chr, range(32, 127))) * 40]
    payloads = [media.payload(t)[0] for t in texts]
    stored = media.store_all(payloads)
    assert stored == [media.store(data) for data in payloads]  # whatever they are stored together with
    for some in (slice(None), slice(0, 10)):
        for data, made in zip(payloads[some], media.images_all(stored[some])):
            assert b"".join(pixels.tobytes() for pixels in made) == data
    for k, data in enumerate(stored):
        assert np.array_equal(webp.decode(data), webp.decode_all([data])[0])
    with pytest.raises(ValueError):
        webp.decode_all([data[: 20 + len(data) // 2] for data in stored])


def test_payloads_too_high_for_one_column():
    data = bytes(range(256)) * 3 * 4 * 4101
    data = data[: len(data) // 192 * 192]
    image = media.to_image(data)
    assert image.shape[0] <= webp.MAX_SIDE and image[..., :3].tobytes() == data


def test_tall_payloads_of_a_prime_number_of_rows_come_back(spark):
    import hashlib

    rng = np.random.RandomState(4)
    texts = ["".join(map(chr, rng.randint(97, 123, rows * media.ROW - 5))) for rows in (16411, 16384)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in media.media_digest(media.media_table(docs)).collect()}
    for i, text in enumerate(texts):
        data, n = media.payload(text)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (n, len(data), hashlib.sha256(data).hexdigest())
    assert rows[0].feature.startswith("128x8206 ") and rows[1].feature.startswith("64x16384 ")


def test_payloads_over_one_image_are_several(monkeypatch):
    monkeypatch.setattr(media, "PART_BYTES", 5 * media.ROW)
    data, n = media.payload("Word and other words " * 130)
    made = media.images(media.store(data))
    assert len(made) == 3 and b"".join(pixels.tobytes() for pixels in made)[: media.padded(n)] == data
    assert media.feature(*made).split(" mean ")[0] == "64x5+64x5+64x5"
    assert media.feature(*made).split(" mean ")[1] == media.feature(np.concatenate(made)).split(" mean ")[1]


def test_query_columns(spark):
    texts = [None, "", "x", "é" * 500, "Word " * 800, "some text\n" * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string")
    rows = {r.doc_id: r for r in media.media_digest(media.media_table(docs)).collect()}
    import hashlib
    import zlib

    for i, text in enumerate(texts):
        data, n = media.payload(text)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(data), zlib.crc32(data[-16:]))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest()
    assert rows[None].media_sha256 == rows[2].media_sha256


def test_codes_of_many_images_are_read_in_step(monkeypatch):
    sides = np.random.RandomState(4).randint(1, 40, (60, 2)).tolist()
    images = [picture(k, h, w, 30 if k % 3 else None) for k, (h, w) in enumerate(sides)]
    for image in images:
        image[..., 3] = 255
    files = [webp.encode(im, cache_bits=k % 12, references=bool(k % 2)) for k, im in enumerate(images)]
    single = [webp.decode(f) for f in files]
    monkeypatch.setattr(webp, "read_group", None)  # reads the codes of one image
    for one, together, image in zip(single, webp.decode_all(files), images):
        assert np.array_equal(one, image) and np.array_equal(together, image)


def test_code_lengths_read_in_step_as_one_by_one():
    rng = np.random.RandomState(5)
    made, sizes = [], []
    for k in range(40):
        out = webp.Fields()
        if k % 4 == 0:
            out.put(1 | (k % 8 // 4) << 1 | 1 << 2 | int(rng.randint(256)) << 3, 11)
            out.put(int(rng.randint(40)), 8 * (k % 8 // 4))
        elif k % 4 == 1:  # the length before it again, and zeros by both runs
            tokens = [(8, 0, 0)] * 3 + [(16, 3, 2)] * 42 + [(8, 0, 0), (17, 2, 3)]
            of_lengths = webp.code_lengths(webp._header_counts(tokens), 7)
            webp._put_header(out, tokens, of_lengths.tolist(), webp.reversed_codes(of_lengths).tolist())
        else:
            webp.write_code(out, webp.code_lengths(rng.randint(0, 50, 280) * (rng.rand(280) < rng.rand())))
        made.append(out.value.to_bytes((out.size + 7) // 8 + 24, "little"))
        sizes.append(280)
    starts = np.cumsum([0] + [len(m) for m in made])[:-1] * 8
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(made), dtype=np.uint8), 8)).view("<i8").ravel()
    at = starts.copy()
    found = webp._many_lengths(words, at, np.array(sizes))
    for k, data in enumerate(made):
        bits = webp.Bits(data)
        lengths, _ = webp.read_lengths(bits, 280)
        assert np.array_equal(found[k], lengths) and at[k] - starts[k] == bits.at


def test_small_batches_are_read_back_together(monkeypatch):
    import pyarrow as pa

    texts = [f"text {k} " * (k % 30) for k in range(100)]
    rows = list(zip(*((k, len(t), media.store(media.payload(t)[0])) for k, t in enumerate(texts))))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["doc_id", "n_bytes", "media"])
    calls, read = [], media.images_all
    monkeypatch.setattr(media, "images_all", lambda files: calls.append(len(files)) or read(files))
    small = pa.Table.from_batches(list(media._load_rows(batch.slice(k, 10) for k in range(0, 100, 10))))
    whole = pa.Table.from_batches(list(media._load_rows([batch])))
    assert calls == [100, 100] and small.combine_chunks().equals(whole.combine_chunks())
    monkeypatch.setattr(media, "READ_ROWS", 7)
    assert pa.Table.from_batches(list(media._load_rows([batch]))).combine_chunks().equals(whole.combine_chunks()) and max(calls[2:]) == 7
