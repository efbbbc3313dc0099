"""Lossless WebP (VP8L) in numpy: a decoder of the whole format, and an encoder that can use each of its parts.

The format is public (RFC 9649). Images are arrays of height by width by 4 bytes: red, green, blue, alpha.

A stream of literals in one group of prefix codes is decoded over whole arrays: for every bit
position the code lengths that would be read there give the position of the next pixel, a short walk picks those that
begin a pixel, and the symbols are looked up at them. Streams with back-references, a colour cache or several groups are
decoded token by token.
"""

from __future__ import annotations

import heapq

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)  # green and lengths, red, blue, alpha, distances
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14

#: Longest code that the encoder makes; look-up tables of streams with no longer ones stay small.
MAX_BITS = 11


def _mirrored(bits: int = 15) -> np.ndarray:
    out = np.zeros(1, dtype=np.int64)
    for k in range(bits):
        out = np.concatenate((out, out + (1 << (bits - 1 - k))))
    return out


#: Each number of 15 bits with its bits in reverse.
MIRROR = _mirrored()
_MIRROR = MIRROR.tolist()


def in_code_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that have a code, in the order of their codes, and the part of all 15-bit words that each takes."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    return order, 1 << (15 - lengths[order])


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical prefix codes for code lengths (0: no code), with the first bit lowest."""
    order, share = in_code_order(lengths)
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[order] = MIRROR[np.cumsum(share) - share]
    return codes


class Code:
    """A prefix code's look-up table: symbol and length by the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        order, share = in_code_order(lengths)
        if len(order) < 2:
            self.lengths, self.bits = np.zeros_like(lengths), 1
            self.symbol = np.full(2, order[0] if len(order) else 0)
            self.length = np.zeros(2, dtype=np.int64)
            return
        if share.sum() != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.lengths, self.bits = lengths, int(lengths[order[-1]])
        times = share >> (15 - self.bits)
        place = MIRROR[: 1 << self.bits] >> (15 - self.bits)
        self.symbol = np.repeat(order, times)[place]
        self.length = np.repeat(lengths[order], times)[place]


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(16), at

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > (len(self.data) - 8) * 8:
            raise ValueError("the stream ends early")
        return value & ((1 << n) - 1)

    def field(self, at: int, n: int) -> int:
        """n bits from bit `at`, which may be many; the place of reading stays."""
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        first = self.at >> 3
        k = (int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)) & ((1 << code.bits) - 1)
        self.at += int(code.length[k])
        if self.at > (len(self.data) - 8) * 8:
            raise ValueError("the stream ends early")
        return int(code.symbol[k])


def _small_code(lengths: list[int]) -> tuple[list[int], list[int]]:
    """Code's symbols and lengths as lists, for few symbols."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] if used else 0] * 2, [0, 0]
    longest, start = used[-1][0], 0
    size = 1 << longest
    symbols, counts = [0] * size, [0] * size
    for n, s in used:
        if start >= 1 << 15:
            raise ValueError("a prefix code is not complete")
        first, times = _MIRROR[start], size >> n
        symbols[first :: 1 << n], counts[first :: 1 << n] = [s] * times, [n] * times
        start += 1 << (15 - n)
    if start != 1 << 15:
        raise ValueError("a prefix code is not complete")
    return symbols, counts


def read_lengths(bits: Bits, size: int) -> tuple[np.ndarray, bool]:
    """Code lengths of a prefix code over `size` symbols, and whether the header alone says where they end."""
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths, True
    of_lengths = [0] * 19
    listed = 4 + bits.read(4)
    word = bits.read(3 * listed)
    for i, k in enumerate(CODE_LENGTH_ORDER[:listed]):
        of_lengths[k] = word >> 3 * i & 7
    symbols, counts = _small_code(of_lengths)
    bounded = bool(bits.read(1))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bounded else size
    mask, data, at = len(symbols) - 1, bits.data, bits.at
    out: list[int] = []
    previous = 8
    ahead = 0  # bits that word still has
    while len(out) < size and left:
        left -= 1
        if ahead < 14:
            word, ahead = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 57
        s, n = symbols[word & mask], counts[word & mask]
        at, word, ahead = at + n, word >> n, ahead - n
        if s < 16:
            out.append(s)
            previous = s or previous
        elif s == 16:
            out += [previous] * (3 + (word & 3))
            at, word, ahead = at + 2, word >> 2, ahead - 2
        elif s == 17:
            out += [0] * (3 + (word & 7))
            at, word, ahead = at + 3, word >> 3, ahead - 3
        else:
            out += [0] * (11 + (word & 127))
            at, word, ahead = at + 7, word >> 7, ahead - 7
    bits.at = at
    if len(out) > size:
        raise ValueError("too many code lengths")
    lengths[: len(out)] = out
    return lengths, bounded and len(out) < size


def read_group(bits: Bits, cache: int) -> list[Code]:
    codes: list[Code] = []
    start, bounded = bits.at, False
    for k, size in enumerate(ALPHABETS):
        before, taken = bits.at, bits.at - start
        if k in (1, 2) and bounded and codes[-1].lengths[256:].sum() == 0 and bits.field(before, taken) == bits.field(start, taken):
            bits.at += taken  # bit for bit the header before it, so the same code
            codes.append(codes[-1])
        else:
            lengths, bounded = read_lengths(bits, size + (cache if k == 0 else 0))
            codes.append(Code(lengths))
        start = before
    return codes


def _literals(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """n pixels of literals, decoded over all bit positions at once."""
    first = bits.at >> 3
    data = np.frombuffer(bits.data, dtype=np.uint8)[first:].astype(np.uint32)
    wide = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16)
    words = (wide[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
    end = len(words)
    here = np.arange(end)
    after, steps = here, []
    for code in codes[:4]:
        mask = np.uint32((1 << code.bits) - 1)
        steps.append((after, code, mask))
        if code.length.any():
            after = np.minimum(after + code.length[words[after] & mask], end - 1)
    at = bits.at & 7
    starts = np.empty(n, dtype=np.int64)
    if after is here:  # codes of one symbol take no bits
        starts[:] = at
    else:
        following = memoryview(after)
        for k in range(n):
            starts[k] = at
            at = following[at]
        if at >= end - 1 - 8:
            raise ValueError("the stream ends early")
    bits.at = first * 8 + int(at)
    out = np.empty((n, 4), dtype=np.uint8)
    for channel, (positions, code, mask) in zip((1, 0, 2, 3), steps):
        out[:, channel] = code.symbol[words[positions[starts]] & mask]
    return out


def _prefixed(bits: Bits, symbol: int) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _one_group(bits: Bits, codes: list[Code], n: int, width: int, cache_bits: int) -> list[int]:
    """n pixels of one group of codes whose alpha takes no bits, as 32-bit integers."""
    first = bits.at >> 3
    data = np.frombuffer(bits.data, dtype=np.uint8)[first:]
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel().tolist()
    # An entry holds a code's length in its lowest six bits and its part of the pixel above; lengths and cache places are negative.
    alpha = int(codes[3].symbol[0])
    part = np.where(codes[0].symbol < 256, codes[0].symbol << 8 | alpha << 24, -1 - codes[0].symbol)
    greens = (part << 6 | codes[0].length).tolist()
    reds = (codes[1].symbol << 22 | codes[1].length).tolist()
    blues = (codes[2].symbol << 6 | codes[2].length).tolist()
    green_mask, red_mask, blue_mask = (len(table) - 1 for table in (greens, reds, blues))
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    out: list[int] = []
    put, left = out.append, n
    at, end = bits.at - first * 8, (len(data) - 8) * 8
    try:
        while left > 0:
            word = words[at >> 3] >> (at & 7)
            entry = greens[word & green_mask]
            if entry >= 0:
                word >>= entry & 63
                more = reds[word & red_mask]
                entry += more + blues[word >> (more & 63) & blue_mask]
                at += entry & 63
                pixel = entry >> 6
                put(pixel)
                left -= 1
                if cache_bits:
                    cache[((pixel * CACHE_FACTOR) & 0xFFFFFFFF) >> shift] = pixel
                continue
            at += entry & 63
            symbol = -1 - (entry >> 6)
            if symbol >= 280:
                put(cache[symbol - 280])
                left -= 1
                if not out[-1]:  # a place that nothing was put in holds a pixel of zeros, which is put where it belongs
                    cache[0] = 0
                continue
            bits.at = first * 8 + at
            length = _prefixed(bits, symbol - 256)
            code = _prefixed(bits, bits.symbol(codes[4]))
            at = bits.at - first * 8
            back = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if back > n - left or length > left:
                raise ValueError("a back-reference leaves the image")
            left -= length
            copied = out[-back : length - back or None] if length < back else out[-back:]
            while len(copied) < length:
                copied += copied[: length - len(copied)]
            out += copied
            if cache_bits:
                for pixel in copied[-back:]:  # those before it come again
                    cache[((pixel * CACHE_FACTOR) & 0xFFFFFFFF) >> shift] = pixel
    except IndexError:
        at = end + 1
    if at > end:
        raise ValueError("the stream ends early")
    bits.at = first * 8 + at
    return out


def _packed(pixels: np.ndarray) -> np.ndarray:
    """Pixels as 32-bit integers: alpha highest, then red, green, blue."""
    p = pixels.astype(np.uint32)
    return p[..., 3] << np.uint32(24) | p[..., 0] << np.uint32(16) | p[..., 1] << np.uint32(8) | p[..., 2]


def _unpacked(argb: np.ndarray) -> np.ndarray:
    argb = np.asarray(argb, dtype=np.uint32)
    return np.stack([(argb >> np.uint32(k)) & np.uint32(255) for k in (16, 8, 0, 24)], axis=-1).astype(np.uint8)


def read_image(bits: Bits, width: int, height: int, whole: bool) -> np.ndarray:
    """An entropy-coded image; only that of the whole picture may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    block, group_of = 0, None
    if whole and bits.read(1):
        block = bits.read(3) + 2
        side = (1 << block) - 1
        across, down = (width + side) >> block, (height + side) >> block
        numbers = read_image(bits, across, down, False).astype(np.int64)
        group_of = numbers[..., 0] * 256 + numbers[..., 1]
    groups = [read_group(bits, cache_size) for _ in range(1 if group_of is None else int(group_of.max()) + 1)]
    n = width * height
    if group_of is None and not cache_size and not groups[0][0].lengths[256:].any():
        return _literals(bits, groups[0], n).reshape(height, width, 4)
    if group_of is None and not groups[0][3].length.any():
        return _unpacked(np.array(_one_group(bits, groups[0], n, width, cache_bits), dtype=np.uint32)).reshape(height, width, 4)
    out = [0] * n
    cache = [0] * cache_size
    shift = 32 - cache_bits
    at = 0
    while at < n:
        group = groups[0 if group_of is None else int(group_of[(at // width) >> block, (at % width) >> block])]
        s = bits.symbol(group[0])
        if 256 <= s < 280:
            length = _prefixed(bits, s - 256)
            code = _prefixed(bits, bits.symbol(group[4]))
            back = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if back > at or length > n - at:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                pixel = out[at] = out[at - back]
                if cache_size:
                    cache[((pixel * CACHE_FACTOR) & 0xFFFFFFFF) >> shift] = pixel
                at += 1
            continue
        if s < 256:
            pixel = bits.symbol(group[1]) << 16 | s << 8 | bits.symbol(group[2]) | bits.symbol(group[3]) << 24
        else:
            pixel = cache[s - 280]
        out[at] = pixel
        at += 1
        if cache_size:
            cache[((pixel * CACHE_FACTOR) & 0xFFFFFFFF) >> shift] = pixel
    return _unpacked(np.array(out, dtype=np.uint32)).reshape(height, width, 4)


def predict(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """The prediction of a pixel (four channels) by one of the 14 modes."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda x: min(255, max(0, x))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - tl) for t, tl in zip(top, top_left))
        to_top = sum(abs(x - tl) for x, tl in zip(left, top_left))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - tl) for x, t, tl in zip(left, top, top_left)]
    if mode == 13:
        mean = half(left, top)
        return [clamp(m + int((m - tl) / 2)) for m, tl in zip(mean, top_left)]
    return [0, 0, 0, 255]


def _predicted(image: np.ndarray, modes: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """Add predictions to residuals (inverse), or take them from pixels."""
    height, width = image.shape[:2]
    source = image.astype(np.int64).reshape(-1, 4).tolist()
    done = source if not inverse else [None] * len(source)
    out = [None] * len(source)
    for k in range(len(source)):
        y, x = divmod(k, width)
        if y == 0:
            guess = [0, 0, 0, 255] if x == 0 else done[k - 1]
        elif x == 0:
            guess = done[k - width]
        else:
            guess = predict(int(modes[y >> block, x >> block]), done[k - 1], done[k - width], done[k - width + 1], done[k - width - 1])
        if inverse:
            done[k] = out[k] = [(r + g) & 255 for r, g in zip(source[k], guess)]
        else:
            out[k] = [(p - g) & 255 for p, g in zip(source[k], guess)]
    return np.array(out, dtype=np.uint8).reshape(height, width, 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int64)


def _cross(image: np.ndarray, factors: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """Cross-colour transform; factors hold red-to-blue, green-to-blue, green-to-red in red, green, blue."""
    height, width = image.shape[:2]
    f = factors[(np.arange(height) >> block)[:, None], (np.arange(width) >> block)[None, :]]
    red_blue, green_blue, green_red = (_signed(f[..., k]) for k in range(3))
    green = _signed(image[..., 1])
    sign = 1 if inverse else -1
    out = image.copy()
    red = (image[..., 0].astype(np.int64) + sign * ((green_red * green) >> 5)) & 255
    known_red = red if inverse else image[..., 0].astype(np.int64)
    blue = image[..., 2].astype(np.int64) + sign * ((green_blue * green) >> 5)
    blue += sign * ((red_blue * _signed(known_red.astype(np.uint8))) >> 5)
    out[..., 0], out[..., 2] = red, blue & 255
    return out


def _bundle_bits(colours: int) -> int:
    """log2 of the pixels that share a byte in a palette image."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: height by width by 4 (red, green, blue, alpha)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L":
        raise ValueError("not a simple lossless WebP file")
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in undo):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            side = 1 << block
            undo.append((kind, read_image(bits, (coded + side - 1) >> block, (height + side - 1) >> block, False), block))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = np.cumsum(read_image(bits, size, 1, False)[0], axis=0, dtype=np.int64).astype(np.uint8)
            packing = _bundle_bits(size)
            undo.append((kind, table, packing, coded))
            coded = (coded + (1 << packing) - 1) >> packing
        else:
            undo.append((kind,))
    image = read_image(bits, coded, height, True)
    for kind, *rest in reversed(undo):
        if kind == PREDICTOR:
            image = _predicted(image, rest[0][..., 1], rest[1], True)
        elif kind == CROSS_COLOUR:
            image = _cross(image, rest[0], rest[1], True)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            table, packing, full = rest
            per, depth = 1 << packing, 8 >> packing
            index = image[..., 1, None] >> (np.arange(per) * depth).astype(np.uint8) & ((1 << depth) - 1)
            index = index.reshape(height, -1)[:, :full]
            colours = np.zeros((256, 4), dtype=np.uint8)
            colours[: len(table)] = table
            image = colours[index]
    if opaque:
        image[..., 3] = 255
    return image


#: Fewest images that are decoded in step; what is left of longer ones is decoded one by one.
FEWEST_LANES = 32
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)])
_BASE = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])
_NEAR_X, _NEAR_Y = (np.array(c) for c in zip(*NEAR))


def _many_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code's tables of each row of lengths, laid end to end: symbols, lengths, where each begins, and the mask of its places."""
    used = np.count_nonzero(lengths, axis=1)
    bits = np.where(used < 2, 1, lengths.max(axis=1)).astype(np.int64)
    if (((lengths > 0) * (1 << 15 >> lengths.astype(np.int32))).sum(axis=1)[used > 1] != 1 << 15).any():
        raise ValueError("a prefix code is not complete")
    sizes = 1 << bits
    begin = np.cumsum(sizes) - sizes
    symbols, counts = np.zeros(int(sizes.sum()), dtype=np.int16), np.zeros(int(sizes.sum()), dtype=np.int16)
    few = np.flatnonzero(used < 2)
    symbols[begin[few, None] + np.arange(2)] = lengths[few].argmax(axis=1)[:, None]
    for b in np.unique(bits[used > 1]).tolist():
        rows = np.flatnonzero((used > 1) & (bits == b))
        mine = lengths[rows]
        order = np.argsort(np.where(mine > 0, mine, np.uint8(99)), axis=1, kind="stable")[:, : int(used[rows].max())]
        mine = np.take_along_axis(mine, order, axis=1)
        times = np.where(mine > 0, 1 << b >> mine.astype(np.int32), 0).ravel()
        place = MIRROR[: 1 << b] >> (15 - b)
        to = begin[rows, None] + np.arange(1 << b)
        symbols[to] = np.repeat(order.ravel().astype(np.int16), times).reshape(len(rows), -1)[:, place]
        counts[to] = np.repeat(mine.ravel(), times).reshape(len(rows), -1)[:, place]
    return symbols, counts, begin, sizes - 1


def _many_lengths(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """read_lengths of each stream, in step: words holds 64 bits from each byte on, and `at`, which moves on, the places in bits."""
    lengths = np.zeros((len(at), int(size.max())), dtype=np.uint8)
    word = words[at >> 3] >> (at & 7)
    short = word & 1 > 0
    lanes = np.flatnonzero(short)
    two, wide = word[lanes] >> 1 & 1, word[lanes] >> 2 & 1
    first = 1 + 7 * wide
    lengths[lanes, word[lanes] >> 3 & (1 << first) - 1] = 1
    both = two > 0
    second = (word[lanes] >> (3 + first) & 255)[both]
    if (second >= size[lanes[both]]).any():
        raise ValueError("a prefix code names a symbol that there is not")
    lengths[lanes[both], second] = 1
    at[lanes] += 3 + first + 8 * two
    lanes = np.flatnonzero(~short)
    if not len(lanes):
        return lengths
    listed = 4 + (word[lanes] >> 1 & 15)
    here = at[lanes] + 5
    word = words[here >> 3] >> (here & 7)
    of_lengths = np.zeros((len(lanes), 19), dtype=np.uint8)
    for i, k in enumerate(CODE_LENGTH_ORDER):
        of_lengths[:, k] = np.where(i < listed, word >> 3 * i & 7, 0)
    here += 3 * listed
    symbols, counts, begin, mask = _many_tables(of_lengths)
    word = words[here >> 3] >> (here & 7)
    n = 2 + 2 * (word >> 1 & 7)
    bounded = word & 1 > 0
    left = np.where(bounded, 2 + (word >> 4 & (1 << n) - 1), size[lanes])
    here += np.where(bounded, 4 + n, 1)
    place, previous, most = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), 8), size[lanes]
    open_ = np.arange(len(lanes))
    while len(open_):
        go = here[open_]
        word = words[go >> 3] >> (go & 7)
        k = begin[open_] + (word & mask[open_])
        s, n = symbols[k].astype(np.int64), counts[k].astype(np.int64)
        extra = word >> n
        plain = s < 16
        to = place[open_]
        lengths[lanes[open_[plain]], to[plain]] = s[plain]
        some = plain & (s > 0)
        previous[open_[some]] = s[some]
        run = np.where(plain, 1, np.where(s == 18, 11 + (extra & 127), 3 + (extra & np.where(s == 17, 7, 3))))
        to = place[open_] = to + run
        here[open_] = go + n + np.where(plain, 0, np.where(s == 18, 7, s - 14))
        if (to > most[open_]).any():
            raise ValueError("too many code lengths")
        for lane, end, times in zip(*(x[s == 16].tolist() for x in (open_, to, run))):
            lengths[lanes[lane], end - times : end] = previous[lane]
        left[open_] -= 1
        open_ = open_[(left[open_] > 0) & (to < most[open_])]
    at[lanes] = here
    return lengths


def _in_step(streams: list[tuple]) -> list[np.ndarray | None]:
    """Pixels, as 32-bit integers, of streams (bits, pixels, width, cache bits) of one group of codes, a pixel of each at a time.

    The streams come by falling numbers of pixels; one whose alpha takes bits gets None.
    """
    sizes = np.array([len(s[0].data) for s in streams])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(s[0].data for s in streams), dtype=np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<i8").ravel()
    at = begin * 8 + np.array([s[0].at for s in streams])
    ends = (begin + sizes - 8) * 8
    cache_bits = np.array([s[3] for s in streams])
    lengths = []
    for k, size in enumerate(ALPHABETS):
        try:
            lengths.append(_many_lengths(words, at, size + np.where(cache_bits > 0, 1 << cache_bits, 0) * (k == 0)))
        except IndexError:
            raise ValueError("the stream ends early") from None
    if (at > ends).any():
        raise ValueError("the stream ends early")
    good = np.flatnonzero(np.count_nonzero(lengths[3], axis=1) < 2)
    result: list[np.ndarray | None] = [None] * len(streams)
    if not len(good):
        return result
    at, begin, ends, cache_bits, lengths = at[good], begin[good], ends[good], cache_bits[good], [x[good] for x in lengths]
    n, width = (np.array([streams[g][k] for g in good.tolist()]) for k in (1, 2))
    alpha = lengths[3].argmax(axis=1).astype(np.int64) << 24
    # An entry holds a code's length in its lowest six bits and its part of the pixel above; lengths and cache places are negative.
    symbols, counts, green_at, green_mask = _many_tables(lengths[0])
    greens = np.where(symbols < 256, symbols.astype(np.int32) << 8, -1 - symbols.astype(np.int32)) << 6 | counts
    symbols, counts, red_at, red_mask = _many_tables(lengths[1])
    reds = symbols.astype(np.int32) << 22 | counts
    symbols, counts, blue_at, blue_mask = _many_tables(lengths[2])
    blues = symbols.astype(np.int32) << 6 | counts
    symbols, counts, far_at, far_mask = _many_tables(lengths[4])
    fars = symbols.astype(np.int32) << 6 | counts
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype=np.int64)
    cache_at = np.cumsum(1 << cache_bits) - (1 << cache_bits)
    cache = np.zeros(int((1 << cache_bits).sum()), dtype=np.int64)
    shift = 32 - cache_bits
    left, back = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)  # pixels to copy, and from how far
    lanes = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()  # images of more than so many pixels
    active = long = 0
    start_at = at.copy()
    for k, m in enumerate(lanes):
        if m < FEWEST_LANES:
            long = m
            break
        if m != active:
            active = m
            g_at, g_mask, r_at, r_mask, b_at, b_mask = (x[:m] for x in (green_at, green_mask, red_at, red_mask, blue_at, blue_mask))
            here, to_copy, to, to_cache, to_shift, opacity = at[:m], left[:m], first[:m], cache_at[:m], shift[:m], alpha[:m]
        try:
            word = words[here >> 3] >> (here & 7)
        except IndexError:
            raise ValueError("the stream ends early") from None
        entry = greens[(word & g_mask) + g_at]
        copying = to_copy > 0
        special = np.flatnonzero(copying | (entry < 0))
        word >>= entry & 63
        more = reds[(word & r_mask) + r_at]
        word >>= more & 63
        more += blues[(word & b_mask) + b_at]
        more += entry
        pixel = (more >> 6) + opacity
        step = more & 63
        if len(special):
            step[special] = entry[special] & 63
            on = copying[special]
            copies, others = special[on], special[~on]
            symbol = -1 - (entry[others] >> 6)
            found = symbol >= 280
            hits = others[found]
            pixel[hits] = cache[cache_at[hits] + symbol[found] - 280]
            starts = others[~found]
            if len(starts):
                symbol = symbol[~found] - 256
                place = here[starts] + step[starts]
                if (place > ends[starts]).any():
                    raise ValueError("the stream ends early")
                word = words[place >> 3] >> (place & 7)
                length = _BASE[symbol] + (word & (1 << _EXTRA[symbol]) - 1)
                word >>= _EXTRA[symbol]
                far = fars[(word & far_mask[starts]) + far_at[starts]]
                word >>= far & 63
                by = far >> 6
                code = _BASE[by] + (word & (1 << _EXTRA[by]) - 1)
                near = np.minimum(code, 120) - 1
                distance = np.where(code > 120, code - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[starts]))
                if (distance > k).any() or (length > n[starts] - k).any():
                    raise ValueError("a back-reference leaves the image")
                step[starts] += _EXTRA[symbol] + (far & 63) + _EXTRA[by]
                left[starts], back[starts] = length, distance
            step[copies] = 0
            copies = np.concatenate((copies, starts))
            pixel[copies] = out[first[copies] + k - back[copies]]
            left[copies] -= 1
        out[to + k] = pixel
        cache[to_cache + ((pixel * CACHE_FACTOR & 0xFFFFFFFF) >> to_shift)] = pixel
        here += step
    if (at[long:] > ends[long:]).any():
        raise ValueError("the stream ends early")
    for lane, (g, a, size) in enumerate(zip(good.tolist(), first.tolist(), n.tolist())):
        if lane < long:
            bits = streams[g][0]
            bits.at = int(start_at[lane] - begin[lane] * 8)
            result[g] = np.array(_one_group(bits, [Code(x[lane].astype(np.int64)) for x in lengths], *streams[g][1:]), dtype=np.uint32)
        else:
            result[g] = out[a : a + size].astype(np.uint32)
    return result


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files; streams of one group of codes and no transform are decoded together."""
    out: list = [None] * len(files)
    streams = []
    for k, data in enumerate(files):
        bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
        head = bits.read(40) if len(data) > 25 and data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" else 0
        width, height = (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1
        # An opaque image of version 0, without transforms.
        if head & 0xFF == 0x2F and not head >> 36 and not bits.read(1):
            cache_bits = bits.read(4) if bits.read(1) else 0
            if cache_bits <= 11 and not bits.read(1):
                streams.append((width * height, k, height, (bits, width * height, width, cache_bits)))
                continue
        out[k] = decode(data)
    streams.sort(key=lambda s: -s[0])
    if streams:
        for (_, k, height, s), argb in zip(streams, _in_step([s[3] for s in streams])):
            if argb is None:
                out[k] = decode(files[k])
                continue
            out[k] = _unpacked(argb).reshape(height, s[2], 4)
            out[k][..., 3] = 255
    return out


class Fields:
    """Writes little-endian bit fields."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def code_lengths(counts: np.ndarray, longest: int = MAX_BITS) -> np.ndarray:
    """Code lengths of a prefix code for symbol counts, none over `longest`; one symbol gets length 1."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.int64)
    while True:
        heap = [(w, k) for k, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        following = len(used)
        while len(heap) > 1:
            w1, a = heapq.heappop(heap)
            w2, b = heap[0]
            parent[a] = parent[b] = following
            heapq.heapreplace(heap, (w1 + w2, following))
            following += 1
        depth = [0] * following
        for k in range(following - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= longest:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = np.maximum(weights, weights.sum() >> (longest - 1)) if weights.min() < weights.sum() >> (longest - 1) else weights // 2 + 1


def write_code(out: Fields, lengths: np.ndarray) -> None:
    """The header of a prefix code with these lengths."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        symbol = int(used[0]) if len(used) else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(int(symbol > 1), 1)
        out.put(symbol, 8 if symbol > 1 else 1)
        return
    if len(used) == 1:  # a code of one symbol that the short form can't name
        lengths = lengths.copy()
        lengths[0] = 1
        used = np.array([0, used[0]])
    tokens = _header_tokens(lengths)
    of_lengths = code_lengths(_header_counts(tokens), 7)
    _put_header(out, tokens, of_lengths.tolist(), reversed_codes(of_lengths).tolist())


def _header_tokens(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths, up to the last used symbol, as tokens: symbol, extra value and extra bits."""
    tokens: list[tuple[int, int, int]] = []
    last = -1
    used = np.flatnonzero(lengths)
    for k, value in zip(used.tolist(), lengths[used].tolist()):
        gap = k - last - 1
        last = k
        if gap:
            while gap >= 11:
                take = min(gap, 138)
                tokens.append((18, take - 11, 7))
                gap -= take
            if gap >= 3:
                tokens.append((17, gap - 3, 3))
            else:
                tokens += [(0, 0, 0)] * gap
        tokens.append((value, 0, 0))
    return tokens


def _header_counts(tokens: list[tuple[int, int, int]]) -> np.ndarray:
    counts = np.bincount([t for t, _, _ in tokens], minlength=19)
    if np.count_nonzero(counts) == 1:
        counts[0 if counts[0] == 0 else 1] = 1
    return counts


def _put_header(out: Fields, tokens: list[tuple[int, int, int]], sizes: list[int], codes: list[int]) -> None:
    out.put(0, 1)
    listed = max(4, max(k for k in range(19) if sizes[CODE_LENGTH_ORDER[k]]) + 1)
    out.put(listed - 4, 4)
    for k in CODE_LENGTH_ORDER[:listed]:
        out.put(sizes[k], 3)
    # Tokens end at the last used symbol, so their number is given.
    out.put(1, 1)
    wide = max(0, ((len(tokens) - 2).bit_length() - 1) // 2) if len(tokens) > 2 else 0
    out.put(wide, 3)
    out.put(len(tokens) - 2, 2 + 2 * wide)
    value = size = 0
    for t, extra, n in tokens:
        value |= (codes[t] | extra << sizes[t]) << size
        size += sizes[t] + n
    out.put(value, size)


def _many_code_lengths(counts: np.ndarray, longest: int = MAX_BITS) -> np.ndarray:
    """code_lengths of each row: leaves and inner nodes wait in two queues by weight, and all rows merge in step."""
    far = 1 << 40
    used = np.count_nonzero(counts, axis=1)
    by_used = np.argsort(-used, kind="stable")
    m = used[by_used]
    most = int(m[0]) if len(m) else 0
    lengths = np.zeros(counts.shape, dtype=np.int64)
    if most:
        order = np.argsort(np.where(counts > 0, counts, far)[by_used], axis=1, kind="stable")[:, :most]
        held = np.arange(most) < m[:, None]
        leaf = np.full((len(m), most + 1), far)
        leaf[:, :most][held] = np.take_along_axis(counts[by_used], order, axis=1)[held]
        inner = np.full((len(m), most + 1), far)
        parent = np.zeros((len(m), 2 * most + 1), dtype=np.int64)
        leaf_at, inner_at = np.arange(len(m)) * (most + 1), np.arange(len(m)) * (most + 1)
        node_at = np.arange(len(m)) * (2 * most + 1)
        at, done = np.zeros(len(m), dtype=np.int64), np.zeros(len(m), dtype=np.int64)
        rows = np.searchsorted(-m, -np.arange(2 * most + 2), side="left").tolist()  # rows of more than so many symbols
        leaves, inners, parents = leaf.ravel(), inner.ravel(), parent.ravel()
        for t in range(most - 1):
            r = rows[t + 1]
            total = 0
            for _ in range(2):
                one, two = leaves[leaf_at[:r] + at[:r]], inners[inner_at[:r] + done[:r]]
                first = one <= two
                parents[node_at[:r] + np.where(first, at[:r], most + done[:r])] = most + t
                total = total + np.minimum(one, two)
                at[:r] += first
                done[:r] += ~first
            inner[:r, t] = total
        depth = np.zeros((len(m), 2 * most + 1), dtype=np.int64)
        depths = depth.ravel()
        for t in range(most - 3, -1, -1):
            r = rows[t + 2]
            depth[:r, most + t] = depths[node_at[:r] + parent[:r, most + t]] + 1
        deep = np.take_along_axis(depth, parent[:, :most], axis=1) + 1
        made = np.zeros(counts.shape, dtype=np.int64)
        np.put_along_axis(made, order, np.where(held, deep, 0), axis=1)
        lengths[by_used] = made
    lengths[used == 1] = counts[used == 1] > 0
    for k in np.flatnonzero(lengths.max(axis=1, initial=0) > longest).tolist():
        lengths[k] = code_lengths(counts[k], longest)
    return lengths


def _many_reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """reversed_codes of each row."""
    order = np.argsort(np.where(lengths > 0, lengths, 99).astype(np.uint8), axis=1, kind="stable")
    sorted_lengths = np.take_along_axis(lengths, order, axis=1)
    share = np.where(sorted_lengths > 0, 1 << (15 - sorted_lengths), 0)
    start = np.cumsum(share, axis=1) - share
    codes = np.zeros(lengths.shape, dtype=np.int64)
    np.put_along_axis(codes, order, np.where(sorted_lengths > 0, MIRROR[np.minimum(start, len(MIRROR) - 1)], 0), axis=1)
    return codes


def _value_symbol(value: int) -> tuple[int, int, int]:
    """A length's or distance's symbol, extra value and extra bits."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    top = value.bit_length() - 1
    second = (value >> (top - 1)) & 1
    return 2 * top + second, value & ((1 << (top - 1)) - 1), top - 1


def _tokens(argb: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """('p', pixel), ('c', cache place) and ('r', length, distance) in the order of the stream."""
    near = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}
    out: list[tuple] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    seen: dict[tuple, int] = {}
    at, n = 0, len(argb)
    while at < n:
        length, key = 0, tuple(argb[at : at + 3])
        back = at - seen[key] if references and len(key) == 3 and key in seen else 0
        if back:
            while at + length < n and length < 4096 and argb[at + length] == argb[at + length - back]:
                length += 1
        if length >= 3:
            out.append(("r", length, near.get(back, back + 120)))
        else:
            length = 1
            place = ((argb[at] * CACHE_FACTOR) & 0xFFFFFFFF) >> shift if cache_bits else 0
            out.append(("c", place) if cache_bits and cache[place] == argb[at] and at else ("p", argb[at]))
        for k in range(at, at + length):
            seen[tuple(argb[k : k + 3])] = k
            if cache_bits:
                cache[((argb[k] * CACHE_FACTOR) & 0xFFFFFFFF) >> shift] = argb[k]
        at += length
    return out


def _write_tokens(out: Fields, image: np.ndarray, whole: bool, cache_bits: int, references: bool) -> None:
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if whole:
        out.put(0, 1)
    tokens = _tokens(_packed(image).ravel().tolist(), image.shape[1], cache_bits, references)
    counts = [np.zeros(size, dtype=np.int64) for size in ALPHABETS]
    counts[0] = np.zeros(ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), dtype=np.int64)
    for kind, *v in tokens:
        if kind == "p":
            for k, shift in enumerate((8, 16, 0, 24)):
                counts[k][v[0] >> shift & 255] += 1
        elif kind == "c":
            counts[0][280 + v[0]] += 1
        else:
            counts[0][256 + _value_symbol(v[0])[0]] += 1
            counts[4][_value_symbol(v[1])[0]] += 1
    lengths = [code_lengths(c) for c in counts]
    for k in lengths:
        write_code(out, k)
    if np.count_nonzero(lengths[0]) == 1 and np.flatnonzero(lengths[0])[0] >= 256:
        lengths[0][0] = 1
    sizes = [(np.zeros_like(k) if np.count_nonzero(k) == 1 else k).tolist() for k in lengths]
    codes = [reversed_codes(np.array(k)).tolist() for k in sizes]
    parts: list[tuple[int, int]] = []
    for kind, *v in tokens:
        if kind == "p":
            for k, shift in enumerate((8, 16, 0, 24)):
                s = v[0] >> shift & 255
                parts.append((codes[k][s], sizes[k][s]))
        elif kind == "c":
            parts.append((codes[0][280 + v[0]], sizes[0][280 + v[0]]))
        else:
            for k, (symbol, extra, n) in ((0, _value_symbol(v[0])), (4, _value_symbol(v[1]))):
                symbol += 256 if k == 0 else 0
                parts.append((codes[k][symbol] | extra << sizes[k][symbol], sizes[k][symbol] + n))
    for a in range(0, len(parts), 256):
        some = Fields()
        for value, n in parts[a : a + 256]:
            some.put(value, n)
        out.put(some.value, some.size)


def pack_bits(values: np.ndarray, sizes: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """Bit fields of up to 48 bits laid one behind another from bit `at`; bytes and the end."""
    ends = at + np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ends) else at
    words = np.zeros((total >> 6) + 3, dtype=np.uint64)
    word, shift = starts >> 6, (starts & 63).astype(np.uint64)
    values = values.astype(np.uint64)
    # Fields are in order, so those that begin in one word are neighbours: their sum is their union.
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[heads]] = np.add.reduceat(values << shift, heads)
    crossing = np.flatnonzero((starts & 63) + sizes > 64)
    words[word[crossing] + 1] |= values[crossing] >> (np.uint64(64) - shift[crossing])
    return words, total


def _joined(out: Fields, value: np.ndarray, size: np.ndarray) -> bytes:
    """The header's bits and behind them the fields."""
    words, total = pack_bits(value, size, out.size)
    head = out.value.to_bytes((out.size + 7) // 8 + 8, "little")
    data = bytearray(words.tobytes()[: (total + 7) // 8])
    if out.size & 7:
        data[out.size >> 3 : (out.size >> 3) + 1] = bytes([data[out.size >> 3] | head[out.size >> 3]]) if len(data) > out.size >> 3 else b""
    data[: out.size >> 3] = head[: out.size >> 3]
    if len(data) < (out.size + 7) // 8:
        data[out.size >> 3 :] = head[out.size >> 3 : (out.size + 7) // 8]
    return bytes(data)


def _write_literals(out: Fields, image: np.ndarray) -> bytes:
    """An image of literals in one group of codes, with one set of code lengths for red, green and blue."""
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group
    flat = image.reshape(-1, 4)
    counts = np.bincount(flat[:, :3].ravel(), minlength=256)
    lengths = code_lengths(counts)
    header = Fields()
    write_code(header, lengths)
    for _ in range(3):
        out.put(header.value, header.size)
    alpha = np.bincount(flat[:, 3], minlength=256)
    alpha_lengths = code_lengths(alpha)
    write_code(out, alpha_lengths)
    write_code(out, np.zeros(40, dtype=np.int64))
    sizes = np.zeros_like(lengths) if np.count_nonzero(lengths) == 1 else lengths
    codes = reversed_codes(sizes)
    value, size = codes[flat[:, 1]], sizes[flat[:, 1]]
    for channel in (0, 2):
        value = value | codes[flat[:, channel]] << size
        size = size + sizes[flat[:, channel]]
    if np.count_nonzero(alpha_lengths) > 1:
        alpha_codes = reversed_codes(alpha_lengths)
        value = value | alpha_codes[flat[:, 3]] << size
        size = size + alpha_lengths[flat[:, 3]]
    return _joined(out, value, size)


def encode(
    image: np.ndarray,
    predictor: int | None = None,
    cross: tuple[int, int, int] | None = None,
    subtract_green: bool = False,
    palette: bool = False,
    cache_bits: int = 0,
    references: bool = False,
    block: int = 4,
) -> bytes:
    """A lossless WebP file of an image (height by width by 4), by the parts of the format that are asked for."""
    height, width = image.shape[:2]
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("an image has sides of 1 to 16384")
    out = Fields()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((image[..., 3] != 255).any()), 1)
    out.put(0, 3)
    side = (1 << block) - 1
    shape = lambda: ((height + side) >> block, (image.shape[1] + side) >> block, 4)
    if palette:
        colours, index = np.unique(_packed(image).ravel(), return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has 256 colours at most")
        table = _unpacked(colours)
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(table) - 1, 8)
        steps = np.diff(table.astype(np.int64), axis=0, prepend=np.zeros((1, 4), np.int64)).astype(np.uint8)
        _write_tokens(out, steps[None], False, 0, False)
        packing = _bundle_bits(len(table))
        per, depth = 1 << packing, 8 >> packing
        rows = np.zeros((height, -(-width // per) * per), dtype=np.int64)
        rows[:, :width] = index.reshape(height, width)
        green = (rows.reshape(height, -1, per) << (np.arange(per) * depth)).sum(axis=2)
        image = np.zeros((*green.shape, 4), dtype=np.uint8)
        image[..., 1], image[..., 3] = green, 255
    if predictor is not None:
        modes = np.zeros(shape(), dtype=np.uint8)
        modes[..., 1], modes[..., 3] = predictor, 255
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(block - 2, 3)
        _write_tokens(out, modes, False, 0, True)
        image = _predicted(image, modes[..., 1], block, False)
    if cross is not None:
        factors = np.zeros(shape(), dtype=np.uint8)
        factors[..., :3], factors[..., 3] = np.array(cross) & 255, 255
        out.put(1, 1)
        out.put(CROSS_COLOUR, 2)
        out.put(block - 2, 3)
        _write_tokens(out, factors, False, 0, True)
        image = _cross(image, factors, block, False)
    if subtract_green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        image = image.copy()
        image[..., 0] -= image[..., 1]
        image[..., 2] -= image[..., 1]
    out.put(0, 1)
    if cache_bits or references:
        _write_tokens(out, image, True, cache_bits, references)
        data = out.value.to_bytes((out.size + 7) // 8, "little")
    else:
        data = _write_literals(out, image)
    return _file(data)


def _file(data: bytes) -> bytes:
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


#: Transforms whose bits are compared for each image with those of its pixels as they are.
TRANSFORMS = (
    {"subtract_green": True}, {"cross": (0, 16, 16)}, {"predictor": 1}, {"predictor": 2}, {"predictor": 12},
)
CACHE_BITS = 6
#: Pixels of the shortest back-reference, of the longest, and the farthest one.
SHORTEST, LONGEST, FARTHEST = 3, 4096, (1 << 20) - 120
_NEAR_RANK = {xy: k + 1 for k, xy in reversed(list(enumerate(NEAR)))}
#: n times log2 of n, for the counts that texts have.
_N_LOG = np.arange(4096) * np.log2(np.maximum(np.arange(4096), 1))


def _code_bits(counts: np.ndarray) -> np.ndarray:
    """Bits of a prefix code and of what it writes, estimated for each row of counts."""
    total = counts.sum(axis=1)
    logs = _N_LOG[counts].sum(axis=1) if total.max(initial=0) < len(_N_LOG) else (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)
    return total * np.log2(np.maximum(total, 1)) - logs + 4 * np.count_nonzero(counts, axis=1)


def _residues(kind: dict, red: np.ndarray, green: np.ndarray, blue: np.ndarray, place: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """Channels after a transform, for images laid end to end; the left edge counts as inside an image."""
    if "subtract_green" in kind:
        return [red - green, green, blue - green]
    if "cross" in kind:
        part = [((factor * green.view(np.int8).astype(np.int16)) >> 5).astype(np.uint8) for factor in kind["cross"][1:]]
        return [red - part[1], green, blue - part[0]]
    here = np.arange(len(green))
    begin = here - place  # nothing depends on the images before
    left = np.maximum(here - 1, begin)
    top = np.where(place < width, left, here - width)
    out = []
    for channel in (red, green, blue):
        if kind["predictor"] == 12:
            wide = channel.astype(np.int16)
            guess = np.clip(wide[left] + wide[top] - wide[np.maximum(top - 1, begin)], 0, 255).astype(np.uint8)
        else:
            guess = channel[left if kind["predictor"] == 1 else top]
        out.append(channel - guess)
    return out


def _previous(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key (of 64 - bits bits) stood before, and where last; bits hold a place."""
    shift = np.uint64(bits)
    ranked = np.sort(keys << shift | np.arange(len(keys), dtype=np.uint64))
    key = ranked >> shift
    place = (ranked & np.uint64((1 << bits) - 1)).astype(np.int64)
    same = np.flatnonzero(key[1:] == key[:-1])
    return place[same + 1], place[same]


def _references(argb: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references by a greedy walk to the last place of the same three pixels: places, distances, lengths."""
    n = len(argb)
    if n < SHORTEST:
        return (np.zeros(0, dtype=np.int64),) * 3
    # 40 bits of hash at any number of pixels below 2^24, and no image's number in them: what is found depends on the image alone.
    bits = max(24, n.bit_length())
    wide = argb.astype(np.uint64)
    key = wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (key ^ key >> np.uint64(29) ^ wide[2:] * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    at, back = _previous(key >> np.uint64(bits), bits)
    good = (owner[back] == owner[np.minimum(at + 2, n - 1)]) & (at - back <= FARTHEST)
    for k in range(SHORTEST):
        good &= argb[at + k] == argb[back + k]
    at, back = at[good], back[good]
    order = np.argsort(at)
    at, back = at[order], back[order]
    last = ends[owner[at]]
    length = np.full(len(at), SHORTEST)
    open_ = np.arange(len(at))
    for k in range(SHORTEST, 32):
        open_ = open_[at[open_] + k < last[open_]]
        open_ = open_[argb[at[open_] + k] == argb[back[open_] + k]]
        if not len(open_):
            break
        length[open_] += 1
    chosen, lengths, free = [], [], 0
    for k, (i, size) in enumerate(zip(at.tolist(), length.tolist())):
        if i < free:
            continue
        if size == 32:
            j, most = int(back[k]), min(LONGEST, int(last[k]) - i)
            differ = argb[i : i + most] != argb[j : j + most]
            size = int(differ.argmax()) if differ.any() else most
        chosen.append(k)
        lengths.append(size)
        free = i + size
    return at[chosen], at[chosen] - back[chosen], np.array(lengths, dtype=np.int64)


def _value_symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra values and extra bits of lengths or distances."""
    less = values - 1
    top = np.maximum(np.frexp(np.maximum(less, 1).astype(np.float64))[1] - 1, 1)
    extra = np.where(values <= 4, 0, top - 1)
    symbol = np.where(values <= 4, less, 2 * top + (less >> (top - 1) & 1))
    return symbol, less & ((1 << extra) - 1), extra


def encode_opaque(images: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of opaque images, worked on together.

    Each image's pixels become back-references, places in a colour cache, and literals, with the cache where it
    saves bits. Each of TRANSFORMS is measured on each image and taken where the file gets smaller.
    """
    sides = [image.shape[:2] for image in images]
    sizes = np.array([h * w for h, w in sides])
    ends = np.cumsum(sizes)
    count, n = len(images), int(ends[-1])
    owner = np.repeat(np.arange(count), sizes)
    flat = np.concatenate([image.reshape(-1, 4) for image in images])
    red, green, blue = (np.ascontiguousarray(flat[:, k]) for k in range(3))
    argb = _packed(flat)
    low = owner * 256

    def histogram(values, rows, size):
        return np.bincount(rows * size + values, minlength=count * size).reshape(count, size)

    def literal_bits(r, g, b):
        others = np.bincount(np.concatenate((low + r, low + b)), minlength=count * 256).reshape(count, 256)
        return _code_bits(np.bincount(low + g, minlength=count * 256).reshape(count, 256)) + _code_bits(others)

    plain = literal_bits(red, green, blue)
    place, width = np.arange(n) - (ends - sizes)[owner], np.repeat([w for _, w in sides], sizes)
    changed = np.stack([literal_bits(*_residues(kind, red, green, blue, place, width)) for kind in TRANSFORMS])

    start, distance, length = _references(argb, owner, ends)
    kept = np.ones(n, dtype=bool)
    steps = np.zeros(n + 1, dtype=np.int64)
    steps[start] += 1
    steps[start + length] -= 1
    inside = np.cumsum(steps[:-1]) > 0
    kept[inside] = False
    kept[start] = True
    is_reference = np.zeros(n, dtype=bool)
    is_reference[start] = True
    literal = kept & ~is_reference
    # A pixel is in the cache if the last pixel of its cache place is the same.
    cell = (argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)
    at, back = _previous((owner.astype(np.uint64) << np.uint64(CACHE_BITS)) | cell, n.bit_length())
    hit = np.zeros(n, dtype=bool)
    hit[at] = argb[at] == argb[back]
    hit &= literal

    length_symbol, length_extra, length_bits = _value_symbols(length)
    x, y = np.zeros_like(distance), np.zeros_like(distance)
    near = np.zeros_like(distance)
    close = np.flatnonzero(distance <= 7 * width[start] + 8)
    wide = width[start[close]]
    y[close] = (distance[close] + 8) // wide
    x[close] = distance[close] - y[close] * wide
    near[close] = [_NEAR_RANK.get(xy, 0) for xy in zip(x[close].tolist(), y[close].tolist())]
    far_symbol, far_extra, far_bits = _value_symbols(np.where(near > 0, near, distance + 120))

    alphabet = ALPHABETS[0] + (1 << CACHE_BITS)
    shown = np.flatnonzero(literal)
    heads = histogram(256 + length_symbol, owner[start], alphabet)
    without = heads + histogram(green[shown].astype(np.int64), owner[shown], alphabet)
    others = histogram(red[shown].astype(np.int64), owner[shown], 256) + histogram(blue[shown].astype(np.int64), owner[shown], 256)
    hits, rest = np.flatnonzero(hit), np.flatnonzero(literal & ~hit)
    cached = heads + histogram(green[rest].astype(np.int64), owner[rest], alphabet) + histogram(280 + cell[hits].astype(np.int64), owner[hits], alphabet)
    less = histogram(red[rest].astype(np.int64), owner[rest], 256) + histogram(blue[rest].astype(np.int64), owner[rest], 256)
    far = histogram(far_symbol, owner[start], ALPHABETS[4])
    bits_without, bits_cached = _code_bits(without) + _code_bits(others), _code_bits(cached) + _code_bits(less)
    use_cache = bits_cached < bits_without
    hit &= use_cache[owner]

    opaque = np.zeros(256, dtype=np.int64)
    opaque[255] = 1
    tables = [np.where(use_cache[:, None], cached, without), np.where(use_cache[:, None], less, others), far]
    lengths = [_many_code_lengths(table) for table in tables]
    headers: list[list] = []
    for made in lengths:
        headers.append([_header_tokens(row) if np.count_nonzero(row) > 1 else None for row in made])
    listed = [tokens for some in headers for tokens in some if tokens]
    of_lengths = _many_code_lengths(np.array([_header_counts(tokens) for tokens in listed]).reshape(-1, 19), 7)
    parts = iter(zip(of_lengths.tolist(), _many_reversed_codes(of_lengths).tolist()))
    fields: list[list[Fields]] = []
    for made, some in zip(lengths, headers):
        fields.append([])
        for row, tokens in zip(made, some):
            header = Fields()
            if tokens:
                _put_header(header, tokens, *next(parts))
            else:
                write_code(header, row)
                row[:] = 0  # a code of one symbol takes no bits
            fields[-1].append(header)
    codes = [_many_reversed_codes(made) for made in lengths]
    outs = []
    for k, (height, across) in enumerate(sides):
        out = Fields()
        out.put(0x2F | (across - 1) << 8 | (height - 1) << 22, 40)  # opaque, version 0
        out.put(0, 1)  # no transform
        out.put(1 | CACHE_BITS << 1 if use_cache[k] else 0, 5 if use_cache[k] else 1)
        out.put(0, 1)  # one group
        for c in (0, 1, 1):
            out.put(fields[c][k].value, fields[c][k].size)
        write_code(out, opaque)
        out.put(fields[2][k].value, fields[2][k].size)
        outs.append(out)

    # Fields of all tokens, in order.
    tokens = np.flatnonzero(kept)
    who = owner[tokens]
    symbol = green[tokens].astype(np.int64)
    hit_here, head_here = hit[tokens], is_reference[tokens]
    symbol[hit_here] = 280 + cell[tokens[hit_here]].astype(np.int64)
    symbol[head_here] = 256 + length_symbol
    value, size = codes[0][who, symbol], lengths[0][who, symbol]
    some = np.flatnonzero(~hit_here & ~head_here)
    mine = who[some]
    for channel in (red, blue):
        s = channel[tokens[some]]
        value[some] |= codes[1][mine, s] << size[some]
        size[some] += lengths[1][mine, s]
    some = np.flatnonzero(head_here)
    mine = who[some]
    for v, bits in ((length_extra, length_bits), (codes[2][mine, far_symbol], lengths[2][mine, far_symbol]), (far_extra, far_bits)):
        value[some] |= v << size[some]
        size[some] += bits
    cuts = np.searchsorted(who, np.arange(count + 1))
    files = [_file(_joined(out, value[a:b], size[a:b])) for out, a, b in zip(outs, cuts[:-1], cuts[1:])]
    # What a transform leaves is worth writing where its literals alone are fewer bits than the file has.
    best = changed.argmin(axis=0)
    for k in np.flatnonzero((changed.min(axis=0) < plain) & (changed.min(axis=0) < [8 * len(f) for f in files])).tolist():
        other = encode(images[k], **TRANSFORMS[best[k]], cache_bits=CACHE_BITS, references=True)
        files[k] = min(files[k], other, key=len)
    return files
