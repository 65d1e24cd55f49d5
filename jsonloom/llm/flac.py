"""Media columns: FLAC streams of 8-bit mono samples, written, read back, checked and cut into seekable PCM blocks.

A payload's bytes, less 128, are the samples. A stream is the FLAC magic, STREAMINFO (with the MD5 of the samples), a
SEEKTABLE with a point for every SEEK_EVERY frames, and frames of 192 samples: a header with CRC-8, one subframe with a fixed
or a least-squares (LPC) predictor and Rice-coded residuals, and CRC-16. The predictor and the Rice parameter of a frame
depend on its samples alone.

Frames are independent, so a task codes all frames of a block of rows side by side in numpy: the loops run over the 192
samples of a frame, never over rows. The decoder finds frames by sync code, header CRC-8 and frame number, then reads unary
quotients and remainders, undoes the predictor, and verifies each frame's CRC-16, the sample count and the MD5; a stream that
fails any of these raises ValueError. It reads streams of this form (mono, 8 bits, 192-sample frames, constant, verbatim,
fixed or LPC subframes, any Rice partition order); another form raises ValueError too.

Defined results: a null media value has no blocks; an empty payload is a stream without frames. Repeated rows are coded each
for itself, and equal payloads have equal streams. A row's stream must fit in one task's memory, about 60 bytes a sample for
the frames coded at once (FRAMES_AT_ONCE).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import blocks, texts

N = 192
RATE = 8000
SEEK_EVERY = 64
FRAMES_AT_ONCE = 6000
#: Fixed values of the format: coefficients of the fixed predictors of order 0 to 4, newest sample first.
FIXED = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)]
LPC_ORDER, LPC_SHIFT, LPC_PRECISION = 8, 9, 12


def _crc_table(width: int, poly: int, size: int) -> np.ndarray:
    """What a register of `width` bits becomes after `size` bits of itself."""
    table = np.arange(1 << size, dtype=np.uint32) << np.uint32(max(width - size, 0))
    for _ in range(size):
        top = (table >> np.uint32(width - 1)) & np.uint32(1)
        table = ((table << np.uint32(1)) & np.uint32((1 << width) - 1)) ^ (top * np.uint32(poly))
    return table


CRC8, CRC16 = _crc_table(8, 0x07, 8), _crc_table(16, 0x8005, 16)


def crc8(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes; leading zeros don't count."""
    out = np.zeros(len(rows), np.uint32)
    for j in range(rows.shape[1]):
        out = CRC8[out ^ rows[:, j]]
    return out


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each piece of data; the pieces are set flush right, two bytes a step, as leading zeros don't count."""
    width = int(length.max(initial=0) + 1) // 2 * 2
    out = np.zeros(len(start), np.uint32)
    first = start + length - width
    for j in range(0, width, 2):
        at = first + j
        high, low = np.where(at >= start, data[np.maximum(at, 0)], 0), np.where(at + 1 >= start, data[np.maximum(at + 1, 0)], 0)
        out = CRC16[out ^ ((high.astype(np.uint32) << np.uint32(8)) | low)]
    return out


def _number_bytes(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: rows of six bytes, flush right, and their lengths."""
    number = number.astype(np.int64)
    size = 1 + sum((number >= limit).astype(np.int64) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(number), 6), np.uint8)
    for j in range(6):  # j: from the last byte
        lead = np.where(size == 1, 0, (0xFF00 >> size) & 0xFF)
        out[:, 5 - j] = np.where(j < size - 1, 0x80 | ((number >> (6 * j)) & 0x3F), np.where(j == size - 1, lead | (number >> (6 * j)), 0))
    return out, size


def _lpc(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame, quantised coefficients from its autocorrelation, newest first, and the residuals that they leave."""
    x = samples - samples.mean(1, keepdims=True, dtype=np.float32)
    r = np.stack([np.einsum("ij,ij->i", x[:, : N - k], x[:, k:]) for k in range(LPC_ORDER + 1)], 1).astype(np.float64)
    lag = np.abs(np.arange(LPC_ORDER)[:, None] - np.arange(LPC_ORDER)[None])
    matrix = r[:, lag] + np.eye(LPC_ORDER) * (1e-3 * r[:, :1, None] + 1.0)
    real = np.linalg.solve(matrix, r[:, 1:, None])[:, :, 0]
    most = (1 << (LPC_PRECISION - 1)) - 1
    coefficients = np.clip(np.rint(real * (1 << LPC_SHIFT)), -most, most).astype(np.int32)
    residual, predicted = samples.copy(), np.zeros((len(samples), N - LPC_ORDER), np.int32)
    for i in range(LPC_ORDER):
        predicted += coefficients[:, i : i + 1] * samples[:, LPC_ORDER - 1 - i : N - 1 - i]
    residual[:, LPC_ORDER:] -= predicted >> LPC_SHIFT
    return coefficients, residual


def _fold(residual: np.ndarray) -> np.ndarray:
    return (residual << 1) ^ (residual >> 31)


def _rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter and its bits, for frames of one order: that of the mean, or one beside it."""
    folded = _fold(residual)[:, order:]
    mean = folded.mean(1)
    best = np.zeros(len(folded), np.int32)
    bits = np.full(len(folded), 1 << 30, np.int64)
    middle = np.clip(np.log2(mean + 1e-3).astype(np.int32), 0, 13)
    for k in (middle, middle + 1, np.maximum(middle - 1, 0)):
        now = (folded >> k[:, None]).sum(1) + (k + 1) * (N - order)
        best, bits = np.where(now < bits, k, best), np.minimum(now, bits)
    return best, bits


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Writes the lowest `width` bits of each value."""
    width = np.broadcast_to(width, at.shape)
    for j in range(int(width.max(initial=0))):
        on = (width > j) & ((value >> j) & 1 == 1)
        bits[at[on] + width[on] - 1 - j] = 1


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of 192 samples each with their numbers: the bytes of all, and each frame's length."""
    n = len(samples)
    samples = samples.astype(np.int32)
    order, k, coefficients = (np.zeros(x, np.int32) for x in (n, n, (n, LPC_ORDER)))
    kind, bits = np.ones(n, np.int64), np.full(n, 8 * N)  # verbatim, unless less will do
    residual = samples.copy()

    def weigh(rows: np.ndarray, now: np.ndarray, p: int, name: int, extra: int) -> None:
        best, size = _rice(now, p)
        better = size + 8 * p + 10 + extra < bits[rows]
        at = rows[better]
        kind[at], order[at], k[at], bits[at], residual[at] = name, p, best[better], size[better] + 8 * p + 10 + extra, now[better]

    for p in range(5):
        now = samples.copy()
        if p:
            now[:, p:] = np.diff(samples, p)
        weigh(np.arange(n), now, p, 2, 0)
    rows = np.flatnonzero(order > 0)  # frames whose samples depend on those before
    if len(rows):
        coefficients[rows], now = _lpc(samples[rows])
        weigh(rows, now, LPC_ORDER, 3, 9 + LPC_PRECISION * LPC_ORDER)
    constant = (samples == samples[:, :1]).all(1)
    kind[constant], order[constant], bits[constant] = 0, 0, 8

    digits, digit_count = _number_bytes(number)
    header = 4 + digit_count + 1
    length = header + 1 + (bits + 7) // 8 + 2
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()) * 8, np.uint8)
    # the header, flush right before its CRC-8: sync, 192 samples at a rate of STREAMINFO, mono of 8 bits, the number
    head = np.zeros((n, 10), np.uint8)
    head[:, 4:] = digits
    for j, byte in enumerate((0xFF, 0xF8, 0x10, 0x02)):
        head[np.arange(n), 6 - digit_count + j] = byte
    check = crc8(head)
    at = start * 8
    for j in range(10):
        on = j >= 6 - digit_count
        _put(out, at[on] + 8 * (j - 6 + digit_count[on]), head[on, j].astype(np.int64), 8)
    _put(out, at + 8 * (header - 1), check.astype(np.int64), 8)
    code = np.choose(kind, [np.zeros(n, np.int64), np.ones(n, np.int64), 8 + order, 32 + order - 1])
    _put(out, at + 8 * header, code << 1, 8)
    at = at + 8 * header + 8
    _put(out, at[kind == 0], samples[kind == 0, 0], 8)
    plain = np.flatnonzero(kind == 1)
    for j in range(N):
        _put(out, at[plain] + 8 * j, samples[plain, j], 8)
    for p in sorted(set(order[kind > 1].tolist())):
        rows = np.flatnonzero((kind > 1) & (order == p))
        for j in range(p):
            _put(out, at[rows] + 8 * j, samples[rows, j], 8)
        cursor = at[rows] + 8 * p
        lpc = kind[rows] == 3
        if lpc.any():
            _put(out, cursor[lpc], np.full(lpc.sum(), LPC_PRECISION - 1), 4)
            _put(out, cursor[lpc] + 4, np.full(lpc.sum(), LPC_SHIFT), 5)
            for j in range(p):
                _put(out, cursor[lpc] + 9 + LPC_PRECISION * j, coefficients[rows[lpc], j], LPC_PRECISION)
            cursor = cursor + np.where(lpc, 9 + LPC_PRECISION * p, 0)
        _put(out, cursor + 6, k[rows], 4)  # before it: coding method 0, partition order 0
        for parameter in sorted(set(k[rows].tolist())):
            some = k[rows] == parameter
            folded = _fold(residual[rows[some]])[:, p:]
            size = (folded >> parameter) + (1 + parameter)
            last = cursor[some][:, None] + 9 + np.cumsum(size, 1)
            out[last - parameter] = 1
            for j in range(parameter):
                out[last - j] = (folded >> j) & 1
    data = np.packbits(out)
    check = crc16(data, start, length - 2)
    data[start + length - 2], data[start + length - 1] = check >> np.uint32(8), check & np.uint32(255)
    return data, length


def streams(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 192 bytes) as a FLAC stream."""
    counts = [len(p) // N for p in payloads]
    if any(len(p) % N for p in payloads):
        raise ValueError(f"a payload is not a multiple of {N} bytes")
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, N)
    number = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    parts, lengths = [], []
    for at in range(0, len(samples), FRAMES_AT_ONCE):
        data, length = encode_frames(samples[at : at + FRAMES_AT_ONCE], number[at : at + FRAMES_AT_ONCE])
        parts.append(data.tobytes())
        lengths.append(length)
    data, length = b"".join(parts), np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    ends = np.cumsum(length)
    out, frame, at = [], 0, 0
    for payload, count in zip(payloads, counts, strict=True):
        own = length[frame : frame + count]
        end = int(ends[frame + count - 1]) if count else at
        small, large = (int(own.min()), int(own.max())) if count else (0, 0)
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest()
        info = N.to_bytes(2) * 2 + small.to_bytes(3) + large.to_bytes(3) + ((RATE << 44) | (7 << 36) | (count * N)).to_bytes(8) + md5
        before = np.cumsum(own) - own
        points = b"".join((i * N).to_bytes(8) + int(before[i]).to_bytes(8) + N.to_bytes(2) for i in range(0, count, SEEK_EVERY))
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3) + info + b"\x83" + len(points).to_bytes(3) + points + data[at:end])
        frame, at = frame + count, end
    return out


# ---- decoder ----


def _bits(windows: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """`width` bits (at most 32) from each bit position."""
    return ((windows[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)


def _signed(value: np.ndarray, width: int) -> np.ndarray:
    return value - ((value >> (width - 1)) << width)


def decode_frames(data: np.ndarray, start: np.ndarray, header: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the frames that start at these bytes, and the byte after each frame's CRC-16, which is verified."""
    padded = np.r_[data, np.zeros(16, np.uint8)].astype(np.uint64)
    windows = np.zeros(len(data) + 9, np.uint64)
    for j in range(8):
        windows |= padded[j : j + len(windows)] << np.uint64(56 - 8 * j)
    n = len(start)
    at = (start + header) * 8
    code = _bits(windows, at, 8) >> 1
    at = at + 8
    order = np.where((code >= 8) & (code <= 12), code - 8, np.where(code >= 32, code - 31, 0))
    if not np.isin(code, [0, 1, *range(8, 13), *range(32, 64)]).all():
        raise ValueError("a reserved subframe type")
    samples = np.zeros((n, N), np.int64)
    constant, plain, coded = np.flatnonzero(code == 0), np.flatnonzero(code == 1), np.flatnonzero(code >= 8)
    samples[constant] = _signed(_bits(windows, at[constant], 8), 8)[:, None]
    at[constant] += 8
    for j in range(N):
        samples[plain, j] = _signed(_bits(windows, at[plain] + 8 * j, 8), 8)
    at[plain] += 8 * N
    for p in sorted(set(order[coded].tolist())):
        rows = coded[order[coded] == p]
        for j in range(p):
            samples[rows, j] = _signed(_bits(windows, at[rows] + 8 * j, 8), 8)
        at[rows] += 8 * p
        shift, taps = np.zeros(len(rows), np.int64), np.tile(FIXED[p] if p < 5 else (0,) * p, (len(rows), 1))
        lpc = np.flatnonzero(code[rows] >= 32)
        if len(lpc):
            width = _bits(windows, at[rows[lpc]], 4) + 1
            shift[lpc] = _bits(windows, at[rows[lpc]] + 4, 5)
            for w in set(width.tolist()):
                some = lpc[width == w]
                for j in range(p):
                    taps[some, j] = _signed(_bits(windows, at[rows[some]] + 9 + w * j, w), w)
            at[rows[lpc]] += 9 + width * p
        at[rows] = _read_rice(windows, at[rows], p, samples, rows)
        # undo the predictor, a sample of all frames at a time
        own = np.ascontiguousarray(samples[rows].T)
        for j in range(p, N):
            own[j] += sum((taps[:, i] * own[j - 1 - i] for i in range(p)), np.int64(0)) >> shift
        samples[rows] = own.T
    end = (at + 7) // 8
    if (end + 2 > len(data)).any():
        raise ValueError("a frame ends early")
    want = (data[end].astype(np.uint32) << np.uint32(8)) | data[end + 1]
    if (crc16(data, start, end - start) != want).any():
        raise ValueError("a frame's CRC-16 is wrong")
    return samples, end + 2


def _read_rice(windows: np.ndarray, at: np.ndarray, order: int, samples: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rice-coded residuals of frames of one order into samples; the bit after each."""
    method, partitions = _bits(windows, at, 2), _bits(windows, at + 2, 4)
    if (method > 1).any() or (N % (1 << partitions) != 0).any() or (order and ((N >> partitions) <= order).any()):
        raise ValueError("a reserved residual coding")
    at, width = at + 6, 4 + method
    each, k, raw = N >> partitions, np.zeros(len(at), np.int64), np.full(len(at), -1)
    own, any_raw, most, borders = np.zeros((N, len(at)), np.int64), False, len(windows) * 8 - 8, set()
    for size in set(each.tolist()):
        borders |= set(range(0, N, size))
    for j in range(order, N):
        if j == order or j in borders:
            new = (j == order) | (j % each == 0)
            k = np.where(new, _bits(windows, at, 5) >> (5 - width), k)
            at = at + np.where(new, width, 0)
            escaped = new & (k == (1 << width) - 1)
            raw = np.where(new, np.where(escaped, _bits(windows, at, 5), -1), raw)
            at = at + np.where(escaped, 5, 0)
            any_raw = bool((raw >= 0).any())
            down = (64 - np.where(raw < 0, k, raw)).astype(np.uint64)
        if int(at.max()) > most:
            raise ValueError("a residual runs past the end")
        word = windows[at >> 3] << (at & 7).astype(np.uint64)
        # leading zeros by a double's exponent; 48 bits of a window are sure, longer runs take more steps
        zeros = 1075 - ((word >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)
        if any_raw:
            zeros[raw >= 0] = 0
        long = np.flatnonzero(zeros >= 48)
        rest = at + zeros + 1
        for i in long.tolist():
            zeros[i] = 0
            while not int(_bits(windows, at[i : i + 1] + zeros[i], 1)[0]):
                zeros[i] += 1
                if at[i] + zeros[i] > most:
                    raise ValueError("a residual runs past the end")
            rest[i] = at[i] + zeros[i] + 1
        if any_raw:
            rest[raw >= 0] = at[raw >= 0]
        # shifts of 64 are not defined, so the last bit goes by itself
        value = ((windows[rest >> 3] << (rest & 7).astype(np.uint64)) >> np.uint64(1)) >> (down - np.uint64(1))
        value = value.astype(np.int64)
        folded = (zeros << k) | value
        own[j] = (folded >> 1) ^ -(folded & 1)
        at = rest + k
        if any_raw:
            plain = raw >= 0
            own[j, plain] = value[plain] - np.where((raw[plain] > 0) & ((value[plain] >> np.maximum(raw[plain] - 1, 0)) & 1 == 1), np.int64(1) << np.maximum(raw[plain], 0), 0)
            at[plain] = rest[plain] + raw[plain]
    samples[rows, order:] = own[order:].T
    return at


def _frame_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where frames may start, and their numbers: the sync code, the fixed fields and CRC-8 are right."""
    at = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8)) if len(data) > 1 else np.zeros(0, np.int64)
    padded = np.r_[data, np.zeros(16, np.uint8)]
    at = at[(padded[at + 2] == 0x10) & (padded[at + 3] == 0x02)]
    lead = padded[at + 4].astype(np.int64)
    size = 1 + sum((lead >= limit).astype(np.int64) for limit in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC))
    number = np.where(size == 1, lead, lead & (0x7F >> size))
    for j in range(1, 6):
        number = np.where(j < size, (number << 6) | (padded[at + 4 + j] & 0x3F), number)
    head = np.zeros((len(at), 10), np.uint8)
    for j in range(10):
        on = j >= 6 - size
        head[on, j] = padded[at[on] + j - 6 + size[on]]
    good = crc8(head) == padded[at + 4 + size]
    return at[good], number[good]


def decoded(media: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Each stream's payload, and the byte at which each of its frames starts."""
    data = np.frombuffer(b"".join(media), np.uint8)
    places, numbers = _frame_starts(data)
    base, starts, headers, counts, firsts = 0, [], [], [], []
    for stream in media:
        if stream[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, info = 4, False, b""
        while not last:
            last, kind, size = stream[at] & 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
            info = stream[at + 4 : at + 4 + size] if kind == 0 else info
            at += 4 + size
        fields = int.from_bytes(info[10:18])
        total, depth, channels = fields & ((1 << 36) - 1), ((fields >> 36) & 31) + 1, ((fields >> 41) & 7) + 1
        if depth != 8 or channels != 1 or total % N or info[:4] != N.to_bytes(2) * 2:
            raise ValueError("not a mono stream of 8 bits and frames of 192 samples")
        low, high = np.searchsorted(places, (base + at, base + len(stream)))
        place, number = places[low:high], numbers[low:high]
        if len(number) != total // N or not np.array_equal(number, np.arange(len(number))):
            place, number = _chained(place, number, total // N)
        starts.append(place)
        headers.append(5 + 1 + sum((number >= limit).astype(np.int64) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26)))
        counts.append(total // N)
        firsts.append(base)
        base += len(stream)
    start, header = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, headers))
    parts = []
    for at in range(0, len(start), FRAMES_AT_ONCE):
        some = start[at : at + FRAMES_AT_ONCE]
        low, high = int(some[0]), int(start[at + FRAMES_AT_ONCE]) if at + FRAMES_AT_ONCE < len(start) else len(data)
        samples, _ = decode_frames(data[low:high], some - low, header[at : at + FRAMES_AT_ONCE])
        parts.append((samples + 128).astype(np.uint8))
    joined = np.concatenate(parts) if parts else np.zeros((0, N), np.uint8)
    out, frame = [], 0
    for stream, count, first, own in zip(media, counts, firsts, starts, strict=True):
        payload = joined[frame : frame + count].tobytes()
        if hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest() != stream[26:42]:
            raise ValueError("the MD5 of the samples is wrong")
        out.append((payload, own - first))
        frame += count
    return out


def _chained(place: np.ndarray, number: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """One candidate for each number where chance made more: the first that follows the frame before."""
    chosen, after = [], -1
    for i in range(total):
        at = place[(number == i) & (place > after)]
        if not len(at):
            raise ValueError("a frame is missing")
        chosen.append(after := int(at[0]))
    return np.array(chosen, np.int64), np.arange(total)


# ---- operators ----


def padded_payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (-len(text) % N if text else N)


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs and a binary column: the FLAC stream of each text, padded with spaces to a positive multiple of 192 bytes. A column
    of docs that has its name gives way to it."""

    def encode(batches: Iterator[pa.RecordBatch]):
        for rows in blocks(batches, text, 2 << 20):
            made = streams([padded_payload(t) for t in texts(rows, text)])
            yield from rows.append_column(media, pa.array(made, pa.binary())).combine_chunks().to_batches()

    docs = docs.drop(media)
    schema = docs.schema
    return docs.mapInArrow(encode, type(schema)([*schema.fields]).add(media, "binary"))


def pcm_blocks(media: DataFrame, key: str, column: str = "media", frames: int = SEEK_EVERY, others: tuple[str, ...] = ()) -> DataFrame:
    """The PCM of each stream in blocks of `frames` frames: key, block, sample_offset, byte_offset (of the block's first frame
    in the stream), n_samples and pcm (unsigned 8-bit), and `others`, columns that go along. A stream's blocks are rows that follow
    each other, from block 0 on; a null stream has none."""
    kind = media.schema[key].dataType.simpleString()
    types = [media.schema[c].dataType.simpleString() for c in others]

    def decode(batches):
        for rows in blocks(batches, column, 2 << 20):
            keys, streams_ = rows.column(key).to_pylist(), rows.column(column).to_pylist()
            keep = [i for i, s in enumerate(streams_) if s is not None]
            out, number = [], []
            for i, (payload, starts) in zip(keep, decoded([streams_[i] for i in keep]), strict=True):
                for b, first in enumerate(range(0, len(starts), frames)):
                    pcm = payload[first * N : (first + frames) * N]
                    out.append((keys[i], b, first * N, int(starts[first]), len(pcm), pcm))
                    number.append(i)
            columns = list(zip(*out, strict=True)) or [()] * 6
            own = [pa.array(c, t) for c, t in zip(columns, (rows.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
            along = [rows.column(f"o{i}").combine_chunks().take(pa.array(number, pa.int64())) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*own, *along], names=["key", "block", "sample_offset", "byte_offset", "n_samples", "pcm", *others])

    chosen = media.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").alias(column), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(others)])
    found = chosen.mapInArrow(decode, ", ".join(["key " + kind, "block int", "sample_offset long", "byte_offset long", "n_samples int", "pcm binary", *[f"`{c}` {t}" for c, t in zip(others, types, strict=True)]]))
    return found.withColumnRenamed("key", key)


def read_back(media: DataFrame, column: str = "media", payload: str = "payload") -> DataFrame:
    """media and a binary column: the decoded payload of each stream, null for null. A column that has its name gives way to it."""

    def decode(batches):
        for rows in blocks(batches, column, 2 << 20):
            streams_ = rows.column(column).to_pylist()
            keep = [i for i, s in enumerate(streams_) if s is not None]
            made: list[bytes | None] = [None] * len(streams_)
            for i, (data, _) in zip(keep, decoded([streams_[i] for i in keep]), strict=True):
                made[i] = data
            yield from rows.append_column(payload, pa.array(made, pa.binary())).combine_chunks().to_batches()

    media = media.drop(payload)
    schema = media.schema
    return media.mapInArrow(decode, type(schema)([*schema.fields]).add(payload, "binary"))


# ---- query ----


def feature(payload: bytes) -> str:
    """Mean level, mean step and zero crossings of a payload's samples, in thousandths."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "0,0,0"
    step = np.abs(np.diff(x)).sum() * 1000 // len(x)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum()) * 1000 // len(x)
    return f"{np.abs(x).sum() * 1000 // len(x)},{step},{crossings}"


def digests(documents: DataFrame) -> DataFrame:
    """Texts are stored as streams, these read back as PCM blocks, and the payload put together by the blocks' sample offsets."""
    stored = with_media(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("n_bytes", F.octet_length("text").cast("long")).drop("text")
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def row(held: tuple, parts: list[bytes]) -> tuple:
        payload = b"".join(parts)
        return *held[:2], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *held[2:], feature(payload)

    def describe(batches):
        held, parts, size = None, [], 0
        for batch in batches:
            made = []
            for pcm, block, offset, *along in zip(*(batch.column(c).to_pylist() for c in ("pcm", "block", "sample_offset", "doc_id", "n_bytes", "media_bytes", "media_sha256")), strict=True):
                if block == 0:
                    if held:
                        made.append(row(held, parts))
                    held, parts, size = tuple(along), [], 0
                if offset != size:
                    raise ValueError("a block of samples is missing")
                parts.append(pcm)
                size += len(pcm)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(held, parts), types, strict=True)], names=names)

    read = pcm_blocks(stored, "doc_id", others=("n_bytes", "media_bytes", "media_sha256"))
    return read.mapInArrow(describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
