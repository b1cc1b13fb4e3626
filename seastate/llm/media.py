"""AVI motion-JPEG media columns: lossless intra frames, RIFF indexes, shots and timed clips.

A text's bytes are stored as 8-bit grey samples of 16 x 12 frames. Each frame is a lossless JPEG (T.81 process 14,
predictor 1), so the bytes come back exactly. All frames of a batch are coded and decoded in step, sample by sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pieces, text_batches

WIDTH, HEIGHT, FPS = 16, 12, 24
SAMPLES = WIDTH * HEIGHT
#: Huffman code lengths of the difference categories 0 to 8; the all-ones code stays free, as T.81 asks.
CODE_LENGTHS = [4, 4, 4, 4, 3, 3, 2, 3, 4]
#: Frames that are coded or decoded in step at most, and bytes of texts or media that are taken up at once.
STEP_FRAMES, MEDIA_BYTES = 5_000, 1 << 20


def huffman(lengths: list[int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT counts and values, and category -> (code, bits), by T.81's canonical order."""
    counts, values, codes, code = [0] * 16, [], {}, 0
    for n in range(1, 17):
        for symbol, length in enumerate(lengths):
            if length == n:
                counts[n - 1] += 1
                values.append(symbol)
                codes[symbol] = (code, n)
                code += 1
        code <<= 1
    return bytes(counts) + bytes(values), codes


TABLE, CODES = huffman(CODE_LENGTHS)


def _tables():
    """By difference + 255: the bits and their number; by the next 12 bits: bits taken and difference + 255."""
    word, size, look = np.zeros(511, np.int64), np.zeros(511, np.int64), np.zeros(4096, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = CODES[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        word[d + 255], size[d + 255] = code << cat | extra, n + cat
        low = word[d + 255] << (12 - size[d + 255])
        look[low : low + (1 << (12 - size[d + 255]))] = size[d + 255] << 16 | (d + 255)
    return word, size, look


WORD, SIZE, LOOK = _tables()
HEAD = b"\xff\xd8" + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0) + b"\xff\xc4" + struct.pack(">HB", 3 + len(TABLE), 0) + TABLE + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG images of (n, SAMPLES) uint8."""
    out: list[bytes] = []
    for k in range(0, len(samples), STEP_FRAMES):
        x = samples[k : k + STEP_FRAMES].reshape(-1, HEIGHT, WIDTH).astype(np.int16)
        d = x.copy()
        d[:, :, 1:] -= x[:, :, :-1]
        d[:, 1:, 0] -= x[:, :-1, 0]
        d[:, 0, 0] -= 128
        d = d.reshape(-1, SAMPLES) + 255
        size = SIZE[d]
        end = np.cumsum(size, axis=1)
        length = (end[:, -1] + 7) // 8
        base = np.concatenate([[0], np.cumsum(length)])
        bit = (end - size + base[:-1, None] * 8).ravel()
        word = (WORD[d] << (24 - size)).ravel() >> (bit & 7)  # left-aligned in 24 bits from the byte where it begins
        at, total = bit >> 3, int(base[-1]) + 3
        data = np.zeros(total)
        for shift, plus in ((16, 0), (8, 1), (0, 2)):  # the bits of different samples never overlap: a sum is an or
            data += np.bincount(at + plus, weights=(word >> shift) & 255, minlength=total)[:total]
        data = data.astype(np.uint8)
        pad = length * 8 - end[:, -1]
        data[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)  # T.81 fills up with ones
        data = data.tobytes()
        cuts = base.tolist()
        out += [b"".join((HEAD, data[s:e].replace(b"\xff", b"\xff\x00"), b"\xff\xd9")) for s, e in zip(cuts, cuts[1:])]
    return out


def parse_jpeg(image: bytes) -> tuple[int, int, np.ndarray, int]:
    """Height, width, decoding table and where the scan begins, of a one-component lossless JPEG with predictor 1."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, shape, look = 2, None, None
    while True:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        if marker == 0xC3:
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if (depth, parts) != (8, 1):
                raise ValueError("8-bit images of one component only")
            shape = height, width
        elif marker == 0xC4:
            counts, values = body[1:17], body[17:]
            look, code, k = np.zeros(4096, np.int64), 0, 0
            for n in range(1, 17):
                for _ in range(counts[n - 1]):
                    cat = values[k]
                    for extra in range(1 << cat):
                        d = extra if cat == 0 or extra >> (cat - 1) else extra - (1 << cat) + 1
                        bits = n + cat
                        low = (code << cat | extra) << (12 - bits)
                        look[low : low + (1 << (12 - bits))] = bits << 16 | (d + 255)
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("predictor 1 only")
            return *shape, look, at + 2 + size
        at += 2 + size


def decode_frames(images: list[bytes]) -> np.ndarray:
    """(n, SAMPLES) uint8 of lossless JPEG images that share one header."""
    out = np.zeros((len(images), SAMPLES), np.uint8)
    known: dict[bytes, np.ndarray] = {}
    for k in range(0, len(images), STEP_FRAMES):
        some = images[k : k + STEP_FRAMES]
        scans = []
        for image in some:
            head = image[: len(HEAD)]
            if head not in known:
                height, width, look, at = parse_jpeg(image)
                if (height, width, at) != (HEIGHT, WIDTH, len(HEAD)):
                    raise ValueError("an image of another shape")
                known[head] = look
            scans.append(image[len(HEAD) : -2].replace(b"\xff\x00", b"\xff"))
        if len(known) > 1:
            raise ValueError("images with different tables")
        look = next(iter(known.values()))
        flat = np.frombuffer(b"".join(scans) + b"\0\0\0", np.uint8).astype(np.int32)
        next24 = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        at = np.cumsum([0, *map(len, scans)])[:-1] * 8
        d = np.empty((SAMPLES, len(some)), np.int16)
        for s in range(SAMPLES):
            hit = look[(next24[at >> 3] >> (12 - (at & 7))) & 4095]
            at += hit >> 16
            d[s] = (hit & 0xFFFF) - 255
        x = d.T.reshape(-1, HEIGHT, WIDTH).astype(np.int32)
        x[:, 0, 0] += 128
        x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
        out[k : k + STEP_FRAMES] = np.cumsum(x, axis=2).reshape(-1, SAMPLES)
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(images: list[bytes], n_bytes: int) -> bytes:
    """A RIFF AVI file of the images: hdrl, INFO (the unpadded byte count), movi and idx1."""
    most = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(images), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", str(n_bytes).encode() + b"\0"))
    sizes = np.fromiter(map(len, images), np.int64, len(images))
    index = np.empty((len(images), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(sizes + (sizes & 1) + 8)[:-1]])
    pack = struct.Struct("<4sI").pack
    movi = [b"movi"]
    for image in images:
        movi += (pack(b"00dc", len(image)), image, b"\0") if len(image) & 1 else (pack(b"00dc", len(image)), image)
    return chunk(b"RIFF", b"AVI " + header + info + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", index.tobytes()))


def read_avi(media: bytes) -> tuple[list[bytes], int, float]:
    """The images of an AVI file by its index, the unpadded byte count and frames a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end = 12, 8 + int.from_bytes(media[4:8], "little")
    movi, index, n_bytes, fps = None, None, None, None
    while at < end:
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl":
            fps = 1e6 / int.from_bytes(media[at + 20 : at + 24], "little")
        elif name == b"LIST" and kind == b"INFO":
            n_bytes = int(media[at + 20 : at + 8 + size].split(b"\0")[0])
        elif name == b"idx1":
            index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    own = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
    return [media[s : s + n] for s, n in zip((movi + 8 + own[:, 2].astype(np.int64)).tolist(), own[:, 3].tolist())], n_bytes, fps


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with blanks appended up to a positive multiple of SAMPLES, and their number without."""
    raw = (text or "").encode()
    return raw + b" " * (SAMPLES - len(raw) if len(raw) < SAMPLES else -len(raw) % SAMPLES), len(raw)


def changes(frames: np.ndarray) -> np.ndarray:
    """The L1 distance of each frame's 16-bin histogram to that of the frame before; 0 at first."""
    n = len(frames)
    bins = np.bincount(((frames >> 4) + np.arange(0, 16 * n, 16)[:, None]).ravel(), minlength=16 * n).reshape(n, 16)
    return np.concatenate([[0], np.abs(np.diff(bins, axis=0)).sum(axis=1)]) if n else np.zeros(0, np.int64)


def shots(change: np.ndarray, span: int = 12, factor: float = 2.0, floor: int = 48) -> np.ndarray:
    """First frames of the shots: where the change is over `floor` and over mean + factor x deviation of the `span` changes on either side, itself left out."""
    n = len(change)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    c = change.astype(np.float64)
    one, two = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * c)])
    k = np.arange(n)
    low, high = np.maximum(k - span, 1), np.minimum(k + span + 1, n)
    m = np.maximum(high - low - (k >= low), 1)
    own = np.where(k >= low, c, 0)
    mean = (one[high] - one[low] - own) / m
    deviation = np.sqrt(np.maximum((two[high] - two[low] - own * own) / m - mean * mean, 0))
    return np.concatenate([[0], np.flatnonzero((c > floor) & (c > mean + factor * deviation) & (k > 0))])


CLIPS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64())]))


def timed(cuts: list[int], n: int, fps: float) -> list[dict]:
    """The clips between the first frames of shots, of n frames."""
    return [{"start_s": a / fps, "end_s": b / fps, "frames": b - a} for a, b in zip(cuts, [*cuts[1:], n])]


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text as an AVI file. Null and empty texts make one blank frame; repeated rows and null ids are kept; an empty table gives no rows."""
    text_batches(df.sparkSession, size=MEDIA_BYTES)
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def op(batches):
        for batch in pieces(batches, 1, MEDIA_BYTES):
            made = [payload(t) for t in batch.column(1).to_pylist()]
            images = encode_frames(np.frombuffer(b"".join(p for p, _ in made), np.uint8).reshape(-1, SAMPLES))
            media, at = [], 0
            for p, n in made:
                media.append(write_avi(images[at : at + len(p) // SAMPLES], n))
                at += len(p) // SAMPLES
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    return rows.mapInArrow(op, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, media binary")


def _decoded(media: list[bytes | None]):
    """For each media value (None: no frames): its frames, byte count and frames a second."""
    parsed = [read_avi(m) if m else ([], 0, float(FPS)) for m in media]
    frames, at = decode_frames([image for images, _, _ in parsed for image in images]), 0
    for images, n_bytes, fps in parsed:
        yield frames[at : at + len(images)], n_bytes, fps
        at += len(images)


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips) of each AVI file, decoded.

    feature: "frames=F;mean=M;shots=S;cuts=i,j,..." with the mean sample rounded down and the first frame of each later shot.
    clips: (start_s, end_s, frames) of each shot. Null media gives zero counts, the digests of no bytes and no clips;
    damaged media raises.
    """
    rows = df.select(df[id_col].alias("id"), df[media_col].alias("media"))

    def op(batches):
        for batch in pieces(batches, 1, MEDIA_BYTES):
            media = batch.column(1).to_pylist()
            out = []
            for m, (frames, n_bytes, fps) in zip(media, _decoded(media)):
                raw = frames.tobytes()
                cuts = shots(changes(frames)).tolist()
                mean = int(frames.sum(dtype=np.int64)) // max(1, frames.size)
                feature = f"frames={len(frames)};mean={mean};shots={len(cuts)};cuts={','.join(map(str, cuts[1:]))}"
                m = m or b""
                out.append((n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, timed(cuts, len(frames), fps)))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), CLIPS]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, *names])

    return rows.mapInArrow(op, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s: double, end_s: double, frames: long>>")


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, clip, start_s, end_s, frames): a row for each shot of each AVI file, timed. Null media gives no rows."""
    rows = df.select(df[id_col].alias("id"), df[media_col].alias("media"))

    def op(batches):
        for batch in pieces(batches, 1, MEDIA_BYTES):
            at, clip, start, end, count = [], [], [], [], []
            for i, (frames, _, fps) in enumerate(_decoded(batch.column(1).to_pylist())):
                for k, shot in enumerate(timed(shots(changes(frames)).tolist(), len(frames), fps)):
                    at.append(i), clip.append(k), start.append(shot["start_s"]), end.append(shot["end_s"]), count.append(shot["frames"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(clip, pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(count, pa.int64())], [id_col, "clip", "start_s", "end_s", "frames"])

    return rows.mapInArrow(op, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, clip int, start_s double, end_s double, frames long")
