"""Baseline JPEG as a column: a writer that keeps a payload exactly, and a reader for any baseline file.

The writer puts payload bytes into quantised coefficients: byte b becomes the coefficient of category
eight whose value bits are b. A minimum coded unit of three 8x8 blocks (4:4:4) holds 192 bytes, and a
restart marker follows each, so that DC prediction starts anew. The reader makes no use of that: it
parses markers, and decodes the Huffman codes of all restart intervals of a chunk side by side in numpy.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
_WIDE = 8000  # units a row at most: a JPEG side is below 65,536 pixels
_CHUNK = 2048  # restart intervals that are decoded side by side


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(units: int) -> bytes:
    w = min(_WIDE, int(np.ceil(np.sqrt(units))))
    h = -(-units // w)
    if h > _WIDE:
        raise ValueError("payload over the largest JPEG")
    huffman = bytes([1, *[0] * 15, 8])  # one code of one bit: no run, category eight
    return b"\xff\xd8" + _segment(0xFE, b"units=%d" % units) + _segment(0xDB, bytes([0, *[1] * 64])) + _segment(0xC0, bytes([8, *(8 * h).to_bytes(2, "big"), *(8 * w).to_bytes(2, "big"), 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])) + _segment(0xC4, b"\x00" + huffman + b"\x10" + huffman) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def encode(payload: bytes) -> bytes:
    """A baseline JPEG that holds payload, whose length is a positive multiple of 192."""
    units = len(payload) // UNIT
    w = min(_WIDE, int(np.ceil(np.sqrt(units))))
    total = -(-units // w) * w
    out = [_head(units)]
    for at in range(0, total, _CHUNK):
        n = min(_CHUNK, total - at)
        values = np.zeros((n, UNIT), np.uint8)
        part = np.frombuffer(payload, np.uint8, max(0, min(n * UNIT, len(payload) - at * UNIT)), min(at * UNIT, len(payload)))
        values.reshape(-1)[: len(part)] = part
        bits = np.zeros((n, UNIT, 9), np.uint8)  # the code 0, then eight value bits
        bits[:, :, 1:] = np.unpackbits(values[:, :, None], axis=2)
        coded = np.packbits(bits.reshape(n, -1), axis=1)
        ff = coded == 0xFF
        size = coded.shape[1] + ff.sum(1)
        start = np.cumsum(size + 2) - size - 2
        buf = np.zeros(int((size + 2).sum()), np.uint8)  # a stuffed zero follows each FF
        buf[start[:, None] + np.arange(coded.shape[1]) + np.cumsum(ff, axis=1) - ff] = coded
        buf[start + size] = 0xFF
        buf[start + size + 1] = 0xD0 + (at + np.arange(n)) % 8
        out.append((buf[:-2] if at + n == total else buf).tobytes())
    return b"".join(out) + b"\xff\xd9"


def _table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: symbol * 32 + length of the code that they begin with; 0 if none."""
    lut, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            lut[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k] * 32 + length
            code, k = code + 1, k + 1
        code <<= 1
    return lut


def parse(data: bytes) -> dict:
    """Markers of a baseline file up to its scan: sides, components, tables, restart interval, comment, where the scan starts."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out: dict = {"dqt": {}, "dht": {}, "dri": 0, "comment": b""}
    at = 2
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["dqt"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["dht"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            out["dri"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            chosen = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            return out | {"coders": [(chosen[c] >> 4, chosen[c] & 15) for c, *_ in out["parts"]], "scan": at}


def _intervals(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scan without stuffing, and where each restart interval starts and ends in it."""
    b = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(b[:-1] == 0xFF)
    after = b[ff + 1]
    end = int(ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))][0])
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after != 0]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep)
    cuts = place[marks]
    return b[:end][keep], np.r_[0, cuts], np.r_[cuts, place[-1] if end else 0]


def _layout(data: bytes) -> dict:
    """The head of a file, with the component of each block of a unit and the number of units by row and column."""
    head = parse(data)
    parts = head["parts"]
    alone = len(parts) == 1
    h, v = (1, 1) if alone else (max(p[1] for p in parts), max(p[2] for p in parts))
    blocks = [0] if alone else [c for c, p in enumerate(parts) for _ in range(p[1] * p[2])]
    return head | {"blocks": blocks, "across": -(-head["width"] // (8 * h)), "down": -(-head["height"] // (8 * v))}


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray, dict]]:
    """Of each file: the payload if encode() wrote it (else b''), its DC-only luminance thumbnail, its head.

    The restart intervals of all files with the same tables are decoded together.
    """
    heads = [_layout(x) for x in files]
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(heads):
        groups.setdefault((tuple(sorted(x["dht"].items())), tuple(x["coders"]), tuple(x["blocks"])), []).append(i)
    out: list = [None] * len(files)
    for (dht, coders, blocks), members in groups.items():
        tables = {k: _table(*v) for k, v in dht}
        dc = np.stack([tables[coders[c][0]] for c in blocks]).ravel()
        ac = np.stack([tables[16 + coders[c][1]] for c in blocks]).ravel()
        raws, los, his, sizes, base = [], [], [], [], 0
        for i in members:
            raw, lo, hi = _intervals(files[i], heads[i]["scan"])
            units = heads[i]["across"] * heads[i]["down"]
            each = heads[i]["dri"] or units
            raws.append(raw)
            los.append(lo + base)
            his.append(hi + base)
            sizes.append(np.minimum(each, units - each * np.arange(len(lo))))
            base += len(raw)
        raw, lo, hi, n = map(np.concatenate, (raws, los, his, sizes))
        payload, dcs = [], []
        for at in range(0, len(lo), _CHUNK):
            s = slice(at, at + _CHUNK)
            c = (_decode if len(lo[s]) > FEW else _decode_few)(raw[lo[s][0] : hi[s][-1]], (lo[s] - lo[at]) * 8, n[s], list(blocks), dc, ac)
            payload.append(np.where(c < 0, c + 255, c).astype(np.uint8).reshape(len(c), -1))
            dcs.append(c[:, : blocks.count(0), 0])
        payload, dcs = np.concatenate(payload), np.concatenate(dcs)
        end = 0
        for i in members:
            head, start = heads[i], end
            end += head["across"] * head["down"]
            h, v = (1, 1) if len(head["parts"]) == 1 else head["parts"][0][1:3]
            q = int(head["dqt"][head["parts"][0][3]][0])
            y = dcs[start:end].reshape(head["down"], head["across"], v, h).transpose(0, 2, 1, 3).reshape(head["down"] * v, -1)
            thumb = np.clip(np.rint(y.astype(np.float64) * q / 8 + 128), 0, 255).astype(np.uint8)
            own = head["comment"].startswith(b"units=")
            out[i] = (payload[start : start + int(head["comment"][6:])].tobytes() if own else b"", thumb, head)
    return out


FEW = 24  # intervals up to which plain integers are faster than arrays


def _decode_few(raw: np.ndarray, pos: np.ndarray, n: np.ndarray, blocks: list[int], dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """As _decode, one interval after the other: a scan without restart markers is one long interval."""
    k = len(blocks)
    out = np.zeros((int(n.sum()), k, 64), np.int16)
    flat, data = out.reshape(-1), raw.tobytes() + b"\xff" * 8
    dcs, acs = dc.reshape(k, -1), ac.reshape(k, -1)
    at, put, value = 0, [], []
    for bit, units in zip(pos.tolist(), n.tolist()):
        pred = [0] * (max(blocks) + 1)
        for b in range(units * k):
            which, c = b % k, 0
            while c < 64:
                w = int.from_bytes(data[bit >> 3 : (bit >> 3) + 6], "big") << (bit & 7) & 0xFFFFFFFFFFFF
                hit = int((acs if c else dcs)[which, w >> 32])
                if not hit or bit >> 3 > len(raw):
                    raise ValueError("a code that no table has")
                length, run, size = hit & 31, hit >> 9, hit >> 5 & 15
                x = w << length & 0xFFFFFFFFFFFF
                x >>= 48 - size
                bit += length + size
                if size and x < 1 << (size - 1):
                    x -= (1 << size) - 1
                if not c:
                    pred[blocks[which]] = x = pred[blocks[which]] + x
                    run = 0
                elif not size:
                    c = c + 16 if run == 15 else 64
                    continue
                if c + run > 63:
                    raise ValueError("a block of over 64 coefficients")
                put.append(at + c + run)
                value.append(x)
                c += run + 1
            at += 64
            if len(put) > 1 << 16:
                flat[put] = value
                put, value = [], []
    flat[put] = value
    return out


def _decode(raw: np.ndarray, pos: np.ndarray, n: np.ndarray, blocks: list[int], dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Decode intervals that start at bits pos and hold n units each, a symbol of every interval at a time."""
    padded_raw = np.r_[raw, np.full(8, 0xFF, np.uint8)].astype(np.uint64)
    window = np.zeros(len(raw) + 1, np.uint64)  # the 64 bits from each byte on
    for i in range(8):
        window |= padded_raw[i : i + len(window)] << np.uint64(56 - 8 * i)
    k = len(blocks)
    out = np.zeros((int(n.sum()), k, 64), np.int16)
    flat = out.reshape(-1)
    base = (np.cumsum(n) - n) * k
    block, coef, last = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), n * k
    part_of = np.array(blocks)
    pred = np.zeros((len(pos), max(blocks) + 1), np.int64)
    live = np.arange(len(pos))
    while len(live):
        p, c, b = pos[live], coef[live], block[live]
        w = window[p >> 3] << (p & 7).astype(np.uint64)
        which = (b % k) * 65536 + (w >> np.uint64(48)).astype(np.int64)
        hit = np.where(c == 0, dc[which], ac[which])
        if (hit == 0).any():
            raise ValueError("a code that no table has")
        length, symbol = hit & 31, hit >> 5
        run, size = symbol >> 4, symbol & 15
        bits = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
        value = np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)
        pos[live] = p + length + size
        at_dc = c == 0
        if at_dc.any():
            rows, part = live[at_dc], part_of[b[at_dc] % k]
            pred[rows, part] += value[at_dc]
            value[at_dc] = pred[rows, part]
        over = ~at_dc & (size == 0)  # an end of block, or sixteen zeros
        put = np.where(at_dc, 0, c + run)
        if (put > 63).any() and ((put > 63) & ~over).any():
            raise ValueError("a block of over 64 coefficients")
        some = ~over
        flat[(base[live[some]] + b[some]) * 64 + put[some]] = value[some]
        nxt = np.where(over, np.where(run == 15, c + 16, 64), put + 1)
        done = nxt > 63
        coef[live] = np.where(done, 0, nxt)
        block[live] = b + done
        if done.any():
            live = live[block[live] < last[live]]
    return out


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 reduction exceed their mean."""
    rows = np.arange(9) * thumb.shape[0] / 8
    cols = np.arange(9) * thumb.shape[1] / 8
    total = np.pad(thumb.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r0, r1 = np.floor(rows[:-1]).astype(int), np.maximum(np.floor(rows[:-1]).astype(int) + 1, np.ceil(rows[1:]).astype(int))
    c0, c1 = np.floor(cols[:-1]).astype(int), np.maximum(np.floor(cols[:-1]).astype(int) + 1, np.ceil(cols[1:]).astype(int))
    cell = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    return int(np.packbits((cell > cell.mean()).ravel()).view(">u8")[0])


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as the bytes of a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_ROW = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_crc32 long, feature string, fault string"


def _decode_each(files: list[bytes | None]) -> list:
    """decode() of each file, or why there is none."""
    known = [f for f in files if f]
    try:
        done = iter(decode(known))
    except (ValueError, IndexError, KeyError, TypeError, OverflowError):
        if len(known) == 1:
            done = iter(["damaged"])
        else:  # only the damaged ones are lost
            done = iter([_decode_each([f])[0] for f in known])
    return [next(done) if f else "missing" if f is None else "empty" for f in files]


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: payload digests, sides, thumbnail hashes. Other columns pass, but
    for those named like a result.

    A null, empty or damaged file, or one that is no baseline JPEG, has nulls and says so in fault. A file that
    encode() did not write has an empty payload. Repeated rows keep a row each.
    """
    names = [x.split()[0] for x in _ROW.split(", ")]
    other = [f for f in media.schema if f.name != "media" and f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            out = []
            files = batch.column(0).to_pylist()
            for data, got in zip(files, _decode_each(files)):
                if isinstance(got, str):
                    out.append((None,) * 9 + (got,))
                    continue
                payload, thumb, head = got
                w, h = head["width"], head["height"]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), w, h, zlib.crc32(thumb.tobytes()), f"{w}x{h}:{average_hash(thumb):016x}", None))
            if out:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, t) for c, t in zip(zip(*out), types))], [*batch.schema.names[1:], *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in other)
    return media.select("media", *(f"`{f.name}`" for f in other)).mapInArrow(run, kept + _ROW)
