"""Baseline files of another writer: runs of zeros, ends of blocks, 4:2:0, no restart markers; and files that are none."""

import numpy as np
import pytest

from ballotlake.llm import media

#: Huffman tables (counts by length, symbols) that hold all that is written here.
DC = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
AC = (bytes([0, 1, 1, 2, 4, 6, 8, 8, 8, 6, 0, 0, 0, 0, 0, 0]), bytes([0x00, 0x01, 0xF0, 0x11, *(r << 4 | s for r in (0, 1, 2, 4, 7, 13, 15) for s in range(1, 7) if (r, s) not in ((0, 1), (1, 1)))]))


def codes(table):
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[table[1][k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


DC_CODES, AC_CODES = codes(DC), codes(AC)


def bits(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def coded(block, before):
    size, text = bits(int(block[0]) - before)
    out, run = DC_CODES[size] + text, 0
    last = max(np.flatnonzero(block), default=0)
    for x in block[1 : last + 1]:
        if not x:
            run += 1
            continue
        while run > 15:
            out, run = out + AC_CODES[0xF0], run - 16
        size, text = bits(int(x))
        out, run = out + AC_CODES[run << 4 | size] + text, 0
    return out + (AC_CODES[0x00] if last < 63 else "")


def random_block(rng):
    """A block of which every run and size has a code."""
    block, at = np.zeros(64, int), 0
    block[0] = rng.integers(-200, 200)
    while (at := at + 1 + int(rng.choice([0, 2, 4, 7, 13, 15, 17, 20]))) < 64 and rng.random() < 0.8:
        block[at] = rng.choice([-1, 1]) * rng.integers(2, 30)
    return block


def written(rng, across, down, sampling, restart=0):
    parts = [sampling, (1, 1), (1, 1)]
    dcs, out, stream, before = [], [], "", [0, 0, 0]
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            out.append(stream + "1" * (-len(stream) % 8))
            stream, before = "", [0, 0, 0]
        for c, (h, v) in enumerate(parts):
            for _ in range(h * v):
                block = random_block(rng)
                stream += coded(block, before[c])
                before[c] = int(block[0])
                if c == 0:
                    dcs.append(int(block[0]))
    out.append(stream + "1" * (-len(stream) % 8))
    scan = b""
    for k, s in enumerate(out):
        raw = int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00")
        scan += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + raw
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    (h, v), w8, h8 = sampling, 8 * sampling[0] * across, 8 * sampling[1] * down
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\x00") + seg(0xDB, bytes([0, *[4] * 64]))
    head += seg(0xC0, bytes([8, *h8.to_bytes(2, "big"), *w8.to_bytes(2, "big"), 3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, b"\x00" + DC[0] + DC[1]) + seg(0xC4, b"\x10" + AC[0] + AC[1])
    head += (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    y = np.array(dcs).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return head + scan + b"\xff\xd9", np.clip(np.rint(y * 4 / 8 + 128), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("sampling", [(1, 1), (2, 2), (2, 1)])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_thumbnails_of_other_files(sampling, restart, monkeypatch):
    rng = np.random.default_rng(8)
    data, want = written(rng, 7, 5, sampling, restart)
    for few in (24, 0):  # plain integers and arrays
        monkeypatch.setattr(media, "FEW", few)
        (payload, thumb, head), = media.decode([data])
        assert payload == b"" and (thumb == want).all() and thumb.shape == (head["height"] // 8, head["width"] // 8)


def test_missing_and_damaged_files(spark):
    good, _ = written(np.random.default_rng(9), 3, 3, (2, 2))
    own = media.encode(media.padded(b"some text"))
    files = [None, b"", b"no picture", good, good[: len(good) // 3], own, own[:-40], own[:30], good.replace(b"\xff\xc0", b"\xff\xc2")]
    frame = spark.createDataFrame([(i, f, "x", 5) for i, f in enumerate(files)], "doc_id long, media binary, feature string, Width int")
    got = {r.doc_id: r for r in media.features(frame).collect()}
    faults = {i for i, r in got.items() if r.fault}
    assert len(got) == len(files) and faults >= {0, 1, 2, 4, 7, 8} and not faults & {3, 5}
    assert got[0].fault == "missing" and got[0].feature is None and got[5].payload_bytes == 192 and got[3].payload_bytes == 0
    assert media.features(frame.limit(0)).count() == 0
