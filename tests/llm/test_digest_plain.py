"""Digests and their differences against a version that counts one window, bucket and bit at a time."""

import hashlib
import math
import random

import pytest

from ballotlake.llm import digest

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def plain_digest(data: bytes) -> str:
    counts = [0] * 128
    padded = bytes(4) + data  # the first windows reach before the text
    for at in range(4, len(padded)):
        for salt, offsets in enumerate(digest.TRIPLETS):
            a, b, c = (padded[at - o] * k for o, k in zip(offsets, _MULTIPLIERS))
            h = a % 2**32 ^ b % 2**32 ^ (c + salt * 0x27D4EB2F) % 2**32
            counts[(h * 0x165667B1) % 2**32 >> 25] += 1
    in_order = sorted(counts)
    q1, q2, q3 = in_order[31], in_order[63], in_order[95]
    quartile = [(n > q1) + (n > q2) + (n > q3) for n in counts]
    body = bytes(sum(quartile[4 * k + i] << 2 * i for i in range(4)) for k in range(32))
    length = min(255, round(math.log(len(data) + 1) / math.log(1.15)))
    ratios = (q1 * 100 // max(1, q3)) % 16 * 16 + (q2 * 100 // max(1, q3)) % 16
    return bytes([hashlib.blake2b(data, digest_size=1).digest()[0], length, ratios, 0]).hex() + body.hex()


def plain_difference(a: str, b: str) -> int:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    around = lambda p, q: min(8, abs(p - q), 16 - abs(p - q))
    score = (x[0] != y[0]) + 12 * min(12, abs(x[1] - y[1])) + 12 * around(x[2] % 16, y[2] % 16) + 12 * around(x[2] // 16, y[2] // 16)
    for p, q in zip(x[4:], y[4:]):
        for i in range(4):
            d = abs((p >> 2 * i) % 4 - (q >> 2 * i) % 4)
            score += 6 if d == 3 else d
    return score


def texts():
    draw = random.Random(7)
    words = ["alpha", "beta", "gamma", "délta", "漢字", "x", "."]
    return [b"", b"a", b"ab", bytes(9), bytes(range(256)), *(" ".join(draw.choices(words, k=n)).encode() for n in (1, 3, 10, 60, 400, 2000))]


@pytest.mark.parametrize("data", texts())
def test_digest_equals_a_plain_count(data):
    assert digest.digest(data) == plain_digest(data)


def test_digest_of_a_text_longer_than_a_block():
    data = random.Random(1).randbytes((1 << 18) + 777)
    assert digest.digest(data) == plain_digest(data)


def test_difference_equals_a_plain_sum_and_is_bounded():
    digests = [plain_digest(t) for t in texts()]
    for a in digests:
        for b in digests:
            assert digest.difference(a, b) == plain_difference(a, b) <= digest.WORST
            assert digest.likeness(a, b) == 1 - plain_difference(a, b) / digest.WORST
