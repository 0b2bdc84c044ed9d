"""The lists of rivals, the choosers and the prefix count."""

import random

from ringloom.operators import encoders as e


def test_lists_name_encoders():
    for names in (e.HOPELESS, e.UNION):
        assert len(names) == len(set(names))
        assert all(n in e.VARIANTS or n in e.CHOOSERS for n in names)


def test_choosers():
    rng = random.Random(5)
    flat = bytes(40) + bytes(rng.choices(range(4), k=400))
    mixed = bytes(rng.choices(range(4), k=400))
    for data in (flat, mixed, b"", b"ab", b" " * 18):
        a, b = e.encode(data, "basic"), e.encode(data, "no_dummy")
        uniform = len(data) >= 18 and data[:18] == data[:1] * 18
        smaller = a if e.size_in_bytes(a) < e.size_in_bytes(b) else b
        assert e.encode(data, "uniform_head") == (a if uniform else b)
        assert e.encode(data, "min_bytes_strict") == smaller
        assert e.encode(data, "combo") == (a if uniform else smaller)


def test_common_prefix_against_plain_loop():
    rng = random.Random(6)
    ring = e._Ring(bytes(rng.choices(b"ab", k=18)), e.Variant())
    ring.buf[:] = bytes(rng.choices(b"ab\0", k=len(ring.buf)))
    ring.buf[100:118] = ring.buf[300:318]
    for a, b, start in [(100, 300, 0), (100, 300, 1), *((rng.randrange(4000), rng.randrange(4000), rng.randrange(2)) for _ in range(2000))]:
        n = start
        while n < 18 and ring.buf[a + n] == ring.buf[b + n]:
            n += 1
        assert ring.common(a, b, start) == n
