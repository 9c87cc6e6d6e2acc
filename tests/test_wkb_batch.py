"""The batch reader against the reader of single values."""

import random
import struct
import time

import numpy as np
import pyarrow as pa

from lakelens.functions import wkb


def header(code, big, z, m, flags):
    if flags:
        code |= (0x80000000 if z else 0) | (0x40000000 if m else 0)
    else:
        code += 1000 * (z + 2 * m)
    return bytes([not big]) + struct.pack(">I" if big else "<I", code)


def coordinates(rng, n, big, size):
    order = ">" if big else "<"
    return struct.pack(f"{order}I", n) + struct.pack(f"{order}{n * size}d", *[rng.random() for _ in range(n * size)])


def value(rng, code, big, z, m, flags):
    size, start = 2 + z + m, header(code, big, z, m, flags)
    n = rng.randrange(5)
    number = struct.pack(">I" if big else "<I", n)
    if code == 1:
        return start + coordinates(rng, 1, big, size)[4:]
    if code == 2:
        return start + coordinates(rng, n, big, size)
    if code == 3:
        return start + number + b"".join(coordinates(rng, rng.randrange(6), big, size) for _ in range(n))
    item = {4: lambda: 1, 5: lambda: 2, 6: lambda: 3, 7: lambda: rng.randrange(1, 7)}[code]
    turned = lambda: big if code == 4 else rng.random() < 0.3
    return start + number + b"".join(value(rng, item(), turned(), z, m, flags) for _ in range(n))


def test_same_as_single_values(monkeypatch):
    rng, values = random.Random(0), []
    for _ in range(3000):
        v = value(rng, rng.randrange(1, 8), *[rng.random() < 0.3 for _ in range(4)])
        damage = rng.random()
        if damage < 0.05:
            v = v[:rng.randrange(len(v) + 1)]
        elif damage < 0.1:
            at = rng.randrange(min(len(v), 12))
            v = v[:at] + bytes([rng.randrange(256)]) + v[at + 1:]
        values.append(None if damage > 0.97 else v)
    together = wkb.decode_batch(pa.array(values, pa.binary())).to_pylist()
    monkeypatch.setattr(wkb, "_plain_runs", lambda data, rows, starts, ends: ([], [], np.zeros(len(rows), bool)))
    assert together == wkb.decode_batch(pa.array(values, pa.binary())).to_pylist()


def test_nested_types_cost_what_polygons_do():
    rng = random.Random(1)
    polygon = header(3, False, False, False, False) + struct.pack("<I", 1) + coordinates(rng, 10, False, 2)
    multi = header(6, False, False, False, False) + struct.pack("<I", 1) + polygon
    took = []
    for v in (polygon, multi):
        batch = pa.array([v] * 50_000, pa.binary())
        start = time.process_time()
        wkb.decode_batch(batch)
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0] + 0.2
