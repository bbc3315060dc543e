"""Files written here byte by byte, read back by ranges."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.sources import ranges


def packed(data):
    """LZW codes, the highest bit first, one code early."""
    table, codes, word, width = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 9
    n = 258
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        codes.append((table[word], width))
        table[word + bytes([byte])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n > 4093:
            codes.append((256, width))
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([byte])
    if word:
        codes.append((table[word], width))
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def image(path, x, tile, how=1, predictor=1, order="<", large=False, nodata=None, skip=()):
    th, tw = tile or (x.shape[0] // 3 + 1, x.shape[1])
    x = x.astype(x.dtype.newbyteorder(order))
    body, at, sizes = b"", [], []
    head = 16 if large else 8
    for i in range(0, x.shape[0], th):
        for j in range(0, x.shape[1], tw):
            t = x[i : i + th, j : j + tw]
            if tile:
                t = np.pad(t, ((0, th - t.shape[0]), (0, tw - t.shape[1])), mode="edge")
            if predictor == 2:
                t = np.concatenate([t[:, :1], np.diff(t, axis=1).astype(t.dtype)], axis=1)
            data = t.astype(x.dtype).tobytes()
            if predictor == 3:
                planes = np.ascontiguousarray(t.astype(x.dtype.newbyteorder(">"))).view(np.uint8).reshape(*t.shape, -1).transpose(0, 2, 1).reshape(t.shape[0], -1)
                data = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
            data = b"" if len(at) in skip else packed(data) if how == 5 else zlib.compress(data) if how == 8 else data
            at.append(head + len(body))
            sizes.append(len(data))
            body += data
    kind = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    tags = [(256, 4, [x.shape[1]]), (257, 4, [x.shape[0]]), (258, 3, [x.dtype.itemsize * 8]), (259, 3, [how]), (317, 3, [predictor]), (339, 3, [kind])]
    tags += [(322, 4, [tw]), (323, 4, [th]), (324, 4, at), (325, 4, sizes)] if tile else [(278, 4, [th]), (273, 4, at), (279, 4, sizes)]
    if nodata is not None:
        tags.append((42113, 2, str(nodata).encode() + b"\0"))
    entries, extra = b"", b""
    base = head + len(body)
    extra_at = base + (8 + 20 * len(tags) + 8 if large else 2 + 12 * len(tags) + 4)
    for tag, form, v in sorted(tags, key=lambda t: t[0]):
        data = v if form == 2 else struct.pack(f"{order}{len(v)}{'H' if form == 3 else 'I'}", *v)
        room = 8 if large else 4
        entries += struct.pack(f"{order}HH{'Q' if large else 'I'}", tag, form, len(v))
        if len(data) > room:
            entries += struct.pack(f"{order}{'Q' if large else 'I'}", extra_at + len(extra))
            extra += data
        else:
            entries += data.ljust(room, b"\0")
    mark = b"II" if order == "<" else b"MM"
    first = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, base) if large else struct.pack(f"{order}HI", 42, base))
    n = struct.pack(f"{order}{'Q' if large else 'H'}", len(tags))
    path.write_bytes(first + body + n + entries + (b"\0" * (8 if large else 4)) + extra)
    return at, sizes


def cells(df):
    return {(r["r"], r["c"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize(("kind", "tile", "how", "predictor", "order", "large"), [("u1", (16, 16), 8, 2, "<", False), ("i2", (16, 32), 5, 2, ">", False), ("f4", (32, 16), 8, 3, "<", True), ("f8", (16, 16), 1, 1, ">", True), ("i4", None, 5, 1, "<", False), ("f4", (16, 16), 5, 3, ">", False)])
def test_images_of_each_kind(spark, tmp_path, kind, tile, how, predictor, order, large):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 200, (45, 70)).astype(kind) if kind[0] != "f" else (rng.normal(size=(45, 70)) * 100).astype(kind)
    x[3, 4] = 77
    image(tmp_path / "a.tif", x, tile, how, predictor, order, large, nodata=77)
    got = cells(ranges.read_tiles(spark, str(tmp_path / "a.tif")))
    assert got == {(r, c): None if x[r, c] == 77 else float(x[r, c]) for r in range(45) for c in range(70)}


def test_long_codes_round_trip():
    data = np.random.default_rng(2).integers(0, 9, 60_000).astype(np.uint8).tobytes() + bytes(5000)
    assert ranges.unpacked(packed(data)) == data and ranges.unpacked(packed(b"")) == b""


def test_a_window_reads_its_tiles_alone(spark, tmp_path):
    x = np.arange(256 * 320, dtype=np.int32).reshape(256, 320)
    at, sizes = image(tmp_path / "a.tif", x, (32, 32), 8)
    options = {"path": str(tmp_path), "least_r": "40", "most_r": "50", "least_c": "100", "most_c": "130"}
    wanted = [t for p in ranges.TileReader(options).partitions() for t in p.value[1]]
    assert sorted(t[2] for t in wanted) == [at[13], at[14]] and sum(t[3] for t in wanted) < 0.04 * sum(sizes)
    data = bytearray((tmp_path / "a.tif").read_bytes())
    for k in range(len(at)):
        if k not in (13, 14):
            data[at[k] : at[k] + sizes[k]] = b"x" * sizes[k]  # no other tile can be read
    (tmp_path / "a.tif").write_bytes(data)
    got = cells(ranges.read_tiles(spark, str(tmp_path / "a.tif"), (40, 100, 11, 31)))
    assert got == {(r, c): float(x[r, c]) for r in range(40, 51) for c in range(100, 131)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = ranges.read_tiles(spark, str(tmp_path)).where("r >= 40 AND r <= 50 AND c > 99 AND c = 120")
        assert cells(pushed) == {(r, 120): float(x[r, 120]) for r in range(40, 51)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert ranges.read_tiles(spark, str(tmp_path), (900, 0, 5, 5)).count() == 0
    image(tmp_path / "a.tif", x, (32, 32), 8, skip=(0,))
    assert ranges.read_tiles(spark, str(tmp_path)).count() == x.size - 32 * 32


def series(path, variables, records, version=1):
    """A classic series: {name: (array by record, row and column, fill or None)}, and a variable without records."""
    text = lambda s: struct.pack(">I", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    height, width = next(iter(variables.values()))[0].shape[1:]
    codes = {">f4": 5, ">f8": 6, ">i2": 3, ">i4": 4}
    size = {n: height * width * x.dtype.itemsize for n, (x, _) in variables.items()}
    padded = {n: -(-s // 4) * 4 for n, s in size.items()}

    def made(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">I", records) + struct.pack(">II", 10, 3) + text("time") + struct.pack(">I", 0) + text("lat") + struct.pack(">I", height) + text("lon") + struct.pack(">I", width)
        out += struct.pack(">II", 12, 1) + text("title") + struct.pack(">II", 2, 5) + b"hello\0\0\0" + struct.pack(">II", 11, 1 + len(variables))
        place = lambda n: struct.pack(">I" if version == 1 else ">Q", begins.get(n, 0))
        out += text("lat") + struct.pack(">II", 1, 1) + struct.pack(">II", 0, 0) + struct.pack(">II", 6, 8 * height) + place("lat")
        for n, (x, fill) in variables.items():
            out += text(n) + struct.pack(">IIII", 3, 0, 1, 2)
            out += struct.pack(">II", 0, 0) if fill is None else struct.pack(">II", 12, 1) + text("_FillValue") + struct.pack(">II", codes[x.dtype.str], 1) + np.array([fill], x.dtype).tobytes().ljust(4, b"\0")
            out += struct.pack(">II", codes[x.dtype.str], padded[n]) + place(n)
        return out

    begins = {"lat": len(made({}))}
    at = begins["lat"] + 8 * height
    for n in variables:
        begins[n] = at
        at += padded[n] if len(variables) > 1 else size[n]
    body = np.zeros(height, ">f8").tobytes()
    for t in range(records):
        for n, (x, _) in variables.items():
            body += x[t].tobytes().ljust(padded[n] if len(variables) > 1 else size[n], b"\0")
    path.write_bytes(made(begins) + body)


@pytest.mark.parametrize("version", [1, 2])
def test_a_year_reads_its_record_alone(spark, tmp_path, version):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(5, 7, 9)).astype(">f4"), rng.integers(0, 99, (5, 7, 9)).astype(">i2")
    b[2, 0, 0] = -9
    series(tmp_path / "s.nc", {"primf": (a, None), "urban": (b, -9)}, 5, version)
    want = {(850 + t, n, r, c): None if x[t, r, c] == -9 else float(x[t, r, c]) for t in range(5) for n, x in (("primf", a), ("urban", b)) for r in range(7) for c in range(9)}
    rows = lambda df: {(r["year"], r["variable"], r["r"], r["c"]): r["value"] for r in df.collect()}
    assert rows(ranges.read_records(spark, str(tmp_path), first=850)) == want
    assert rows(ranges.read_records(spark, str(tmp_path), 852, 850)) == {k: v for k, v in want.items() if k[0] == 852}
    assert rows(ranges.read_records(spark, str(tmp_path), 852, 850, flip=True)) == {(y, n, 6 - r, c): v for (y, n, r, c), v in want.items() if y == 852}
    parts = ranges.RecordReader({"path": str(tmp_path), "least_t": "2", "most_t": "2"}).partitions()
    assert len(parts) == 2 and sum(p.value[8] * 9 * np.dtype(p.value[3]).itemsize for p in parts) == 7 * 9 * 6  # one record of each
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert rows(ranges.read_records(spark, str(tmp_path), first=850).where("year = 853 AND variable = 'urban'")) == {k: v for k, v in want.items() if k[:2] == (853, "urban")}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert ranges.read_records(spark, str(tmp_path), 900, 850).count() == 0
    with pytest.raises(ValueError, match="before"):
        ranges.time_index(849, 850)


def test_one_variable_stands_without_padding(spark, tmp_path):
    x = np.arange(3 * 1 * 3, dtype=">i2").reshape(3, 1, 3)
    series(tmp_path / "s.nc", {"only": (x, None)}, 3)
    got = {(r["year"], r["c"]): r["value"] for r in ranges.read_records(spark, str(tmp_path)).collect()}
    assert got == {(t, c): float(x[t, 0, c]) for t in range(3) for c in range(3)}


def test_arrays_by_lines(spark, tmp_path, monkeypatch):
    x = np.arange(35.0).reshape(5, 7)
    x[2, 2] = np.nan
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.asfortranarray(x.astype("f4")))
    np.save(tmp_path / "c.npy", np.array([3, 4], "i2"))
    np.save(tmp_path / "d.npy", np.zeros((0, 4)))
    for name, want in (("a", x), ("b", x), ("c", np.array([[3, 4]])), ("d", np.zeros((0, 4)))):
        got = cells(ranges.read_npy(spark, str(tmp_path / f"{name}.npy")))
        assert got == {(r, c): None if np.isnan(want[r, c]) else float(want[r, c]) for r in range(want.shape[0]) for c in range(want.shape[1])}
    monkeypatch.setattr(ranges, "VALUES", 14)
    parts = ranges.ArrayReader({"path": str(tmp_path / "a.npy")}).partitions()
    assert [p.value[2:4] for p in parts] == [(0, 2), (2, 2), (4, 1)]
    assert ranges.read_npy(spark, str(tmp_path / "none*")).agg(F.count("r").alias("n")).first()["n"] == 0
