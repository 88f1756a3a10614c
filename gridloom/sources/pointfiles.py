"""Point files as tables, and tables as point files: KITTI scans, PLY clouds, uncompressed LAS.

Reading goes through Spark's binaryFile source, so any store that Spark reads will do; each file is decoded
by numpy in one task. Writing encodes each file in one task and returns (path, content) rows, which
`save_files` puts into a folder through Hadoop's file system.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.exprs import world
from gridloom.sources.views import with_position

#: Scalar property types of PLY headers and their numpy codes (fixed values of the format).
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
PLY_ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">"}

_XYZ = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_OLD = [("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
#: LAS scalar types of extra bytes by number (fixed values of the format).
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}


def las_record(fmt: int) -> list[tuple[str, str]]:
    """Fields of a LAS point format before its extra bytes."""
    if not 0 <= fmt <= 10:
        raise ValueError(f"no point format {fmt}")
    out = list(_XYZ) + (_OLD if fmt < 6 else _NEW)
    if fmt in (1, 3, 4, 5):
        out.append(("gps_time", "<f8"))
    if fmt in (2, 3, 5, 7, 8, 10):
        out += _RGB
    if fmt in (8, 10):
        out.append(("nir", "<u2"))
    if fmt in (4, 5, 9, 10):
        out += [(f"wave_packet#{k}", "u1") for k in range(29)]
    return out


def _wide(code: str) -> T.DataType:
    kind, size = code.lstrip("<>=|")[0], int(code[-1])
    if kind == "f":
        return T.FloatType() if size == 4 else T.DoubleType()
    return T.LongType()


def _decoded(raw: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for n in raw.dtype.names:
        v = raw[n]
        out[n] = v.astype(v.dtype.newbyteorder("=")) if v.dtype.kind == "f" else (v.astype(np.uint64).view(np.int64) if v.dtype.kind == "u" and v.dtype.itemsize == 8 else v.astype(np.int64))
    return out


def parse_kitti(content: bytes) -> dict[str, np.ndarray]:
    if len(content) % 16:
        raise ValueError("a KITTI scan has 16 bytes for each point")
    a = np.frombuffer(content, "<f4").reshape(-1, 4)
    return {n: a[:, k].copy() for k, n in enumerate(("X", "Y", "Z", "intensity"))}


def ply_header(content: bytes) -> tuple[str, int, list[tuple[str, str]], int]:
    """Format, vertices, properties and where the data begins. The vertex element comes first; list properties
    of vertices are refused."""
    end = content.find(b"end_header")
    if not content.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    begin = content.index(b"\n", end) + 1
    fmt, count, props, element = "", -1, [], ""
    for line in content[:end].decode("ascii", "replace").splitlines():
        word = line.split()
        if not word or word[0] in ("comment", "obj_info", "ply"):
            continue
        if word[0] == "format":
            fmt = word[1]
        elif word[0] == "element":
            if not element and word[1] != "vertex":
                raise ValueError("the vertex element must come first")
            element = word[1]
            if element == "vertex":
                count = int(word[2])
        elif word[0] == "property" and element == "vertex":
            if word[1] == "list":
                raise ValueError("list properties of vertices aren't supported")
            props.append((word[2], PLY_TYPES[word[1]]))
    if count < 0 or not props:
        raise ValueError("no vertices")
    return fmt, count, props, begin


def parse_ply(content: bytes) -> dict[str, np.ndarray]:
    fmt, count, props, begin = ply_header(content)
    if fmt == "ascii":
        rows = np.array(content[begin:].split()[: count * len(props)], dtype=object).reshape(count, len(props))
        raw = np.empty(count, np.dtype(props))
        for k, (n, code) in enumerate(props):
            raw[n] = [float(x) if "f" in code else int(x) for x in rows[:, k]]
        return _decoded(raw)
    return _decoded(np.frombuffer(content, np.dtype([(n, PLY_ORDERS[fmt] + c) for n, c in props]), count, begin))


def las_header(content: bytes) -> dict:
    """Version, format, sizes, scale, offset, declared count and extra-byte fields."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = content[24], content[25]
    if major != 1 or minor > 4:
        raise ValueError(f"LAS {major}.{minor} isn't supported")
    size, begin, vlrs, fmt, length, count = struct.unpack_from("<HIIBHI", content, 94)
    if fmt & 0xC0:
        raise ValueError("compressed points aren't supported")
    scale, offset = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    if minor == 4:
        count = struct.unpack_from("<Q", content, 247)[0] or count
    fields = las_record(fmt)
    extra = length - np.dtype(fields).itemsize
    if extra < 0:
        raise ValueError("point records are shorter than their format")
    named: list[tuple[str, str]] = []
    meta, at = [], size
    for _ in range(vlrs):
        user, record, n = content[at + 2 : at + 18].rstrip(b"\0").decode("latin1"), *struct.unpack_from("<HH", content, at + 18)
        data = content[at + 54 : at + 54 + n]
        meta.append((user, record, content[at + 22 : at + 54].rstrip(b"\0").decode("latin1"), data))
        at += 54 + n
        if user == "LASF_Spec" and record == 4:
            for k in range(0, n - 191, 192):
                kind, name = data[k + 2], data[k + 4 : k + 36].rstrip(b"\0").decode("latin1")
                taken = {x for x, _ in fields + named}
                name = name if name and name not in taken else f"eb{k // 192}:{name}"
                if kind in EXTRA_TYPES:
                    named.append((name, EXTRA_TYPES[kind]))
                else:
                    width = data[k + 3] if kind == 0 else np.dtype(EXTRA_TYPES[(kind - 1) % 10 + 1]).itemsize * ((kind - 1) // 10 + 1)
                    named += [(f"{name}#{j}", "u1") for j in range(width)]
    if minor == 4 and size >= 375:
        at, extended = struct.unpack_from("<QI", content, 235)
        for _ in range(extended if at else 0):
            user, (record, n) = content[at + 2 : at + 18].rstrip(b"\0").decode("latin1"), struct.unpack_from("<HQ", content, at + 18)
            meta.append((user, record, content[at + 28 : at + 60].rstrip(b"\0").decode("latin1"), content[at + 60 : at + 60 + n]))
            at += 60 + n
    used = np.dtype(named).itemsize if named else 0
    if used > extra:
        named, used = [], 0
    named += [(f"undescribed#{j}", "u1") for j in range(extra - used)]
    return {"version": f"{major}.{minor}", "format": fmt, "begin": begin, "length": length, "count": count, "scale": scale, "offset": offset, "fields": fields + named, "vlrs": meta}


def parse_las(content: bytes) -> dict[str, np.ndarray]:
    """Unscaled columns. Returns, flags and channel are packed in bit_fields: return number in bits 0-3, number of
    returns 4-7, direction 8, edge 9, class flags 10-13, channel 14-15."""
    h = las_header(content)
    count = min(h["count"], (len(content) - h["begin"]) // h["length"])
    out = _decoded(np.frombuffer(content, np.dtype(h["fields"]), count, h["begin"]))
    flags = out.pop("flags")
    if h["format"] < 6:
        cls = out["classification"]
        bits = (flags & 7) | (flags >> 3 & 7) << 4 | (flags >> 6 & 1) << 8 | (flags >> 7) << 9 | (cls >> 5) << 10
        out["classification"] = cls & 31
    else:
        r = out.pop("returns")
        bits = (r & 15) | (r >> 4) << 4 | (flags >> 6 & 1) << 8 | (flags >> 7) << 9 | (flags & 15) << 10 | (flags >> 4 & 3) << 14
    return {**out, "bit_fields": bits}


PARSERS: dict[str, Callable[[bytes], dict[str, np.ndarray]]] = {"bin": parse_kitti, "ply": parse_ply, "las": parse_las}


def _fields(kind: str, content: bytes) -> list[T.StructField]:
    if kind == "bin":
        return [T.StructField(n, T.FloatType()) for n in ("X", "Y", "Z", "intensity")]
    if kind == "ply":
        return [T.StructField(n, _wide(c)) for n, c in ply_header(content)[2]]
    names = [(n, c) for n, c in las_header(content)["fields"] if n not in ("flags", "returns")]
    return [T.StructField(n, _wide(c)) for n, c in names] + [T.StructField("bit_fields", T.LongType())]


def read_points(spark: SparkSession, path: str, kind: str | None = None, most: int | None = None) -> DataFrame:
    """All points below path (a file, folder or pattern), or the first `most`: file, pos and the fields of the first file, which
    the others must share. pos is dense over the files in the order of their names."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in PARSERS:
        raise ValueError(f"no reader for .{kind}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    name = files.agg(F.min("path")).first()[0]  # names alone: contents aren't read for it
    if name is None:
        raise ValueError(f"no .{kind} file at {path}")
    fields = _fields(kind, bytes(files.filter(F.col("path") == name).select("content").first()[0]))
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), *fields])
    names = [f.name for f in fields]

    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for name, content in zip(p["path"], p["content"], strict=True):
                cols = PARSERS[kind](bytes(content))
                if list(cols) != names:
                    raise ValueError(f"{name} has other fields than the first file")
                n = len(next(iter(cols.values())))
                for a in range(0, n, 100_000):
                    yield pd.DataFrame({"file": name, "at": np.arange(a, min(n, a + 100_000)), **{k: v[a : a + 100_000] for k, v in cols.items()}})

    out = with_position(files.select("path", "content").mapInPandas(decode, schema), "file", "at").drop("at")
    return out if most is None else out.filter(F.col("pos") < most)


def read_block(spark: SparkSession, path: str, start: int, count: int, kind: str | None = None, step: float = 0.001) -> DataFrame:
    """Rows start to start + count of the points below path. csv files hold x, y and z first in a line and their
    coordinates come as whole multiples of step; lines without three numbers are an error."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind != "csv":
        return read_points(spark, path, kind, start + count).filter(F.col("pos") >= start)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.split("value", ",").alias("w"))
    xyz = [F.expr(f"cast(trim(w[{k}]) as double)") for k in range(3)]
    rows = with_position(lines.filter("size(w) > 1").select("file", "at", *[F.round(v / step).cast("long").alias(c) for c, v in zip("XYZ", xyz, strict=True)]), "file", "at")
    return rows.drop("at").filter((F.col("pos") >= start) & (F.col("pos") < start + count))


def coordinates(spark: SparkSession, path: str, kind: str | None = None, most: int | None = None) -> tuple[DataFrame, int]:
    """(pos, x, y, z) of any format in world coordinates, and the bytes of a coordinate in the file (0 for scaled integers)."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    df = read_points(spark, path, kind, most)
    names = {c.lower(): c for c in df.columns}
    x, y, z = (F.col(names[c]) for c in "xyz")
    if kind != "las":
        return df.select("pos", x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z")), 8 if dict(df.dtypes)[names["x"]] == "double" else 4
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path)
    h = las_header(bytes(files.filter(F.col("path") == files.agg(F.min("path")).first()[0]).select("content").first()[0]))
    return df.select("pos", *[v.alias(c) for c, v in zip("xyz", world("int", x, y, z, h["scale"], h["offset"]), strict=True)]), 0


def vlr_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, user_id, record_id, description, data): the variable-length records of LAS files."""
    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(n, *v) for n, c in zip(p["path"], p["content"], strict=True) for v in las_header(bytes(c))["vlrs"]]
            yield pd.DataFrame(rows, columns=["file", "user_id", "record_id", "description", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content")
    return files.mapInPandas(decode, "file string, user_id string, record_id int, description string, data binary")


def kitti_bytes(p: pd.DataFrame) -> bytes:
    return p[["X", "Y", "Z", "intensity"]].to_numpy(np.float32).astype("<f4").tobytes()


def ply_bytes(p: pd.DataFrame, kind: str = "binary_little_endian") -> bytes:
    names = {"f": {4: "float", 8: "double"}, "i": {8: "int"}}
    props = [(c, p[c].dtype) for c in p.columns]
    lines = ["ply", f"format {kind} 1.0", f"element vertex {len(p)}", *[f"property {names[d.kind][d.itemsize]} {c}" for c, d in props], "end_header", ""]
    head = "\n".join(lines).encode()
    if kind == "ascii":
        return head + "".join(" ".join(repr(x.item()) for x in row) + "\n" for row in zip(*[p[c].to_numpy() for c in p.columns], strict=True)).encode()
    order = PLY_ORDERS[kind]
    raw = np.empty(len(p), np.dtype([(c, order + ("i4" if d.kind == "i" else f"f{d.itemsize}")) for c, d in props]))
    for c, _ in props:
        raw[c] = p[c].to_numpy()
    return head + raw.tobytes()


#: Codes of extra-byte types by numpy code (fixed values, the inverse of EXTRA_TYPES).
EXTRA_CODES = {v: k for k, v in EXTRA_TYPES.items()}


def extra_descriptor(fields: list[tuple[str, str]]) -> bytes:
    """The 192-byte records that describe extra bytes: (name, numpy code) for each field. Names of over 32 bytes are an error."""
    out = bytearray()
    for name, code in fields:
        raw = name.encode("latin1")
        if len(raw) > 32 or code not in EXTRA_CODES:
            raise ValueError(f"{name}: {code} can't be described")
        record = bytearray(192)
        record[2] = EXTRA_CODES[code]
        record[4 : 4 + len(raw)] = raw
        out += record
    return bytes(out)


def vlr_bytes(user: str, record: int, description: str, data: bytes, extended: bool = False) -> bytes:
    """A variable-length record, or an extended one, whose length has eight bytes."""
    if len(data) > 65_535 and not extended:
        raise ValueError("a record of over 65,535 bytes must be extended")
    head = struct.pack("<H16sH" + ("Q" if extended else "H") + "32s", 0, user.encode("latin1"), record, len(data), description.encode("latin1"))
    return head + data


def las_bytes(p: pd.DataFrame, fmt: int = 1, scale: tuple = (0.01,) * 3, offset: tuple = (0.0,) * 3, keep: frozenset[str] | None = None, extra: list[tuple[str, str]] = (), vlrs: list[tuple] = (), evlrs: list[tuple] = ()) -> bytes:
    """A LAS 1.2 file (1.4 from format 6 on) with extra fields (name, numpy code) and records (user, number, description,
    data), extended ones behind the points. Columns outside keep are written as 0, extra ones left out; the counts by return number and
    the bounding box are recounted from the rows."""
    extra = [(n, c) for n, c in extra if keep is None or n in keep]
    fields = las_record(fmt) + extra
    raw = np.zeros(len(p), np.dtype(fields))
    for n, _ in fields:
        if n in p.columns and (keep is None or n in keep):
            raw[n] = p[n].to_numpy()
    bits = p["bit_fields"].to_numpy(np.int64) if "bit_fields" in p.columns and (keep is None or "bit_fields" in keep) else np.zeros(len(p), np.int64)
    if fmt < 6:
        raw["flags"] = (bits & 7) | (bits >> 4 & 7) << 3 | (bits >> 8 & 1) << 6 | (bits >> 9 & 1) << 7
        raw["classification"] |= ((bits >> 10 & 7) << 5).astype(np.uint8)
    else:
        raw["returns"] = bits & 255
        raw["flags"] = (bits >> 10 & 15) | (bits >> 14 & 3) << 4 | (bits >> 8 & 1) << 6 | (bits >> 9 & 1) << 7
    new = fmt >= 6
    size, slots = (375, 15) if new else (227, 5)
    if evlrs and not new:
        raise ValueError("extended records need a format of 6 or more")
    records = [vlr_bytes("LASF_Spec", 4, "extra bytes", extra_descriptor(extra))] if extra else []
    records += [vlr_bytes(*v) for v in vlrs]
    begin = size + sum(map(len, records))
    counts = np.bincount(np.clip(bits & 15, 0, 16), minlength=17)[1 : slots + 1]
    head = bytearray(size)
    head[:4], head[24], head[25] = b"LASF", 1, 4 if new else 2
    struct.pack_into("<HIIBHI", head, 94, size, begin, len(records), fmt, raw.dtype.itemsize, 0 if new else len(p))
    if not new:
        struct.pack_into("<5I", head, 111, *counts.tolist())
    struct.pack_into("<6d", head, 131, *scale, *offset)
    box = [f(raw[c]) * s + o for c, s, o in zip("XYZ", scale, offset, strict=True) for f in (np.max, np.min)] if len(p) else [0.0] * 6
    struct.pack_into("<6d", head, 179, *map(float, box))
    if new:
        struct.pack_into("<Q15Q", head, 247, len(p), *counts.tolist())
        if evlrs:
            struct.pack_into("<QI", head, 235, begin + raw.nbytes, len(evlrs))
    return b"".join([bytes(head), *records, raw.tobytes(), *[vlr_bytes(*v, extended=True) for v in evlrs]])


def encoded_files(df: DataFrame, encode: Callable[[pd.DataFrame], bytes], order: str = "pos", by: str = "file") -> DataFrame:
    """(path, content): one encoded file for each value of by, rows in the order of `order`."""
    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "content": [encode(p.sort_values(order).drop(columns=[by, order]))]})

    return df.groupBy(by).applyInPandas(one, "path string, content binary")


def save_files(files: DataFrame, folder: str) -> int:
    """Write (path, content) rows below folder under the paths' last parts, each to a side name and then renamed, so
    that a file is whole or absent. Rows pass the driver one at a time."""
    spark = files.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    count = 0
    for r in files.toLocalIterator():
        name = r["path"].rsplit("/", 1)[-1]
        part, final = jvm.org.apache.hadoop.fs.Path(root, f".{name}.part"), jvm.org.apache.hadoop.fs.Path(root, name)
        out = fs.create(part, True)
        out.write(bytearray(r["content"]))
        out.close()
        fs.delete(final, False)
        if not fs.rename(part, final):
            raise OSError(f"{name} can't be renamed")
        count += 1
    return count


def sphere(spark: SparkSession, radius: float, n: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """n points of a sphere with relative radial noise: pos, x, y, z."""
    g = spark.range(n).select(F.col("id").alias("pos"), *[F.randn(seed + k).alias(c) for k, c in enumerate("xyz")], (F.randn(seed + 3) * noise + 1).alias("s"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return g.select("pos", *[(F.col(c) / r * radius * F.col("s")).alias(c) for c in "xyz"])


#: Fields of a row of the order study, in the order of the log (fixed values).
LOG_FIELDS = ("name", "cond", "n", "dup_key", "dup_pt", "gpcc", "laz", "geom3", "scan1", "tot_geom3", "tot_scan1", "genc", "gdec", "gpeak", "lenc", "ldec", "penc", "pdec", "ppeak", "ver")


def _log_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.split(F.trim("value"), r"\s+").alias("w"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines that read_log() leaves out, but for blank ones."""
    n = F.expr(f"try_cast(w[{LOG_FIELDS.index('n')}] as bigint)")
    return _log_cells(spark, path).filter((F.trim("value") != "") & ((F.size("w") != len(LOG_FIELDS)) | n.isNull())).select("value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The white-space separated log of an order study as rows. Lines of other lengths are left out here; bad_lines() has them."""
    cells = _log_cells(spark, path).filter(F.size("w") == len(LOG_FIELDS))
    kinds = {"name": "string", "cond": "string", "ver": "string", "n": "bigint", "dup_pt": "bigint"}
    cast = lambda k, n: F.expr(f"try_cast(w[{k}] as {kinds.get(n, 'double')})").alias(n)
    return cells.select(*[cast(k, n) for k, n in enumerate(LOG_FIELDS)]).filter("n is not null")


def check_log(rows: DataFrame, conditions: list[str]) -> DataFrame:
    """(name, cond, count) of conditions that a name lacks or has more than once."""
    wanted = rows.select("name").distinct().crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in conditions], "cond string")))
    have = rows.groupBy("name", "cond").agg(F.count("*").alias("count"))
    return wanted.join(have, ["name", "cond"], "left").select("name", "cond", F.coalesce("count", F.lit(0)).alias("count")).filter("count <> 1")
