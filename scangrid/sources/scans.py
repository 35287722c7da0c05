"""Binary sweeps, labels, archives, poses: files to typed rows.

Files are listed and spread by Spark; only decoding one file's bytes runs in
pandas. A frame is at most two million points, so a decoded batch is bounded, and
large files are emitted in slices.
"""
import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import LABEL_SCHEMA, POINT_SCHEMA, POSE_FIELDS
from ..functions.geom import rigid  # noqa: F401  (re-exported for pose users)

SLICE = 200_000
FRAME_OF = r"([0-9]+)\.[A-Za-z]+$"
SEQUENCE_OF = r"sequences/([^/]+)/"


def binary_files(spark: SparkSession, path: str, glob="*") -> DataFrame:
    """path, sequence, frame_id, length and content of matching files."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    frame = F.regexp_extract("path", FRAME_OF, 1)
    return files.select(
        "path", F.regexp_extract("path", SEQUENCE_OF, 1).alias("sequence"),
        F.when(frame != "", frame).cast("long").alias("frame_id"), "length", "content")


def _slices(sequence, frame, columns):
    n = len(next(iter(columns.values())))
    for start in range(0, n, SLICE):
        part = {k: v[start:start + SLICE] for k, v in columns.items()}
        size = len(next(iter(part.values())))
        yield pd.DataFrame({"sequence": sequence, "frame_id": frame,
                            "point_id": np.arange(start, start + size, dtype="int64"), **part})


def decode_sweep(content: bytes) -> dict:
    values = np.frombuffer(content, dtype="<f4")
    if len(values) % 4:
        raise ValueError("scan length is not a multiple of four floats")
    x, y, z, i = values.reshape(-1, 4).T
    return {"x": x.astype("f8"), "y": y.astype("f8"), "z": z.astype("f8"), "intensity": i}


# PLY and PCD name their number types differently; both map to numpy codes.
NUMPY_TYPES = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
               "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "ushort": "u2",
               "uint16": "u2", "short": "i2", "int16": "i2", "uint": "u4",
               "uint32": "u4", "int": "i4", "int32": "i4"}


def _columns(table: dict, rows: int) -> dict:
    """Coordinates and intensity (zero where there is none) out of all fields."""
    missing = [d for d in "xyz" if d not in table]
    if missing:
        raise ValueError(f"no field {missing[0]}")
    if any(len(table[d]) != rows for d in "xyz"):
        raise ValueError("fewer points than announced")
    return {**{d: table[d].astype("f4").astype("f8") for d in "xyz"},
            "intensity": table.get("intensity", np.zeros(rows, "f4")).astype("f4")}


def _numbers(lines, names):
    data = np.array([line.split()[:len(names)] for line in lines], "f8").reshape(-1, len(names))
    return {n: data[:, i] for i, n in enumerate(names)}


def _ply_header(head: bytes):
    """Format and elements ``(name, count, properties)``; a list property has two types."""
    kind, elements = None, []
    for words in (line.split() for line in head.decode("ascii").splitlines()):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            types = words[2:4] if words[1] == "list" else words[1:2]
            elements[-1][2].append((words[-1], [NUMPY_TYPES[t] for t in types]))
    return kind, elements


def _skip_rows(body: bytes, at: int, count: int, properties, order: str) -> int:
    """Place behind ``count`` binary rows whose properties may be lists."""
    fixed = sum(np.dtype(t[0]).itemsize for _, t in properties if len(t) == 1)
    if all(len(t) == 1 for _, t in properties):
        return at + count * fixed
    for _ in range(count):
        for _, types in properties:
            if len(types) == 2:
                size = np.dtype(types[0]).itemsize
                length = int(np.frombuffer(body, order + types[0], 1, at)[0])
                at += size + length * np.dtype(types[1]).itemsize
            else:
                at += np.dtype(types[0]).itemsize
    return at


def decode_ply(content: bytes) -> dict:
    head, mark, body = content.partition(b"end_header")
    kind, elements = _ply_header(head)
    body = body[body.index(b"\n") + 1:] if mark else b""
    order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}.get(kind)
    if order is None or not mark:
        raise ValueError(f"unsupported PLY format {kind}")
    at, lines = 0, body.splitlines() if kind == "ascii" else None
    for name, count, properties in elements:
        if name != "vertex":
            at = at + count if lines is not None else _skip_rows(body, at, count, properties, order)
            continue
        if any(len(t) == 2 for _, t in properties):
            raise ValueError("vertices with lists are not supported")
        names = [n for n, _ in properties]
        if lines is not None:
            return _columns(_numbers(lines[at:at + count], names), count)
        data = np.frombuffer(body, np.dtype([(n, order + t[0]) for n, t in properties]), count, at)
        return _columns({n: data[n] for n in names}, count)
    raise ValueError("no vertices")


def lzf_decompress(data: bytes, size: int) -> bytes:
    """The LZF stream of compressed point files: literal runs and references back."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        at += 1
        if control < 32:
            out += data[at:at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        start = len(out) - ((control & 31) << 8 | data[at]) - 1
        at += 1
        if start < 0:
            raise ValueError("compressed data refers to nothing")
        for k in range(length + 2):  # a reference may run into what it writes
            out.append(out[start + k])
    if len(out) != size:
        raise ValueError("compressed data has another length than announced")
    return bytes(out)


def decode_pcd(content: bytes) -> dict:
    head, _, rest = content.partition(b"\nDATA ")
    kind, _, body = rest.partition(b"\n")
    fields = {w[0]: w[1:] for w in (line.split() for line in head.decode("ascii").splitlines()) if w}
    kind, rows, names = kind.strip().decode(), int(fields["POINTS"][0]), fields["FIELDS"]
    counts = [int(c) for c in fields.get("COUNT", ["1"] * len(names))]
    code = {"F": "f", "U": "u", "I": "i"}
    types = [f"<{code[t]}{s}" for t, s in zip(fields["TYPE"], fields["SIZE"])]
    # A field of several values takes as many places; only the first one is named.
    if kind == "ascii":
        wide = [n if k == 0 else f"{n}/{k}" for n, c in zip(names, counts) for k in range(c)]
        lines = [line for line in body.splitlines() if line.strip()]
        return _columns(_numbers(lines[:rows], wide), rows)
    if kind == "binary":
        # Padding fields share a name, so places are numbered.
        data = np.frombuffer(body, np.dtype([(str(i), t, (c,)) for i, (t, c) in enumerate(zip(types, counts))]), rows)
        return _columns({n: data[str(i)][:, 0] for i, n in enumerate(names)}, rows)
    if kind != "binary_compressed":
        raise ValueError(f"unsupported PCD data {kind}")
    packed, plain = (int(x) for x in np.frombuffer(body, "<u4", 2))
    data, at, table = lzf_decompress(body[8:8 + packed], plain), 0, {}
    for name, kind, count in zip(names, types, counts):  # all values of a field lie together
        table[name] = np.frombuffer(data, kind, rows * count, at).reshape(rows, count)[:, 0]
        at += rows * count * np.dtype(kind).itemsize
    return _columns(table, rows)


DECODERS = {"bin": decode_sweep, "ply": decode_ply, "pcd": decode_pcd}


def decode_any(name: str, content: bytes) -> dict:
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix not in DECODERS:
        raise ValueError(f"unsupported point file {name}")
    return DECODERS[suffix](content)


def scan_points(files: DataFrame) -> DataFrame:
    """Point rows of ``.bin``, ``.ply`` and ``.pcd`` files (columns as binary_files)."""
    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from _slices(row.sequence, row.frame_id, decode_any(row.path, row.content))
    return files.select("path", "sequence", "frame_id", "content").mapInPandas(run, POINT_SCHEMA)


def scan_labels(files: DataFrame) -> DataFrame:
    """Raw 32-bit labels, one row per point."""
    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw = np.frombuffer(row.content, dtype="<u4").astype("int64")
                yield from _slices(row.sequence, row.frame_id, {"raw": raw})
    return files.select("sequence", "frame_id", "content").mapInPandas(run, LABEL_SCHEMA)


def archive_members(files: DataFrame) -> DataFrame:
    """Member listing of zip files, for the safety rules, without unpacking them."""
    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                infos = zipfile.ZipFile(io.BytesIO(row.content)).infolist()
                yield pd.DataFrame({
                    "path": row.path, "member": [i.filename for i in infos],
                    "expanded_bytes": [i.file_size for i in infos],
                    "is_link": [(i.external_attr >> 16) & 0o170000 == 0o120000 for i in infos]})
    return files.select("path", "content").mapInPandas(
        run, "path string, member string, expanded_bytes long, is_link boolean")


def scan_archive(spark: SparkSession, path: str, limit=None):
    """(points, quarantine): points of archives' members in natural frame order, and findings.

    Archives that break a safety rule and members that cannot be decoded are findings.
    """
    from .sweeps import read_sweeps
    rows = read_sweeps(spark, path).where(F.lower("path").endswith(".zip"))
    points = rows.where("finding is null" if limit is None else f"finding is null and frame_id < {int(limit)}")
    return points.select(*POINT_SCHEMA.names), rows.where("finding is not null").select("path", "member", "finding")


def scan_poses(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``poses.txt`` files: frame number = line number, 12 numbers each."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="poses.txt",
                            recursiveFileLookup=True)
    lines = files.select(
        F.regexp_extract("_metadata.file_path", SEQUENCE_OF, 1).alias("sequence"),
        F.posexplode(F.split(F.trim("value"), "\n")).alias("frame_id", "line"))
    nums = F.split(F.trim("line"), r"\s+")
    return lines.select("sequence", F.col("frame_id").cast("long").alias("frame_id"), *[
        nums[i].cast("double").alias(f) for i, f in enumerate(POSE_FIELDS)])


def scan_calib(spark: SparkSession, path: str) -> DataFrame:
    """The ``Tr`` matrix of ``calib.txt`` files, one row per sequence."""
    lines = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "calib.txt").text(path).where(F.col("value").startswith("Tr:"))
    nums = F.split(F.trim(F.substring("value", 4, 10000)), r"\s+")
    return lines.select(
        F.regexp_extract("_metadata.file_path", SEQUENCE_OF, 1).alias("sequence"),
        *[nums[i].cast("double").alias(f) for i, f in enumerate(POSE_FIELDS)])
