"""Point files of any form as a Spark data source that outlives broken files.

``spark.dataSource.register(SweepSource)``, then ``spark.read.format("sweeps").load(path)``.
Files and archives are listed once; an archive's members are known from its central directory,
and a task reads and unpacks just the members dealt to it. A file that cannot be decoded
becomes one row with a ``finding`` in place of its points; an archive that breaks a safety
rule is not opened any further. Errors of the storage itself still fail the task, so that it
runs again.
"""
from __future__ import annotations

import io
import re
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scans import DECODERS, FRAME_OF, SEQUENCE_OF, SLICE, decode_any

FIELDS = ("sequence string, frame_id long, point_id long, x double, y double, z double, intensity float, "
          "path string, member string, finding string")
ARROW = pa.schema([("sequence", pa.string()), ("frame_id", pa.int64()), ("point_id", pa.int64()),
                   ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("intensity", pa.float32()),
                   ("path", pa.string()), ("member", pa.string()), ("finding", pa.string())])
#: What decoding may raise on broken content; OSError stays an error.
BROKEN = (ValueError, KeyError, IndexError, TypeError, OverflowError, EOFError, zipfile.BadZipFile, zlib.error,
          NotImplementedError, RuntimeError)
#: --- fixed values: limits of an archive ---
MAX_ENTRIES, MAX_BYTES = 15_000, 2 * 1024 ** 3


@dataclass
class Item:
    """One file, or one member of an archive; ``finding`` is set if it must not be read."""
    path: str
    member: str | None
    sequence: str
    frame_id: int | None
    size: int
    finding: str | None = None


class Portion(InputPartition):
    def __init__(self, items):
        self.items = items


def open_store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def natural(name: str):
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p]


def archive_rule(infos) -> str | None:
    """The safety rule that an archive's central directory breaks."""
    if len(infos) > MAX_ENTRIES:
        return "too many entries"
    if sum(i.file_size for i in infos) > MAX_BYTES:
        return "expands beyond the limit"
    for i in infos:
        name = i.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/") or ":" in name:
            return "unsafe member path"
        if (i.external_attr >> 16) & 0o170000 == 0o120000:
            return "contains links"
    return None


class SweepReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.target = int(options.get("bytesPerPartition", 64 << 20))
        self.threads = int(options.get("listingThreads", 16))

    def _items(self, store, info):
        suffix = info.base_name.rsplit(".", 1)[-1].lower()
        if suffix in DECODERS:
            frame, sequence = re.search(FRAME_OF, info.path), re.search(SEQUENCE_OF, info.path)
            return [Item(info.path, None, sequence[1] if sequence else "", int(frame[1]) if frame else None, info.size)]
        if suffix != "zip":
            return []
        try:  # reads the end of the file only
            with store.open_input_file(info.path) as file, zipfile.ZipFile(file) as archive:
                infos = archive.infolist()
        except BROKEN as error:
            return [Item(info.path, None, info.path, None, 0, f"broken archive: {error}")]
        rule = archive_rule(infos)
        if rule:
            return [Item(info.path, None, info.path, None, 0, rule)]
        members = sorted((i for i in infos if i.filename.rsplit(".", 1)[-1].lower() in DECODERS),
                         key=lambda i: (natural(i.filename), i.filename))
        return [Item(info.path, i.filename, info.path, n, i.file_size) for n, i in enumerate(members)]

    def partitions(self):
        store, root = open_store(self.path)
        top = store.get_file_info(root)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)
        with ThreadPoolExecutor(self.threads) as pool:
            items = [i for own in pool.map(lambda f: self._items(store, f), files) for i in own]
        out, held, size = [], [], 0
        for item in items:
            if held and size + item.size > self.target:
                out.append(Portion(held))
                held, size = [], 0
            held.append(item)
            size += item.size
        return [*out, Portion(held)] if held or not out else out

    def read(self, portion):
        store, _ = open_store(self.path)
        archive, at = None, None
        for item in portion.items:
            if item.finding:
                yield _finding(item, item.finding)
                continue
            try:
                if item.member is None:
                    with store.open_input_stream(item.path) as file:
                        content = file.read()
                else:
                    if at != item.path:
                        archive, at = zipfile.ZipFile(store.open_input_file(item.path)), item.path
                    content = archive.read(item.member)
                columns = decode_any(item.member or item.path, content)
            except BROKEN as error:
                yield _finding(item, f"{type(error).__name__}: {error}"[:200])
                continue
            yield from _rows(item, columns)


def _rows(item: Item, columns: dict):
    total = len(columns["x"])
    if not total:
        yield _finding(item, "no points")
    for start in range(0, total, SLICE):
        part = {k: v[start:start + SLICE] for k, v in columns.items()}
        n = len(part["x"])
        same = [pa.array([v] * n, kind) for v, kind in (
            (item.sequence, pa.string()), (item.frame_id, pa.int64()), (item.path, pa.string()),
            (item.member, pa.string()), (None, pa.string()))]
        yield pa.RecordBatch.from_arrays(
            [*same[:2], pa.array(np.arange(start, start + n)), *[pa.array(part[d], pa.float64()) for d in "xyz"],
             pa.array(part["intensity"], pa.float32()), *same[2:]], schema=ARROW)


def _finding(item: Item, text: str):
    row = {**dict.fromkeys(ARROW.names), "sequence": item.sequence, "frame_id": item.frame_id, "path": item.path,
           "member": item.member, "finding": text}
    return pa.RecordBatch.from_pylist([row], schema=ARROW)


class SweepSource(DataSource):
    """Options: ``path``, ``bytesPerPartition`` (64 MB), ``listingThreads`` (16)."""

    @classmethod
    def name(cls):
        return "sweeps"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return SweepReader(self.options)


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Points and findings of all point files and archives below ``path``, each read once."""
    spark.dataSource.register(SweepSource)
    return spark.read.format("sweeps").load(path)


# --- writing -----------------------------------------------------------------

def _pcd(rows, data, extra=""):
    return (f"VERSION .7\nFIELDS {extra}x y z intensity\nSIZE {'1 ' if extra else ''}4 4 4 4\n"
            f"TYPE {'U ' if extra else ''}F F F F\nCOUNT {'2 ' if extra else ''}1 1 1 1\n"
            f"WIDTH {rows}\nHEIGHT 1\nPOINTS {rows}\nDATA {data}\n").encode()


def _ply(rows, form, order, values):
    head = (f"ply\nformat {form} 1.0\nelement vertex {rows}\n"
            + "".join(f"property float {n}\n" for n in ("x", "y", "z", "intensity")) + "end_header\n").encode()
    return head + values.astype(order + "f4").tobytes()


def encode_sweep(values: np.ndarray, form: str) -> bytes:
    """One frame (rows of x, y, z, intensity) as a file of the given form."""
    n, values = len(values), np.ascontiguousarray(values, "<f4")
    if form == "bin":
        return values.tobytes()
    if form == "ply":
        return _ply(n, "binary_little_endian", "<", values)
    if form == "big.ply":
        return _ply(n, "binary_big_endian", ">", values)
    if form == "text.pcd":
        return _pcd(n, "ascii") + "".join(" ".join(map(repr, r)) + "\n" for r in values.astype(float).tolist()).encode()
    if form == "pcd":  # with a field of two bytes before the coordinates
        wide = np.zeros(n, [("_", "u1", 2), ("v", "<f4", 4)])
        wide["v"] = values
        return _pcd(n, "binary", "_ ") + wide.tobytes()
    if form == "lzf.pcd":
        plain = values.T.tobytes()
        runs = b"".join(bytes([len(plain[i:i + 32]) - 1]) + plain[i:i + 32] for i in range(0, len(plain), 32))
        return _pcd(n, "binary_compressed") + np.array([len(runs), len(plain)], "<u4").tobytes() + runs
    if form == "zip":
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("0.bin", values.tobytes())
        return packed.getvalue()
    raise ValueError(form)


def write_sweeps(points: DataFrame, path: str, keys=("sequence", "frame_id")) -> DataFrame:
    """Write every frame of ``points`` (x, y, z, intensity, form) as one file; run it by an action.

    Returns path and bytes of each file. A frame is at most two million points. A file is
    written under its final name only, so that a task run again writes the same once more.
    """
    keys = list(keys)

    def run(key, table):
        store, root = open_store(path)
        sequence, frame = (str(k.as_py()) for k in key)
        rows = table.sort_by("point_id")
        values = np.stack([rows.column(c).to_numpy() for c in ("x", "y", "z", "intensity")], 1)
        form = rows.column("form")[0].as_py()
        broken, form = form.startswith("broken "), form.removeprefix("broken ")
        content = encode_sweep(values, form)
        name = f"{root.rstrip('/')}/sequences/{sequence}/{int(frame):06d}.{form.rsplit('.', 1)[-1]}"
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(name) as file:
            file.write(content[:-3] if broken else content)
        return pa.table({"path": [name], "bytes": pa.array([len(content)], pa.int64())})
    return points.select(*keys, "point_id", "x", "y", "z", "intensity", "form").groupBy(*keys).applyInArrow(
        run, "path string, bytes long")
