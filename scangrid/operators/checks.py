"""Validation as queries: each returns the offending rows with the rule they break."""
from pyspark.sql import DataFrame, functions as F

from ..functions.geom import is_finite
from ..schema import FRAME_MAX_POINTS, FRAME_MIN_POINTS


def _findings(df: DataFrame, keys, rules: dict) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))
    return df.select(*keys, F.explode(names).alias("finding"))


def frame_findings(points, keys=("sequence", "frame_id"), least=FRAME_MIN_POINTS,
                   most=FRAME_MAX_POINTS) -> DataFrame:
    bad = ~(is_finite("x") & is_finite("y") & is_finite("z"))
    frames = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                       F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))
    return _findings(frames, [*keys, "n"], {
        "point count outside limits": ~F.col("n").between(least, most),
        "non-finite values": F.col("bad") > 0})


def grid_input_findings(points, keys, conf="conf", cls="pred", speed=None) -> DataFrame:
    conf = F.col(conf)
    rules = {"confidence outside [0, 1]": ~(is_finite(conf) & conf.between(0, 1)),
             "unknown class id": ~F.col(cls).isin(0, 1, 2, 3, 255)}
    if speed:
        rules["non-finite motion"] = ~is_finite(speed)
    return _findings(points, keys, rules)


def paired_only(scans, labels, keys=("sequence", "frame_id")) -> DataFrame:
    return scans.join(labels.select(*keys).distinct(), list(keys), "left_semi")


def missing_labels(scans, labels, keys=("sequence", "frame_id")) -> DataFrame:
    return scans.join(labels.select(*keys).distinct(), list(keys), "left_anti")


def binary_findings(files: DataFrame, keys) -> DataFrame:
    """Scan and label files (``scan_bytes``, ``label_bytes``) whose lengths do not fit."""
    return _findings(files, keys, {
        "empty scan": F.col("scan_bytes") == 0,
        "scan length not a multiple of 16": F.col("scan_bytes") % 16 != 0,
        "missing label": F.col("label_bytes").isNull(),
        "label length not a multiple of 4": F.col("label_bytes") % 4 != 0,
        "point and label counts differ":
            F.floor(F.col("scan_bytes") / 16) != F.floor(F.col("label_bytes") / 4)})


def upload_findings(files: DataFrame, keys, max_files=300, max_bytes=2 * 1024 ** 3) -> DataFrame:
    """Rules over an upload's file list (``name``, ``bytes``)."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    one = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("total"),
        F.count_if(suffix == ".zip").alias("zips"),
        F.count_if(~suffix.isin(".bin", ".ply", ".pcd", ".zip")).alias("odd"))
    return _findings(one, keys, {
        "unsupported file type": F.col("odd") > 0,
        "an archive must be the only file": (F.col("zips") > 0) & (F.col("files") > 1),
        "too many files": F.col("files") > max_files,
        "upload too large": F.col("total") > max_bytes})


def archive_findings(members: DataFrame, keys=("path",), max_entries=15000,
                     max_bytes=2 * 1024 ** 3) -> DataFrame:
    """Archives breaking a safety rule, from their member listing."""
    name = F.regexp_replace("member", r"\\", "/")
    bad = name.startswith("/") | F.array_contains(F.split(name, "/"), "..") | name.contains(":")
    one = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.sum("expanded_bytes").alias("total"),
        F.count_if(bad).alias("unsafe"), F.count_if("is_link").alias("links"))
    return _findings(one, keys, {
        "too many entries": F.col("entries") > max_entries,
        "expands beyond the limit": F.col("total") > max_bytes,
        "unsafe member path": F.col("unsafe") > 0, "contains links": F.col("links") > 0})


def manifest_mismatch(actual: DataFrame, manifest: DataFrame, key="path",
                      digest="digest") -> DataFrame:
    """Members missing from the manifest or with another digest."""
    return actual.join(manifest.select(key, digest), [key, digest], "left_anti")


def split_overlap(frames: DataFrame) -> DataFrame:
    """Sequences present in more than one split (empty when splits are disjoint)."""
    return (frames.groupBy("sequence_no").agg(F.count_distinct("split").alias("splits"))
            .where("splits > 1"))
