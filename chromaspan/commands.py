"""The commands convert, filter, clean, sort and segment over files: python -m chromaspan.commands COMMAND INPUT OUTPUT ..."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.coords import DATA_TYPES
from .functions.predicates import ensure_log_scale
from .operators import intervals, merge, segmentation
from .sources import files

log = logging.getLogger(__name__)


def _write(kind: str, df, path: str) -> None:
    if kind.startswith("segmented"):
        files.write_segments(df, path)
    else:
        files.write_raw(df, path)


def default_output(command: str, given: str, to: str | None = None) -> str:
    """Where a command writes if it isn't told: beside its input."""
    stem, dot, extension = given.rstrip("/").rpartition(".")
    if not dot or "/" in extension:
        stem, dot, extension = given.rstrip("/"), "", ""
    if command in ("convert", "segment"):
        return f"{stem}.{to or 'seg'}"
    return f"{stem}.{ {'filter': 'filtered', 'clean': 'cleaned', 'sort': 'sorted'}[command] }{dot}{extension}"


def run(spark: SparkSession, args: list[str]) -> None:
    p = argparse.ArgumentParser(prog="chromaspan")
    p.add_argument("command", choices=["convert", "filter", "clean", "sort", "segment"])
    p.add_argument("input")
    p.add_argument("output", nargs="?", help="unless given: the input's stem with .filtered, .cleaned or .sorted, or with the extension that --to names")
    p.add_argument("--to", choices=sorted(set(DATA_TYPES) - {"lrrbaf"}), help="what convert makes of the input, instead of what the output's extension names")
    p.add_argument("--markers", help="at which markers convert gives segments as raw values")
    p.add_argument("--version", action="version", version="chromaspan 0.3")
    p.add_argument("--reference")
    p.add_argument("--score", default="dice", choices=["dice", "query", "reference", "union", "min", "max"])
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--ref-state", type=float, default=0.0)
    p.add_argument("--state-diff", type=float)
    for flag in ("inverse", "merge", "aberrant", "hybrid", "undo-prune"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--no-optimize", action="store_true")
    p.add_argument("--count", type=int)
    p.add_argument("--length", type=int)
    p.add_argument("--alpha", type=float, default=0.01)
    p.add_argument("--nperm", type=int, default=200)
    p.add_argument("--min-width", type=int, default=2)
    p.add_argument("--log-level", default=os.environ.get("CHROMASPAN_LOG_LEVEL", "WARNING"), type=str.upper, choices=["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"])
    a = p.parse_args(args)
    if a.command == "convert" and not (a.output or a.to):
        p.error("convert needs an output or --to")
    a.output = a.output or default_output(a.command, a.input, a.to)
    logging.getLogger("chromaspan").setLevel(a.log_level)
    log.info("%s %s to %s", a.command, a.input, a.output)
    if a.command == "sort":
        return files.write_markers(files.read_markers(spark, a.input, named=True), a.output)
    kind, df = files.read_any(spark, a.input)
    if a.command == "convert":
        to = DATA_TYPES[a.to] if a.to else files.kind_of(a.output)
        markers = files.read_markers(spark, a.markers, named=True) if a.markers else None
        return _write(to, files.convert(kind, df, to, markers), a.output)
    if a.command == "segment":
        df = segmentation.segment_raw(ensure_log_scale(df), alpha=a.alpha, nperm=a.nperm, min_width=a.min_width, hybrid=a.hybrid, undo_prune=a.undo_prune)
        return files.write_segments(df, a.output)
    if kind.startswith("raw"):
        if a.command == "clean":
            raise ValueError("raw values can't be cleaned")
        if not a.reference:
            raise ValueError("filter needs --reference")
        # A raw reference is read as such, whatever its extension says.
        reference = files.read_raw(spark, a.reference, alleles=a.reference.rstrip("/").endswith(".cnas"))
        return _write(kind, intervals.marker_filter(df, reference), a.output)
    if a.command == "clean":
        return files.write_segments(merge.clean(df, a.count, a.length, a.aberrant, a.ref_state, 0.2 if a.state_diff is None else a.state_diff, a.merge), a.output)
    if not a.reference:
        raise ValueError("filter needs --reference")
    ref = files.read_segments(spark, a.reference, reference=True)
    diff = 0.1 if a.state_diff is None else a.state_diff
    how = (a.score, a.threshold, a.inverse, (a.ref_state, diff) if a.aberrant else None, not a.no_optimize)
    if a.merge:
        return files.write_segments(merge.remove_flagged(intervals.exists_flag(df, ref, "_flag", *how), F.col("_flag"), diff, True), a.output)
    files.write_segments(intervals.exists_filter(df, ref, *how), a.output)


if __name__ == "__main__":
    import sys

    logging.basicConfig()
    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
