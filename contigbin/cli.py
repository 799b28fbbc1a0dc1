"""python -m contigbin.cli run|bin|doctor|--version."""

from __future__ import annotations

import argparse
import importlib.util
import shutil
import sys

from . import __version__


# Programs that make the inputs of a run, and are not needed by it
TOOLS = ("minimap2", "samtools", "genomad", "checkv")


def doctor() -> int:
    """Prints which packages and which optional programs are there; 1 if a package is missing (OPS-3)."""
    missing = [p for p in ("pyspark", "pyarrow", "pandas", "numpy") if importlib.util.find_spec(p) is None]
    print("missing: " + ", ".join(missing) if missing else "all packages found")
    for tool in TOOLS:
        print(f"{tool}: {shutil.which(tool) or 'not found (optional)'}")
    return int(bool(missing))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="contigbin")
    parser.add_argument("--version", action="version", version=f"contigbin {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor", help="what is installed")
    run = commands.add_parser("run", help="bins from FASTA, coverage and assembly graph")
    for name in ("fasta", "coverage", "gfa", "output"):
        run.add_argument(name)
    run.add_argument("--paths")
    prepared = commands.add_parser("bin", help="bins of a prepared dataset")
    for name in ("dataset", "output"):
        prepared.add_argument(name)
    prepared.add_argument("--fasta", help="sequences, for terminal repeats and per-bin FASTA")
    prepared.add_argument("--coverage", help="a coverage table in place of the dataset's own")
    for command in (run, prepared):
        command.add_argument("--min-length", type=int, default=2_000)
        command.add_argument("--no-model", action="store_true", help="use the attribute view as the embedding")
    given = parser.parse_args(args)
    if given.command == "doctor":
        return doctor()
    from pyspark.sql import SparkSession

    from .config import BinningConfig
    from .plans import binning

    spark = SparkSession.builder.appName("contigbin").getOrCreate()
    config, learn = BinningConfig(least_length=given.min_length), not given.no_model
    if given.command == "bin":
        bins = binning.run_prepared(spark, given.dataset, given.output, given.fasta, given.coverage, config, learn)
    else:
        bins = binning.run(spark, given.fasta, given.coverage, given.gfa, given.output, given.paths, config, learn)
    print(f"{bins.count()} contigs in {bins.select('bin').distinct().count()} bins")
    return 0


if __name__ == "__main__":
    sys.exit(main())
