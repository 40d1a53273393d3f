"""``python -m loomline.cli``: load, compare, inspect and generate-config."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from loomline.ir import Frames, Source
from loomline.operators.compare import compare
from loomline.plans.config import SAMPLE, Settings
from loomline.report import Result
from loomline.sources.databases import load_database, load_spark_catalog
from loomline.sources.files import SourceError, load_file, load_url


def load(spark: SparkSession, source: str, conn: str | None = None) -> Source | Frames:
    """``db:<connection>``, ``table:<database>``, an http(s) url, ``file:<path>`` or a path; ``conn`` alone is a database too."""
    if source.startswith("db:") or conn:
        name = source.removeprefix("db:")
        return load_database(spark, f"{name}://{conn}" if conn and "://" not in conn else conn or name)
    if source.startswith("table:"):
        return load_spark_catalog(spark, source.removeprefix("table:") or None)
    if source.startswith(("http://", "https://")):
        return load_url(source)
    path = source.removeprefix("file:")
    if path.endswith(".ir.json"):
        return Source.from_json(Path(path).read_text(encoding="utf-8"))
    return load_file(path)


def _frames(spark: SparkSession, loaded: Source | Frames) -> Frames:
    return loaded.frames(spark) if isinstance(loaded, Source) else loaded


def _shown(loaded: Source | Frames) -> str:
    if isinstance(loaded, Source):
        return loaded.to_json()
    return json.dumps([r.asDict(True) for r in loaded.fields.orderBy("entity_idx", "field_idx").collect()], indent=2)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("load", "inspect"):
        p = commands.add_parser(name)
        p.add_argument("--source", required=True)
        p.add_argument("--conn")
        p.add_argument("--format", default="json", choices=["json", "summary"])
        p.add_argument("--out")
    p = commands.add_parser("compare")
    for side in "ab":
        p.add_argument(f"--source-{side}", required=True)
        p.add_argument(f"--conn-{side}")
    p.add_argument("--out")
    p.add_argument("--config")
    p.add_argument("--confidence-threshold", type=float)
    commands.add_parser("generate-config").add_argument("--out", default="loomline.toml")
    args = parser.parse_args(argv)
    try:
        if args.command == "generate-config":
            Path(args.out).write_text(SAMPLE, encoding="utf-8")
            return 0
        spark = SparkSession.builder.appName("loomline").getOrCreate()
        if args.command == "compare":
            settings = Settings.load(args.config)
            a, b = (_frames(spark, load(spark, s, c)) for s, c in ((args.source_a, args.conn_a), (args.source_b, args.conn_b)))
            result = Result(compare(a, b, settings.compare_config()), settings.resolution_config(args.confidence_threshold))
            for path in result.write(args.out or settings.output_dir, settings.generates):
                print(path)
            return 0
        loaded = load(spark, args.source, args.conn)
        if args.format == "summary" and isinstance(loaded, Source):
            text = "\n".join([f"{loaded.source_name} ({loaded.source_type})", *[f"  {e.entity_name}: {len(e.fields)} fields" for e in loaded.entities]])
        else:
            text = _shown(loaded)
        if args.out:
            Path(args.out).write_text(text, encoding="utf-8")
        else:
            print(text)
        return 0
    except (SourceError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
