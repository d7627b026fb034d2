"""Command line: text, scan, clean, jsonl."""

from __future__ import annotations

import argparse
import sys

from .functions.texts import redact
from .plans.policy import Policy

PRESETS = {"default": Policy.default, "strict": Policy.strict, "web": Policy.web, "production": Policy.production}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sablecloth")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("text", "scan", "clean", "jsonl"):
        sub = commands.add_parser(name)
        sub.add_argument("source")
        sub.add_argument("--policy", choices=PRESETS, default="default")
        if name in ("clean", "jsonl"):
            sub.add_argument("--output", required=True)
        if name == "jsonl":
            sub.add_argument("--on-error", choices=("raise", "skip", "placeholder"), default="raise")
    args = parser.parse_args(argv)
    policy = PRESETS[args.policy]()
    if args.command == "text":
        print(redact(args.source, policy)[0])
        return 0
    from .sources import files

    if args.command == "scan":
        found, limits = files.scan_file(args.source, policy)
        for f in found:
            print(f"{f.category} at {f.location}")
        for limit in limits:
            print(f"limitation: {limit}")
        return int(bool(found or limits))
    if args.command == "clean":
        files.clean_file(args.source, args.output, policy)
        return 0
    from pyspark.sql import SparkSession

    files.clean_jsonl(SparkSession.builder.getOrCreate(), args.source, args.output, policy, args.on_error).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
