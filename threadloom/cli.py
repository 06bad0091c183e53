"""Commands: inspect, ingest, compile, semantic-local, run-local, verify."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from threadloom import schema as S
from threadloom.plans import providers, session, workflows
from threadloom.sources import archive_json, zip_export


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="threadloom")
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, needs in (("inspect", ["export"]), ("ingest", ["export", "output"]), ("compile", ["export", "output"]), ("semantic-local", ["export", "output"]), ("run-local", ["export", "output"]), ("verify", ["output"])):
        command = commands.add_parser(name)
        for need in needs:
            command.add_argument(need)
        if name in ("inspect",):
            command.add_argument("--hash-members", action="store_true")
        if name in ("ingest",):
            command.add_argument("--strict", action="store_true")
        if name in ("compile", "run-local"):
            command.add_argument("--mode", choices=("complete", "yearly", "monthly"), default="yearly")
        if name in ("semantic-local", "run-local"):
            command.add_argument("--max-conversations", type=int)
            command.add_argument("--max-leaf-categories", type=int, default=64)
        if name == "run-local":
            command.add_argument("--professional-safe", action="store_true")
    return parser


def main(arguments: list[str] | None = None) -> int:
    """Errors print their kind and a message without content."""
    args = _parser().parse_args(arguments)
    spark = session.session(master=args.master)
    try:
        if args.command == "inspect":
            print(json.dumps(zip_export.manifest(spark, args.export, hash_members=args.hash_members), indent=2, sort_keys=True))
        elif args.command == "ingest":
            frames = workflows.ingest(spark, args.export, strict=args.strict)
            archive_json.write_archive(frames, frames["manifest"], args.output)
        elif args.command == "compile":
            workflows.compile_volumes(workflows.ingest(spark, args.export), args.output, workflows.VolumeOptions(mode=args.mode))
        elif args.command == "semantic-local":
            options = workflows.AtlasOptions(max_conversations=args.max_conversations, max_leaf_categories=args.max_leaf_categories)
            relations = workflows.atlas(workflows.ingest(spark, args.export), providers.LocalEmbeddings(), providers.LocalAnalyses(), options)
            workflows.export_atlas(relations, args.output)
        elif args.command == "run-local":
            options = workflows.AtlasOptions(max_conversations=args.max_conversations, max_leaf_categories=args.max_leaf_categories)
            workflows.run(spark, args.export, args.output, options, workflows.VolumeOptions(mode=args.mode), publish_safe=args.professional_safe)
        else:
            problems = workflows.verify(spark, Path(args.output))
            for path, problem in problems:
                print(f"{problem}: {path}")
            return int(bool(problems))
    except (S.ArchiveError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
