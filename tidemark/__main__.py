"""python -m tidemark diff|replay|explain|watch|pause|resume|version: exit codes 0 agreement, 1 failure, 2 bad specification, 3 disagreement."""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.1.0"


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description="Compare a store with what its change events say it holds.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("diff", "replay", "explain", "watch"):
        c = sub.add_parser(name)
        c.add_argument("--spec", required=True)
        c.add_argument("--events", required=True)
        c.add_argument("--store", required=name != "watch")
        c.add_argument("--output", choices=("text", "json"), default="text")
        if name != "watch":
            c.add_argument("--at", help="when the store was read, as an SQL expression; now by default")
        if name == "explain":
            c.add_argument("key")
        if name == "watch":
            c.add_argument("--folder", required=True)
            c.add_argument("--once", action="store_true", help="take what is there, sweep, and end")
    for name in ("pause", "resume"):
        sub.add_parser(name).add_argument("--folder", required=True, help="the folder of a running watch")
    sub.add_parser("version")
    a = p.parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    from tidemark.plans import config, run

    if a.command in ("pause", "resume"):
        from pyspark.sql import SparkSession

        from tidemark.streaming.watch import Watch

        getattr(Watch(SparkSession.builder.getOrCreate(), a.folder, config.Spec()), a.command)()
        return 0
    try:
        spec = config.load(open(a.spec, encoding="utf-8").read())
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    for w in spec.warnings():
        print(f"warning: {w}", file=sys.stderr)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "watch":
        from tidemark.operators import reconcile
        from tidemark.sources import files, frames
        from tidemark.streaming.watch import Watch

        audit = Watch(spark, a.folder, spec, a.store)
        options = {k: v for k, v in spec.source.items() if k in frames.DEFAULTS}
        rows = frames.frame_stream(spark, a.events, **options) if spec.source["type"] == "frames" else files.line_stream(spark, a.events)
        audit.start(rows, a.once).awaitTermination()
        for line in audit.status():
            print(json.dumps(line, default=str))
        if not a.store:
            return 0
        for r in reconcile.report(audit.findings()).collect():
            print(f"{r.category:<20}{r.n:>8}  suspect {r.suspect}")
        return 3 if audit.findings().filter("trust <> 'suspect'").count() else 0
    result = run.compare(spark, spec, a.events, a.store, a.at)
    if a.command == "explain":
        print(json.dumps(run.explanation(result, a.key), default=str) if a.output == "json" else run.explain_key(result, a.key))
        return 0
    print(result.json() if a.output == "json" else result.text())
    return 3 if result.alertable else 0


if __name__ == "__main__":
    sys.exit(main())
