"""python -m starloom run [--root DIR] [--batch-id ID] [--phase NAME] [--rules FILE] [--sources FILE] | status [--root DIR]"""

from __future__ import annotations

import argparse
import json
import sys

from starloom.plans.warehouse import PHASES, PipelineError, Settings, run_pipeline, runs
from starloom.session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("starloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "status"):
        p = commands.add_parser(name)
        p.add_argument("--root", default="data")
        if name == "run":
            p.add_argument("--batch-id")
            p.add_argument("--phase", choices=PHASES)
            for option in ("rules", "sources", "transforms", "survivorship"):
                p.add_argument(f"--{option}")
    a = parser.parse_args(argv)
    spark = get_session()
    if a.command == "status":
        for r in sorted(runs(spark, Settings(a.root)), key=lambda r: r["started_at"], reverse=True)[:5]:
            print(r["batch"], r["status"], r["started_at"], r["finished_at"])
        return 0
    try:
        done = run_pipeline(spark, Settings(a.root, a.rules, a.transforms, a.survivorship, a.sources), a.batch_id, a.phase)
    except PipelineError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps({"batch": done.batch, "status": done.status}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
