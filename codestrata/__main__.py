"""``python -m codestrata --target-dir DIR --config FILE --out DIR [--report NAME=PATH ...]``"""

from __future__ import annotations

import argparse
import logging
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from codestrata.config import ProjectConfig
from codestrata.plans.report import Project, run
from codestrata.plans.review import review, review_settings, review_status
from codestrata.session import SKEW
from codestrata.sources.files import scan_names
from codestrata.sources.sinks import TREE_SKIP, skeleton_blocks, skeletons, tree_lines, write_report

log = logging.getLogger("codestrata")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", filename=args.log)
    logging.captureWarnings(True)
    config = ProjectConfig.read(args.config)
    session = spark or SparkSession.builder.appName("codestrata").config(map=SKEW).getOrCreate()
    root = f"{args.target_dir.rstrip('/')}/{config.package_root}" if config.package_root else args.target_dir
    project = Project(session, root, config, dict(r.split("=", 1) for r in args.report), not args.contracts_failed, args.native)
    sections = run(project, datetime.now(tz=timezone.utc).isoformat())
    for name, reason in project.sources.errors.items():
        log.warning("source %s gave nothing: %s", name, reason)
    status, reason = review_status(config, project.candidates)
    if status == "ready":
        texts = project.rows().where("kind = 'class'").select("path", "cls", "text")
        try:
            sections.update(review(project.candidates, texts, project.findings, review_settings(config, args.config)))
        except Exception as exc:  # noqa: BLE001  the static report stands without the review
            status, reason = "error", str(exc)
    log.info("review: %s%s", status, f" ({reason})" if reason else "")
    if args.texts:
        files = project.files()
        sections["skeleton"] = skeleton_blocks(skeletons(files)).orderBy("path")
        sections["tree"] = tree_lines(scan_names(session, root, TREE_SKIP)).orderBy("place").select("line")
    write_report(sections, args.out)
    return 0


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="codestrata")
    parser.add_argument("--target-dir", required=True, help="folder that holds the package")
    parser.add_argument("--config", required=True, help="JSON configuration")
    parser.add_argument("--out", required=True, help="folder for the report sections")
    parser.add_argument("--report", action="append", default=[], help="complexity, maintainability, parameters, contracts or calls, as NAME=PATH")
    parser.add_argument("--contracts-failed", action="store_true", help="the contract checker returned an error code")
    parser.add_argument("--native", action="store_true", help="take complexity, maintainability, contracts and calls from the source where their report is missing")
    parser.add_argument("--texts", action="store_true", help="also write the skeleton and the tree")
    parser.add_argument("--log", help="log file")
    return parser


if __name__ == "__main__":
    raise SystemExit(main())
