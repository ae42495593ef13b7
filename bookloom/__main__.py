"""python -m bookloom RUN_DIR TOKEN...: the report of a run's evidence, and its comparison with a baseline's summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from bookloom.plans import analyze, config, report
from bookloom.sources import evidence


def main() -> None:
    p = argparse.ArgumentParser(prog="bookloom", description=__doc__)
    p.add_argument("run_dir")
    p.add_argument("tokens", nargs="+")
    p.add_argument("--baseline", help="summary document of an earlier run")
    p.add_argument("--json", action="store_true", help="print the summary document instead of the report")
    p.add_argument("--out", help="write summary.json (once) and report.md below this folder instead of printing")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = {"run_id": a.run_dir.rstrip("/").rsplit("/", 1)[-1], "software": config.provenance()} | config.subscription_metadata(tuple(a.tokens))
    before = None
    if a.baseline:
        before, digest = evidence.read_document(spark, a.baseline)
        run |= {"baseline_run_id": before["run"].get("run_id"), "baseline_summary_path": a.baseline, "baseline_summary_sha256": digest}
    s = analyze.summarize(spark, a.run_dir, run, tuple(a.tokens))
    text = report.render(s) + ("\n" + report.compare(before, s) if before else "")
    if a.out:
        evidence.write_once(spark, f"{a.out}/summary.json", s)
        evidence.write_text(spark, f"{a.out}/report.md", text, replace=True)
    else:
        print(evidence.canonical_text(s) if a.json else text)


if __name__ == "__main__":
    main()
