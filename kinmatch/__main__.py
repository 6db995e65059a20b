"""Command lines: link, validate, profile.

    python -m kinmatch link --sources S1.tsv S2.tsv S3.tsv --truth TRUTH.tsv --out DIR
    python -m kinmatch validate --result RESULT.tsv --entries S1.tsv
    python -m kinmatch profile --sources S1.tsv S2.tsv S3.tsv
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinmatch.operators import quality
from kinmatch.plans import flow
from kinmatch.plans.queries import View
from kinmatch.sources import io

HEADER = ["source1_entity_id", "matched_entity_ids"]


def _records(spark: SparkSession, paths: list[str]):
    return io.read_sources(spark, dict(enumerate(paths, 1)))


def numbered(spark: SparkSession, path: str):
    """n, line of a result file; the header is 0.  A line's number is its place in its partition and how many lines lie before that."""
    lines = io.read_lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    before = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    sizes = dict(map(tuple, before))
    begin = F.create_map(*[F.lit(x) for p in sizes for x in (p, sum(n for q, n in sizes.items() if q < p))]) if sizes else F.create_map().cast("map<bigint,bigint>")
    return lines.select((begin[part] + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("n"), "line")


def link(spark: SparkSession, args) -> int:
    """Candidates, model, decision; candidates, results, report and model under --out."""
    truth = io.read_truth(io.read_tsv(spark, args.truth, io.TRUTH))
    view = View(spark, records=_records(spark, args.sources), truth=truth)
    linked = flow.run(view)
    io.write_lists(view.entries, linked.chosen, "matched_entity_ids", f"{args.out}/results")
    io.write_lists(view.entries, view.cand, "candidate_entity_ids", f"{args.out}/candidates")
    linked.model.write().overwrite().save(f"{args.out}/model")
    io.write_json(spark, linked.report.first().asDict(), f"{args.out}/report")
    linked.report.show(truncate=False)
    return 0


def validate(spark: SparkSession, args) -> int:
    """Faults of a result file; 1 if it has any."""
    lines = numbered(spark, args.result)
    entries = io.read_tsv(spark, args.entries).select(F.col("entity_id").alias("s1"))
    faults = quality.messages(quality.row_errors(lines), "error", "n")
    listed = lines.filter("n > 0").select(F.split("line", "\t")[0].alias("s1"))
    head, missing = quality.header_checks(lines, HEADER).filter("failed > 0"), quality.completeness(listed, entries)
    for found in (head, faults, missing.groupBy("kind").count()):
        found.show(truncate=False)
    return int(not (head.isEmpty() and faults.isEmpty() and missing.isEmpty()))


def profile(spark: SparkSession, args) -> int:
    records = _records(spark, args.sources)
    quality.source_profile(records).show(truncate=False)
    quality.country_profile(records).show(truncate=False)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinmatch", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    for f, names in ((link, ("sources", "truth", "out")), (validate, ("result", "entries")), (profile, ("sources",))):
        sub = commands.add_parser(f.__name__, help=f.__doc__)
        for n in names:
            sub.add_argument(f"--{n}", required=True, nargs=3 if n == "sources" else None)
        sub.set_defaults(run=f)
    args = parser.parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("kinmatch").getOrCreate(), args)


if __name__ == "__main__":
    raise SystemExit(main())
