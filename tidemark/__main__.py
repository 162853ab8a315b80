"""python -m tidemark clean|inspect PATH... [--out-dir DIR] [--prefix P] [--json] | doctor"""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from pyspark.sql import functions as F

from tidemark.operators import inspection, reports
from tidemark.plans import hygiene
from tidemark.session import local_session
from tidemark.sources import files

TOOLS = ["exiftool", "ffmpeg", "ffprobe", "magick", "qpdf"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("command", choices=["clean", "inspect", "doctor"])
    parser.add_argument("paths", nargs="*")
    parser.add_argument("-o", "--out-dir")
    parser.add_argument("--prefix", default="clean-")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        found = {t: bool(shutil.which(t)) for t in TOOLS}
        print("\n".join(f"{t}: {'found' if ok else 'missing'}" for t, ok in found.items()))
        return 0 if all(found.values()) else 2
    if not args.paths:
        parser.print_usage(sys.stderr)
        return 2
    spark = local_session()
    scanned = files.scan(spark, args.paths[0])
    for path in args.paths[1:]:
        scanned = scanned.unionByName(files.scan(spark, path))
    if args.command == "inspect":
        kinds = scanned.withColumn("kind", F.coalesce(hygiene.containers.container_kind(F.col("name"), F.col("content")), hygiene.browser_kind(F.col("name"), F.col("content"))))
        rows = inspection.inspect(kinds).where("sensitive").join(scanned.select("file_id", "path"), "file_id").groupBy("path").agg(F.count("*").alias("fields"), F.array_sort(F.collect_set("category")).alias("categories"))
        for line in rows.orderBy("path").toLocalIterator():
            print(json.dumps(line.asDict()) if args.json else f"{line.path}: {line.fields} {', '.join(line.categories)}")
        return 0
    local = F.regexp_replace("path", "^file:/*", "/")
    done = hygiene.clean(scanned).join(scanned.select("file_id", local.alias("path")), "file_id").withColumn("output", reports.output_path(F.col("path"), args.prefix, args.out_dir))
    done = done.persist()
    files.write_copies(done)
    failed = 0
    for r in done.select("path", "output", "ok", "strategy", "removed_categories", "summary", "message").orderBy("path").toLocalIterator():
        failed += not r.ok
        print(json.dumps(r.asDict()) if args.json else f"{r.path} -> {r.output}: {r.summary}" if r.ok else f"{r.path}: {r.message}", file=sys.stdout if r.ok or args.json else sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
