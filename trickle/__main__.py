"""Command-line job: maintain Q3 over change-log files and write the result.

    python -m trickle INPUT OUTPUT [--emit changelog|final] [--mode signed|recompute|stream]
                      [--date 1995-03-13] [--segment AUTOMOBILE] [--seq position|field]
                      [--on-error fail|dead_letter] [--checkpoint DIR] [--follow]

Like the reference's job (input path, output folder): reads the change-log
text files under INPUT, replaces OUTPUT with result lines
``Order{orderKey=.., orderDate=.., shipPriority=.., revenue=..}`` — by
default every running value (``changelog``), or the final view — and prints
the elapsed time. ``--mode stream`` reads the files under INPUT that its
checkpoint has not seen (with ``--follow`` also those that arrive later) and
adds to OUTPUT: result lines under ``lines/``, changelog rows under ``log/``, the
state and view under ``state/``. On a cluster: ``spark-submit trickle/__main__.py INPUT
OUTPUT`` with the package shipped (``--py-files``); the master and resources
come from the submit options.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from trickle.operators import recompute, signed
from trickle.operators.route import SEQ_FIELD, SEQ_POSITION
from trickle.plans import ivm
from trickle.plans.spec import DEFAULT_DATE, DEFAULT_SEGMENT, Q3Spec
from trickle.sources import sink


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m trickle", description=__doc__.split("\n\n")[0])
    ap.add_argument("input", help="folder (or file) of change-log text files")
    ap.add_argument("output", help="result folder; replaced if it exists")
    ap.add_argument("--emit", choices=["changelog", "final"], default="changelog")
    ap.add_argument("--mode", choices=["signed", "recompute", "stream"], default="signed")
    ap.add_argument("--date", default=DEFAULT_DATE)
    ap.add_argument("--segment", default=DEFAULT_SEGMENT)
    ap.add_argument("--seq", choices=[SEQ_FIELD, SEQ_POSITION], default=SEQ_POSITION,
                    help="position: the reference's format (order = file position); "
                         "field: seq is the last field of every record")
    ap.add_argument("--on-error", choices=["fail", "dead_letter"], default="fail",
                    help="dead_letter: malformed records are written beside the result "
                         "(OUTPUT-dead-letter) instead of failing the job")
    ap.add_argument("--checkpoint", help="stream mode: checkpoint folder; a used one is resumed")
    ap.add_argument("--follow", action="store_true",
                    help="stream mode: go on with files as they arrive, until stopped")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("trickle").getOrCreate()
    spec = Q3Spec(date=args.date, segment=args.segment)
    start = time.perf_counter()
    if args.mode == "stream":
        from trickle.streaming import q3_stream

        if not args.checkpoint:
            ap.error("--mode stream needs --checkpoint: a folder that stays between runs")
        query = q3_stream.start(
            spark, args.input, args.checkpoint, args.output, spec, available_now=not args.follow,
            seq_mode=args.seq, on_error=args.on_error, text=args.emit == "changelog",
        )
        query.awaitTermination()
        if args.emit == "final":
            sink.write_text(q3_stream.latest_view(spark, args.output), f"{args.output}/view")
    else:
        r = ivm.staged(spark.read.text(args.input), spec, args.on_error, args.seq)
        li, od, cu = r.lineitem, r.orders, r.customer
        if args.emit == "changelog":
            if args.mode != "signed":
                ap.error("--emit changelog is computed by --mode signed")
            result = signed.changelog(signed.join2_deltas(li, signed.join1_deltas(od, cu)))
        elif args.mode == "recompute":
            result = recompute.recompute_view(li, od, cu)
        else:
            result = signed.final_view(li, od, cu)
        sink.write_text(result, args.output)
        if args.on_error == "dead_letter":
            dead = args.output.rstrip("/") + "-dead-letter"
            r.dead_letter.write.mode("overwrite").json(dead)
    print(f"Job running time: {round((time.perf_counter() - start) * 1000)} milliseconds")


if __name__ == "__main__":
    main()
