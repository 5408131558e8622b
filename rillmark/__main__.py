"""python -m rillmark USE_CASE [rate=10000] [queries=4] [--seconds N] [--span MS] [--tables FOLDER] [--shared FOLDER] [--batch]

Runs a use case on generated events and prints its rows, the mean latency and the
count of events: YSB, YSBS, YSBM, YSBMS, YSBMQ, YSBMQS, Sliding, SlidingS and WA live for
--seconds seconds (or, with --batch, over as many seconds of events at once), and MAP,
MR and TPCH as batches.  --shared names the folder that all executors share (as
spark.checkpoint.dir does), for checkpoints and slices; a cluster needs one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rillmark.plans.usecases import BATCHES, STREAMS, Settings, batch, start


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("rillmark", description=__doc__.split("\n\n")[1])
    parser.add_argument("use_case", choices=[*STREAMS, *BATCHES], nargs="?", default="MAP")
    parser.add_argument("rate", type=int, nargs="?", default=10_000)
    parser.add_argument("queries", type=int, nargs="?", default=4)
    parser.add_argument("--seconds", type=int, default=60)
    parser.add_argument("--span", type=int, default=10_000)
    parser.add_argument("--tables")
    parser.add_argument("--shared")
    parser.add_argument("--batch", action="store_true")
    args = parser.parse_args(words)
    builder = SparkSession.builder.appName(f"rillmark {args.use_case}").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.config("spark.checkpoint.dir", args.shared) if args.shared else builder).getOrCreate()
    settings = Settings(args.rate, args.queries, args.seconds, args.span)
    if args.batch or args.use_case in BATCHES:
        batch(spark, args.use_case, settings, args.tables).show(25, truncate=False)
        return

    def show(rows, latency: float, events: int) -> None:
        rows.show(25, truncate=False)
        print(f"COUNT {events}  AVG_LATENCY {latency:.3f} s", flush=True)

    query = start(spark, args.use_case, settings, show)
    query.awaitTermination(args.seconds)
    query.stop()


if __name__ == "__main__":
    main()
