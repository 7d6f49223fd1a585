"""Command line: python -m gristmill.cli -i FOLDER -o FOLDER [-t THRESHOLD] [--skip-semantic] ..."""

from __future__ import annotations

import argparse
import logging
import sys
from functools import partial

from .errors import EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristmill", description="Removes duplicate content from a folder of Markdown files.")
    p.add_argument("-i", "--input-dir", required=True)
    p.add_argument("-o", "--output-dir", required=True)
    p.add_argument("-d", "--decisions", help="folder of the store with earlier decisions; new ones are put there")
    p.add_argument("-t", "--threshold", type=float, default=0.80)
    p.add_argument("--skip-semantic", action="store_true")
    p.add_argument("--encoder", help="module:function that turns a list of texts into vectors; without one, no similar pairs are looked for")
    p.add_argument("--merge-code", action="store_true")
    p.add_argument("--prefilter", choices=["strict", "keep_first"])
    p.add_argument("--style", choices=["basic", "rich"], default="basic")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"])
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s - %(name)s - %(levelname)s - %(message)s")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .metrics import Metrics
    from .operators import encoding, render, semantic
    from .plans.pipeline import Config, analyse
    from .store import Store

    try:
        spark = SparkSession.builder.appName("gristmill").getOrCreate()
        named = args.encoder and not args.skip_semantic
        encoder = encoding.Loader(args.encoder, partial(semantic.load_encoder, args.encoder)) if named else None
        config = Config(args.input_dir, args.output_dir, args.threshold, args.skip_semantic, args.merge_code, prefilter=args.prefilter, style=args.style, encoder=encoder)
        store = Store(spark, args.decisions) if args.decisions else None
        log, metrics = logging.getLogger("gristmill"), Metrics()
        with metrics.timed("analyse"):
            found = analyse(spark, config, decisions=store.read("block_decisions") if store else None, metrics=metrics)
        if found.semantic_skipped:
            log.warning("no similar pairs are looked for, as the encoder can't be loaded: %s", found.semantic_skipped)
        if store:
            store.upsert("block_decisions", found.blocks.select("path", "block_id", "block_type", "decision", F.current_timestamp().alias("decided_at")))
        with metrics.timed("write"):
            render.write(found.rendered())
        log.info("%s %s", metrics.stages(), metrics.operations())
        print(found.status().first().asDict())
    except EngineError as e:
        logging.getLogger("gristmill").error("%s (%s) %s", e, e.number, e.details)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
