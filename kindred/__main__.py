"""``python -m kindred COMMAND [--config FILE]``: jobs over the stores that a configuration names.

images PATH, video PATH, live PATH and schedule need an embedder, capture a decoder where files aren't bitmaps; both are
named as ``module:function``. A live or capture path is a folder of Parquet files to which frames or faces are added."""

from __future__ import annotations

import argparse
import importlib
import json
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession

from kindred import config
from kindred.plans.jobs import Engine
from kindred.plans.schedule import State, Supervisor
from kindred.sources import images, manifests

FRAMES = "session string, frame_idx long, stream_time double, content binary"
FACES = "id long, source string, frame_idx int, bbox struct<x1:double,y1:double,x2:double,y2:double>, det_score double, quality double, embedding array<float>"


def named(name: str | None) -> Callable | None:
    """The function that ``module:function`` names."""
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run(args: argparse.Namespace, cfg: config.Config, spark: SparkSession) -> object:
    embed, decode = named(args.embedder), named(args.decoder) or images.raw_decoder
    if args.command in ("images", "video", "live") and embed is None and args.command != "live":
        raise SystemExit(f"{args.command} needs --embedder module:function")
    if args.command == "dataset":
        return manifests.totals(spark, cfg.acquisition.dir).first().asDict()
    if args.min_cluster_size is not None:
        cfg.clustering.min_cluster_size = args.min_cluster_size
    if args.stride is not None:
        cfg.video.frame_stride = args.stride
    engine = Engine(spark, cfg)
    if args.command == "schedule":
        capture = lambda seconds: engine.capture(spark.read.schema(FRAMES).parquet(args.path), args.label, decode).collect()
        analyze = lambda: engine.analysis(cfg.acquisition.dir, embed, decode)
        own = Supervisor(cfg.schedule, State(spark, f"{cfg.output.dir}/schedule.json"), capture, analyze, datetime.now, time.sleep)
        if args.status:
            return own.status()
        if embed is None:
            raise SystemExit("schedule needs --embedder module:function")
        return own.analyze_now() if args.analyze_now else own.run(args.cycles)
    if args.command == "images":
        return engine.images(args.path, embed, decode, args.reset)
    if args.command == "video":
        return engine.videos(args.path, named(args.reader), embed, args.reset)
    if args.command == "capture":
        return [r.asDict() for r in engine.capture(spark.read.schema(FRAMES).parquet(args.path), args.label, decode, embed).toLocalIterator()]
    if args.command == "live":
        from kindred.streaming.live import Live, faces_from

        job = Live(engine, args.recluster_every, time.time)
        try:
            job.start(faces_from(spark, args.path, FACES), f"{cfg.output.dir}/live", args.once).awaitTermination()
        finally:
            job.drain()
        return engine.health()
    if args.command == "serve":
        from kindred.plans.service import Service

        Service(engine, embed, decode).server(args.host or cfg.api.host, cfg.api.port if args.port is None else args.port).serve_forever()
    if args.command == "recluster":
        return engine.recluster()
    if args.command == "train":
        return engine.train().__dict__
    table = {"persons": engine.persons_table, "clusters": engine.clusters, "metrics": engine.metrics}[args.command]()
    return [r.asDict() for r in table.toLocalIterator()]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kindred", description=__doc__)
    out.add_argument("command", choices=["images", "video", "live", "capture", "schedule", "serve", "recluster", "train", "persons", "clusters", "metrics", "dataset"])
    out.add_argument("path", nargs="?")
    out.add_argument("--config")
    for name in ("embedder", "decoder", "reader", "label", "host"):
        out.add_argument(f"--{name}")
    for name in ("stride", "min-cluster-size", "port"):
        out.add_argument(f"--{name}", type=int)
    out.add_argument("--recluster-every", type=int, default=300)
    out.add_argument("--cycles", type=int, default=0)
    for name in ("reset", "status", "analyze-now", "once"):
        out.add_argument(f"--{name}", action="store_true")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    print(json.dumps(run(args, config.load(args.config), spark), default=str))


if __name__ == "__main__":
    main()
