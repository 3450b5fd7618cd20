"""The steps from labelled posts to a monitored classifier, as commands.

    spark-submit valence/__main__.py split  --posts P --train T --live L
    ...          train   --posts T --model M
    ...          publish --posts L --path Q          (or --format kafka --option topic=... )
    ...          score   --path Q --model M --store S --checkpoint C [--until-empty]
    ...          report  --store S
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

if __package__ in (None, ""):  # run as a file rather than with -m
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from valence.operators import classify, curves, metrics, split  # noqa: E402
from valence.operators.latest import MONITORED_ROWS, latest_n  # noqa: E402
from valence.sources.csvfiles import LATIN_1, read_posts, read_posts_and_rejects, write_posts  # noqa: E402
from valence.sources.messages import (  # noqa: E402
    MESSAGE_SCHEMA,
    message_stream,
    publish,
    to_messages,
)
from valence.sources.store import STORE_SCHEMA, read_store  # noqa: E402
from valence.streaming.replay import write_replay  # noqa: E402
from valence.streaming.scoring import (  # noqa: E402
    UNTIL_EMPTY,
    scored_stream,
    start_sink,
    start_store,
    start_versioned_store,
)

# Messages carry the id of the post, and records of a topic their place in it.
_MESSAGE = T.StructType([*MESSAGE_SCHEMA.fields, T.StructField("id", T.LongType())])
_STORE = T.StructType([*STORE_SCHEMA.fields, T.StructField("id", T.LongType())])
_TOPIC_ORDER = ("partition", "offset")


def _posts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The posts, as a table. Lines that do not fit are counted, and kept where ``--rejects`` says."""
    line_sep = None if a.any_line_end else "\n"
    posts, rejects = read_posts_and_rejects(
        spark, a.posts, a.encoding, multi_line=not a.single_line, line_sep=line_sep
    )
    print(f"{a.posts}: {rejects.count()} lines rejected")
    if a.post_rejects:
        rejects.write.mode("overwrite").parquet(a.post_rejects)
    return posts


def split_posts(spark: SparkSession, a: argparse.Namespace) -> None:
    posts = _posts(spark, a)
    parts = split.exact_split(posts, "id", a.fraction, a.seed)
    for part, path in zip(parts, (a.train, a.live)):
        write_posts(split.seeded_shuffle(part, "id", a.seed), path, a.encoding)
        print(f"{path}: {read_posts(spark, path, a.encoding).count()} rows")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    posts = _posts(spark, a).select("id", "target", "text")
    parts = split.hash_split(posts, "id", [0.8, 0.2], a.seed)
    rows, held_out = [classify.training_view(p) for p in parts]
    print(f"rows for training: {rows.count()}, held out: {held_out.count()}")
    model = classify.fit(classify.classifier(label_order=a.label_order), rows)
    for f in classify.evaluate(model, held_out).collect():
        if f["n"]:
            text = "accuracy: %{accuracy:.2f}, error: %{error:.2f}"
            print(text.format(**f.asDict()), f"(most common class: %{f['majority']:.2f})")
    if a.versions:
        print(f"{a.model}: version {classify.save_version(model, a.model)}")
    else:
        classify.save_model(model, a.model)


def publish_posts(spark: SparkSession, a: argparse.Namespace) -> None:
    posts = _posts(spark, a)
    if a.path:
        write_replay(posts, a.path, seed=a.seed, keep=("id",))
    else:
        shuffled = split.seeded_shuffle(posts, "id", a.seed)
        publish(to_messages(shuffled, keep=("id",)), a.format, **_options(a.option))


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    options = _options(a.option) | ({"path": a.path} if a.path else {})
    raw = message_stream(spark, a.format, **options)
    keep = tuple(c for c in _TOPIC_ORDER if c in raw.columns)
    trigger = UNTIL_EMPTY if a.until_empty else None
    if a.interval and not a.until_empty:
        trigger = {"processingTime": a.interval}
    if a.versions:
        names = tuple(a.names)
        start_versioned_store(raw, a.model, a.store, a.checkpoint, _MESSAGE, keep, names, trigger).awaitTermination()
        return
    scored = scored_stream(raw, classify.load_model(a.model), _MESSAGE, keep, tuple(a.names))
    if a.sink:
        query = start_sink(
            scored, a.sink, _options(a.sink_option), a.checkpoint, a.rejects or f"{a.checkpoint}-rejects", trigger
        )
    else:
        query = start_store(scored, a.store, a.checkpoint, trigger, a.echo)
    query.awaitTermination()


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    store = read_store(spark, a.store, _STORE)
    latest = latest_n(store, *a.order, n=a.rows).cache()  # at most a.rows records
    series = curves.accuracy_curves(latest, *a.order)
    _print("headline", metrics.kpi_snapshot(store, latest, *a.order))
    _print("confusion matrix", metrics.confusion_matrix(latest))
    _print("predictions", metrics.prediction_share(latest))
    _print("axis ranges", curves.curve_bounds(series))
    if a.curves:
        columns = [*a.order, "step", *curves.CURVES]
        series.select(*dict.fromkeys(columns)).write.mode("overwrite").parquet(a.curves)


def _print(title: str, df: DataFrame) -> None:
    print(title)
    df.show(truncate=False)


def _options(pairs: list[str]) -> dict[str, str]:
    return dict(pair.split("=", 1) for pair in pairs)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="valence")
    commands = parser.add_subparsers(required=True)

    def command(name, run, *needed):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--encoding", default=LATIN_1)
        if "model" in needed:
            p.add_argument("--versions", action="store_true", help="--model has numbered versions, of which the newest is current")
        if "posts" in needed:
            p.add_argument("--any-line-end", action="store_true", help="also \\r\\n or \\r ends a line")
            p.add_argument("--single-line", action="store_true", help="no text has a line break; large files are split")
            p.add_argument("--post-rejects", help="where to keep the lines that do not fit the schema")
        return p

    p = command("split", split_posts, "posts", "train", "live")
    p.add_argument("--fraction", type=float, default=0.8)

    p = command("train", train, "posts", "model")
    p.add_argument("--label-order", default="alphabetAsc")

    p = command("publish", publish_posts, "posts")
    p.add_argument("--path")
    p.add_argument("--format", default="text")
    p.add_argument("--option", action="append", default=[], metavar="NAME=VALUE")

    p = command("score", score, "model", "checkpoint")
    p.add_argument("--store")
    p.add_argument("--path")
    p.add_argument("--format", default="text")
    p.add_argument("--option", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--sink", help="a batch format to append to, instead of --store")
    p.add_argument("--sink-option", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--rejects", help="store for records that are not scored (with --sink)")
    p.add_argument("--interval", help='time between micro-batches, e.g. "1 second"')
    p.add_argument("--until-empty", action="store_true")
    p.add_argument("--echo", action="store_true")
    p.add_argument("--names", nargs=2, default=["NEGATIVE", "POSITIVE"])

    p = command("report", report, "store")
    p.add_argument("--order", nargs="+", default=["batch_id", "id"])
    p.add_argument("--rows", type=int, default=MONITORED_ROWS)
    p.add_argument("--curves", help="where to write the accuracy curves")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    args.run(SparkSession.builder.appName("valence").getOrCreate(), args)


if __name__ == "__main__":
    main()
