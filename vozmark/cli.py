"""Command line: extract, markers, phonemes, annotations, corpora."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vozmark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "markers", "phonemes"):
        s = sub.add_parser(name)
        s.add_argument("directory")
        s.add_argument("--model", help="ONNX recogniser; without one, a stand-in")
        s.add_argument("--vocabulary", required=True)
        s.add_argument("--out")
        if name == "extract":
            s.add_argument("--features", default="formants,mfcc")
    s = sub.add_parser("annotations")
    s.add_argument("--csv")
    s.add_argument("--db")
    s.add_argument("--marker")
    s.add_argument("--value")
    s.add_argument("--rows", action="store_true")
    s.add_argument("--include-auto", action="store_true")
    s.add_argument("--out")
    s = sub.add_parser("corpora")
    s.add_argument("--large", action="store_true")
    s.add_argument("--out")
    return p


def give(value, out: str | None) -> None:
    text = json.dumps(value, ensure_ascii=False, indent=2, default=str)
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .infer import FakeRecognizer, OnnxRecognizer
    from .operators import labels as L
    from .pipeline import FeaturePipeline
    from .sources import audio, corpora, tables

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("vozmark").getOrCreate()
    if args.command == "corpora":
        rows = corpora.registry(spark).where(F.lit(args.large) | ~F.col("large"))
        give([r.asDict() for r in rows.orderBy("name").collect()], args.out)
        return 0
    if args.command == "annotations":
        rows = tables.load_annotations(spark, args.db, args.csv) if args.db or not args.csv else tables.read_annotations(spark, args.csv)
        rows = L.visible(rows, args.include_auto)
        if not args.rows:
            rows = L.latest_fold(rows, "speaker", L.MARKERS, "updated_at")
        if args.marker:
            rows = L.choose_rows(rows, args.marker, args.value)
        give([r.asDict() for r in rows.orderBy("speaker").collect()], args.out)
        return 0
    utterances = audio.read_utterances(spark, args.directory).where("error IS NULL")
    model = OnnxRecognizer(args.model) if args.model else FakeRecognizer()
    pipe = FeaturePipeline(model, tables.read_vocabulary(spark, args.vocabulary))
    if args.command == "extract":
        got = pipe.extract(utterances, args.features.split(","))
        if args.out:
            tables.write_features(got, args.out)
        else:
            give([r.asDict() for r in got.orderBy("speaker", "feature").collect()], None)
        return 0
    frames = pipe.frames(utterances)
    if args.command == "markers":
        rows = [r.asDict() for r in pipe.markers(frames).orderBy("utt_id", "frame", "marker").collect()]
        give({"n_markers": len(rows), "markers": rows}, args.out)
    else:
        rows = pipe.phonemes(frames).orderBy("utt_id").collect()
        give([{"utt_id": r["utt_id"], "n_tokens": len(r["sequence"]), "phonemes": " ".join(r["sequence"])} for r in rows], args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
