"""The command line: python -m echolex fix | explain | train-gate | sweep | info."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators import correction, gate, hallucination, lattice, rendering, sweeps
from echolex.sources import glossaries, pairs


def _kanji(spark: SparkSession, path: str | None) -> DataFrame:
    """kanji, readings: JSON lines, or none."""
    schema = "kanji string, readings array<string>"
    return spark.read.schema(schema).json(path) if path else spark.createDataFrame([], schema)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    if path == "-":
        return spark.createDataFrame([("stdin", sys.stdin.read())], "doc_id string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def _model(path: str | None) -> CostModel:
    return CostModel.from_dict(json.loads(Path(path).read_text("utf-8"))) if path else DEFAULT


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="echolex", description="Corrects transcripts to a glossary, within phonetic bounds.")
    of = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, transcripts: bool = False, trained: bool = False) -> argparse.ArgumentParser:
        p = of.add_parser(name, help=text)
        if transcripts:
            p.add_argument("transcript", help="a file or folder of texts, or - for standard input")
        if trained:
            p.add_argument("--pairs", required=True)
        p.add_argument("--glossary", "-g", required=trained)
        p.add_argument("--kanji", help="readings of kanji, JSON lines of kanji and readings")
        p.add_argument("--phonetic-config", help="JSON object of the phonetic model's settings; what it does not name stays as it is")
        p.add_argument("--tau", type=float, default=0.28)
        p.add_argument("--output", "-o", default="-")
        return p

    for name, text in (("fix", "correct texts"), ("explain", "the evidence for every candidate edit")):
        p = command(name, text, transcripts=True)
        p.add_argument("--gate")
        p.add_argument("--gate-threshold", type=float, default=0.5)
        p.add_argument("--max-span-tokens", type=int, default=8)
        p.add_argument("--lexicon", help="words with parts of speech and costs for a reader, JSON lines of surface, readings, pos, pos2, cost, left, right")
        p.add_argument("--reader", choices=sorted(lattice.READERS), default="characters", help="how texts become tokens")
        p.add_argument("--json", action="store_true", help="JSON lines, else the text itself (fix) or HTML (explain)")
        p.add_argument("--keep-hallucinations", action="store_true")
    p = command("train-gate", "fit and calibrate the gate", trained=True)
    p.add_argument("--negative-weight", type=float, default=3.0)
    p.add_argument("--max-damage-rate", type=float, default=0.01)
    command("sweep", "operating points over thresholds", trained=True).add_argument("--gate")
    of.add_parser("info", help="versions and settings")
    return top


def _write(rows: DataFrame, path: str, column: str | None = None) -> None:
    """JSON lines, or one column as text: to a folder, or for a few rows to standard output."""
    if path != "-":
        (rows.write.mode("overwrite").json(path) if column is None else rows.select(column).write.mode("overwrite").text(path))
        return
    for r in rows.toJSON().toLocalIterator() if column is None else rows.select(column).toLocalIterator():
        print(r if column is None else r[0] or "")


def _tokens(spark: SparkSession, docs: DataFrame, a: argparse.Namespace, kanji: DataFrame) -> DataFrame:
    schema = "surface string, readings array<string>, pos string, pos2 string, cost int, left int, right int"
    lexicon = spark.read.schema(schema).json(a.lexicon) if a.lexicon else spark.createDataFrame([], schema)
    return lattice.reader(a.reader)(docs, lexicon, kanji)


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "info":
        print(json.dumps({"spark": spark.version, "cores": spark.sparkContext.defaultParallelism, "master": spark.sparkContext.master}))
        return 0
    kanji = _kanji(spark, a.kanji)
    empty = spark.createDataFrame([], "entry_id long, surface string, reading string, aliases array<string>, category string, weight double, notes string")
    glossary = glossaries.with_readings(glossaries.read(spark, a.glossary, kanji) if a.glossary else empty)
    model = _model(a.phonetic_config)
    own = gate.load(a.gate) if getattr(a, "gate", None) else gate.Gate()
    if a.command in ("fix", "explain"):
        config = correction.CorrectionConfig(tau=a.tau, gate=a.gate_threshold, most_tokens=a.max_span_tokens, remove_hallucinations=not a.keep_hallucinations, model=model)
        docs = _texts(spark, a.transcript)
        if a.reader == "characters":  # no parts of speech
            config = replace(config, has_pos=False, rendaku=True)
        if a.command == "fix":
            if config.remove_hallucinations:
                docs = hallucination.remove(docs, hallucination.find(docs, hallucination.FilterConfig(model=model)))
            _write(correction.correct(docs, _tokens(spark, docs, a, kanji), glossary, config, own), a.output, None if a.json else "text")
        else:
            found = correction.explain(docs, _tokens(spark, docs, a, kanji), glossary, config, own)
            _write(found if a.json else rendering.evidence(found).orderBy("doc_id", F.desc("accepted"), "start", "end"), a.output, None if a.json else "html")
        return 0
    rows = pairs.read(spark, a.pairs).withColumnRenamed("id", "doc_id")
    terms = glossary.select(F.col("surface").alias("term"))
    propose = sweeps.proposer(rows, glossary, kanji, own)
    if a.command == "sweep":
        _write(sweeps.operating_points(rows, propose(correction.CorrectionConfig(tau=a.tau, model=model)), terms, 100), a.output)
        return 0
    decisions = sweeps.training_rows(rows, propose(replace(sweeps.WIDE, model=model)))
    fitted = gate.fit(decisions, ["doc_id", "start", "end"], gate.FitConfig(negative_weight=a.negative_weight))
    points = sweeps.operating_points(rows, sweeps.proposer(rows, glossary, kanji, fitted)(correction.CorrectionConfig(tau=a.tau, model=model)), terms, 100)
    fitted = replace(fitted, threshold=gate.pick_threshold(points, a.max_damage_rate).first()["threshold"])
    if a.output == "-":
        print(json.dumps(asdict(fitted), ensure_ascii=False))
    else:
        fitted.save(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
