"""The command line: each command reads UTF-8 files as one table and prints JSON.

``analyze``, ``grade``, ``critique``, ``compare``, ``judge``, ``improve``, ``verify`` and ``profiles``. ``judge`` and
``improve`` end with 1 where nothing is accepted, ``verify`` where an artifact does not replay.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from glossa.sources import files
from glossa.sources.profiles import load_profile, read_profile
from glossa.sources.policies import POLICIES


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("glossa").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _profile(name: str):
    return read_profile(name) if name.endswith(".json") else load_profile(name)


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not text.strip():
        raise SystemExit(f"{path}: the text is empty")
    return text


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _documents(paths: list[str]) -> DataFrame:
    return _session().createDataFrame([(p, _text(p)) for p in paths], "doc_id string, text string")


def _analysis(paths: list[str], profile: str) -> dict:
    from glossa.operators import judging

    policy, docs = _profile(profile), _documents(paths)
    out = {"profile": {"name": policy.name, "version": policy.version, "sha256": policy.digest}, "documents": []}
    for r in sorted(_rows(judging.measured(docs, policy)), key=lambda r: r["doc_id"]):
        text = _text(r["doc_id"])
        out["documents"].append({"path": r["doc_id"], "sha256": hashlib.sha256(text.encode()).hexdigest(), "value": r["value"], "band": r["band"], "words": r["words"], "findings": r["findings"]})
    out["analysis_sha256"] = hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()
    return out


def _emit(args: argparse.Namespace, value: object, code: int = 0) -> int:
    if getattr(args, "output", None):
        files.guard_output(args.output, _inputs(args), [])
        files.write_json(value, args.output)
    else:
        json.dump(value, sys.stdout, indent=2, sort_keys=True, ensure_ascii=False)
        print()
    return code


def _inputs(args: argparse.Namespace) -> list[str]:
    given = [getattr(args, k, None) for k in ("input", "source", "candidate", "analysis")]
    return [p for g in given if g for p in (g if isinstance(g, list) else [g])]


def _pairs(args: argparse.Namespace) -> DataFrame:
    source = _text(args.source)
    return _session().createDataFrame([(i, source, _text(c)) for i, c in enumerate(args.candidate)], "pair_id int, source string, candidate string")


def _grade(args: argparse.Namespace) -> int:
    from glossa.operators import readability

    return _emit(args, _rows((readability.sentence_grades if args.sentences else readability.document_grades)(_documents(args.input))))


def _critique(args: argparse.Namespace) -> int:
    from glossa.operators import judging

    return _emit(args, _rows(judging.briefs(_documents(args.input), _profile(args.profile))))


def _compare(args: argparse.Namespace) -> int:
    from glossa.operators import claims

    return _emit(args, _rows(claims.compare_texts(_pairs(args))))


def _judge(args: argparse.Namespace) -> int:
    from glossa.operators import judging

    got = _rows(judging.judge(_pairs(args), _profile(args.profile), args.target_grade))
    return _emit(args, got, 0 if all(r["accepted"] for r in got) else 1)


def _improve(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from glossa.operators import judging

    attempts = _pairs(args).select(F.lit(args.source).alias("source_id"), F.col("pair_id").alias("index"), "source", "candidate")
    got = _rows(judging.improve(attempts, _profile(args.profile), args.max_attempts, args.target_grade))
    return _emit(args, got, 0 if all(r["accepted_index"] >= 0 for r in got) else 1)


def _verify(args: argparse.Namespace) -> int:
    """Analyse the artifact's documents again under its policy; equal digests replay."""
    with open(args.analysis, encoding="utf-8") as f:
        old = json.load(f)
    new = _analysis([d["path"] for d in old["documents"]], args.profile or old["profile"]["name"])
    same = new == old
    return _emit(args, {"replays": same, "was": old.get("analysis_sha256"), "is": new["analysis_sha256"]}, 0 if same else 1)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="glossa")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, run, *places: tuple[str, dict], profile: str | None = "architecture-review") -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=what)
        for place, options in places:
            made.add_argument(place, **options)
        if profile is not None:
            made.add_argument("--profile", default=profile or None, help="a shipped policy's name, or a .json file")
        made.add_argument("--output")
        made.set_defaults(run=run)
        return made

    texts, pair = ("input", {"nargs": "+"}), [("source", {}), ("--candidate", {"action": "append", "required": True})]
    grade = ("--target-grade", {"type": float, "dest": "target_grade"})
    command("analyze", "findings and scores", lambda a: _emit(a, _analysis(a.input, a.profile)), texts)
    command("grade", "readability estimates", _grade, texts, ("--sentences", {"action": "store_true"}), profile=None)
    command("critique", "a brief for a rewrite", _critique, texts)
    command("compare", "what a candidate changes in meaning", _compare, *pair, profile=None)
    command("judge", "verdicts on candidates", _judge, *pair, grade)
    command("improve", "the first candidate that is accepted", _improve, *pair, grade, ("--max-attempts", {"type": int, "default": 3, "dest": "max_attempts"}))
    command("verify", "replay an analysis", _verify, ("analysis", {}), profile="")
    command("profiles", "the shipped policies", lambda a: _emit(a, {n: {"version": load_profile(n).version, "sha256": load_profile(n).digest} for n in sorted(POLICIES)}), profile=None)
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)
