"""scan, clean, gate and report over files or folders of files.

Exit codes: scan gives 0 to 4 by the worst level, or 5 on an error; clean 0 or 5; gate 1 (safe), 2 (hidden text) or
3 (anything else); report 0 or 1.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, config
from .operators import reports, risk, sanitize, spans as span_ops
from .schema import STRATEGIES
from .sources import files, text_files

OK, FAILED = 0, 5


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Finds text that a reader cannot see.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--config", help="YAML file with thresholds")
    sub = p.add_subparsers(dest="command")
    for name in ("scan", "clean", "gate", "report"):
        one = sub.add_parser(name)
        one.add_argument("paths", nargs="+")
        one.add_argument("--verbose", "-v", action="store_true")
        one.add_argument("--ocr-tokens", help="Parquet table of OCR tokens with the paths of their files")
        if name == "clean":
            one.add_argument("--output", "-o", help="text file for the cleaned text; a folder of text files for several documents")
            one.add_argument("--strategy", choices=STRATEGIES, default="strip")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    argv = sys.argv[1:] if argv is None else argv
    if "--version" in argv:
        print(f"veilspark {__version__}")
        return OK
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return FAILED if e.code else OK
    if not args.command:
        parser.print_help()
        return OK
    if spark is None:
        from .session import session

        spark = session()
    settings = config.load(args.config) if args.config else config.DEFAULT
    failed = {"scan": FAILED, "clean": FAILED, "gate": 3, "report": 1}[args.command]
    try:
        found = files.load(spark, args.paths).cache()
        got = files.extracted(found, settings).cache()
        tokens = spark.read.parquet(args.ocr_tokens).withColumn("doc_id", F.xxhash64("path")) if args.ocr_tokens else None
        spans, errors = files.spans_and_errors(got, tokens)
        # what is printed is a row a file named on the command line
        bad = errors.join(found.select("doc_id", "path"), "doc_id").collect()
        for row in bad:
            print(f"ERROR: {row.path}: {row.error}", file=sys.stderr)
        good = found.select("doc_id", "path").join(errors.select("doc_id"), "doc_id", "left_anti")
        code = {"scan": _scan, "clean": _clean, "gate": _gate, "report": _report}[args.command](spans, good, settings, args)
        return failed if bad else code
    except Exception as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return failed


def _scan(spans, documents, c, args) -> int:
    report = risk.risk_report(span_ops.analyzed(spans, c), documents, c).join(documents, "doc_id")
    worst, safe, unsafe = OK, [], []
    for r in report.withColumn("exit_code", risk.scan_exit_code()).orderBy("path").collect():
        print(f"{r.path}\n  Status: {r.visible_count} visible, {r.suspicious_count} suspicious, {r.invisible_count} invisible\n  Risk: {r.risk_level.upper()}")
        if r.prompt_injection_detected:
            print(f"  WARNING: Prompt injection detected ({len(r.prompt_injection_patterns)} patterns)")
        if args.verbose:
            print("".join(f"  - {line}\n" for line in r.recommendations), end="")
            print("".join(f"  [{k}] '{_short(x)}'\n" for k, x in enumerate(r.invisible_text_sample[:3], 1)), end="")
        worst = max(worst, r.exit_code)
        (safe if r.exit_code == 0 else unsafe).append(r.path)
    if len(safe) + len(unsafe) > 1:
        print(f"Results: {len(safe)} safe, {len(unsafe)} unsafe")
        for title, mark, paths in (("Safe to process:", "+", safe), ("Requires review:", "-", unsafe)):
            print("".join([f"{title}\n" if paths else "", *[f"  {mark} {p}\n" for p in paths]]), end="")
    return worst


def _short(x: str, most: int = 40) -> str:
    return x[:most] + "..." if len(x) > most else x


def _clean(spans, documents, c, args) -> int:
    """Cleaned text to standard output, to a text file (one document) or to a folder of text files (several)."""
    found = documents.join(sanitize.sanitize(span_ops.analyzed(spans, c), args.strategy, c), "doc_id", "left")
    out = found.fillna({"original_span_count": 0, "removed_count": 0, "flagged_count": 0, "safe_text": "", "strategy_used": args.strategy})
    first = out.orderBy("path").limit(2).collect()
    if args.output and len(first) > 1:
        text_files.write_text_files(out.select(text_files.file_name().alias("name"), F.col("safe_text").alias("text")), args.output)
        return OK
    for r in first if len(first) < 2 else out.orderBy("path").collect():
        print(f"{r.path}\n  Strategy: {r.strategy_used}\n  Original: {r.original_span_count} spans\n  Removed: {r.removed_count} spans")
        if r.flagged_count:
            print(f"  Flagged: {r.flagged_count} spans")
        if args.verbose:
            print("".join(f"  [{k}] '{_short(x)}'\n" for k, x in enumerate((r.removed_text_sample or [])[:3], 1)), end="")
        if args.output:
            Path(args.output).write_text(r.safe_text, encoding="utf-8")
            print(f"  Output: {args.output}")
        else:
            print(f"\n--- Cleaned Text ---\n{r.safe_text}\n--- End ---")
    return OK


def _gate(spans, documents, c, args) -> int:
    code = 1
    for r in reports.gate_report(spans, documents, c).join(documents, "doc_id").orderBy("path").collect():
        print(f"{r.status} {r.path} {r.risk_score}/100, {r.hidden_count} of {r.total_spans} spans hidden")
        for p in r.pages or ():
            print(f"  Page {p.page_number}: {p.n_hidden} hidden span(s) [{p.severity}]\n    Text: '{p.example}'" + (f"\n    Why: {p.why}" if p.why else ""))
        if r.more_pages:
            print(f"  ... and {r.more_pages} more pages")
        if r.patterns:
            print(f"  WARNING: {r.n_patterns} suspicious pattern(s)" + "".join(f"\n    - '{x}'" for x in r.patterns))
        code = max(code, r.exit_code)
    return code


def _report(spans, documents, c, args) -> int:
    for r in reports.detail_report(spans, documents, c).join(documents, "doc_id").orderBy("path").collect():
        lines = [
            r.path,
            f"  {r.total_spans} spans, {r.total_chars} characters; {r.with_size} with a size, {r.with_color} with a colour",
            f"  {r.visible_count} visible, {r.suspicious_count} suspicious, {r.invisible_count} invisible, {r.unknown_count} unknown",
        ]
        for k, x in enumerate(r.problem_spans, 1):
            about = [f"Page: {x.page}", x.contrast and f"Contrast: {x.contrast}:1", x.size and f"Size: {x.size}pt", x.color and x.background and f"Colors: {x.color} on {x.background}"]
            lines += [f"  [{k}] {x.status}: '{x.text}'", "      " + ", ".join(filter(None, about))]
        if r.more_spans:
            lines.append(f"  ... and {r.more_spans} more")
        lines.append(f"  Risk: {r.risk_level.upper()}")
        if r.patterns:
            lines += [f"  WARNING: {r.n_patterns} attack pattern(s)", *[f"    - '{x}'" for x in r.patterns]]
        if r.more_patterns:
            lines.append(f"    ... and {r.more_patterns} more")
        lines += [f"  [{k}] '{x}'" for k, x in enumerate(r.samples, 1)] + [f"  - {x}" for x in r.recommendations]
        print("\n".join(lines))
    return OK


if __name__ == "__main__":
    sys.exit(main())
