"""Command line: search texts and folders for references, complete, list books.

    python -m lectern.cli --canon canon.json -b John notes/
    python -m lectern.cli --canon canon.json --text "see John 3:16" -m json

Exit code 0 if something was found, 1 if nothing, 2 on errors.
"""

from __future__ import annotations

import argparse
import json
import shlex
import sys
import tomllib
from pathlib import Path

from pyspark.sql import functions as F

from . import sinks
from .canon import Canon, CanonError, Translations
from .functions import columns as C
from .functions.complete import Completer, CompletionOptions
from .functions.notation import Format, NotationError
from .functions.refs import Finder, Options
from .operators import extract, filters, ordering
from .operators.filters import BookScope, PathFilter, RefFilter
from .session import local_session, ship_package
from .sources import adapters, epub, subtitles
from .sources import files as files_

MODES = ("auto", "grouped", "quickfix", "table", "json", "count", "total-count", "index")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern", description="Find scripture references.")
    add = p.add_argument
    add("paths", nargs="*")
    add("--text")
    add("--canon", help="JSON with books, genres and chapter_verses")
    for name in ("merge-data", "remove-data"):
        add(f"--{name}", action="append", default=[])
    for name in ("testament", "genre", "book"):
        add(f"-{name[0]}", f"--{name}", action="append", default=[])
        add(f"--exclude-{name}", action="append", default=[])
    add("--nt", action="append_const", dest="testament", const="nt")
    add("--ot", action="append_const", dest="testament", const="ot")
    for short, name in (("-i", "inside"), (None, "any-overlap"), ("-o", "explicit-overlap"), (None, "exact-overlap"), (None, "exclude-overlap")):
        add(*filter(None, (short, f"--{name}")), action="append", default=[])
    add("--chapters", action="store_true")
    add("--skip-single-chapter", action="store_true")
    add("--translation", action="append", default=[])
    add("--translations", help="names that may follow a reference, NAME or NAME=ALIAS, separated by commas")
    add("--context-book")
    add("--context-heading")
    add("--books-alone", action="store_true")
    add("-m", "--mode", choices=MODES, default="auto")
    add("--sort", choices=("path", "bible"), default="path")
    add("-A", "--after", type=int, default=0)
    add("-B", "--before", type=int, default=0)
    add("-C", "--context", type=int, default=0)
    add("-f", "--format", default="name", choices=("name", "abbreviation", "osis", "usfm"))
    add("--fmt", action="append", default=[], metavar="OPTION=VALUE")
    for name in ("ext", "exclude-ext", "glob", "iglob", "path-regex", "ignore-file"):
        add(f"--{name}", action="append", default=[])
    for name in ("hidden", "no-ignore", "follow", "binary", "epub-links", "cfi-assertions", "complete-typed", "list-books", "no-config"):
        add(f"--{name}", action="store_true")
    add("--max-depth", type=int)
    add("--max-filesize", type=files_.parse_size)
    for name in ("--files", "--files-without-match"):
        add(name, action="store_true")
    add("-l", "--files-with-matches", action="store_true")
    add("--complete", metavar="TEXT")
    add("-q", "--query", action="append", default=[], help="a named query from the configuration")
    add("--config")
    add("--cpus", type=int, default=4)
    return p


def expand(argv: list[str]) -> list[str]:
    """Configuration first, named queries in place; what is written later wins."""
    first = parser()
    known, _ = first.parse_known_args(argv)
    if known.no_config or not known.config:
        return argv
    data = tomllib.loads(Path(known.config).read_text())
    named = data.pop("queries", {})
    before: list[str] = []
    options = {o for a in first._actions for o in a.option_strings}
    for key, value in data.items():
        flag = f"--{key.replace('_', '-')}"
        if flag not in options:
            raise CanonError(f"unknown option in the configuration: {key}")
        if value is True:
            before.append(flag)
        elif value is not False:
            for v in value if isinstance(value, list) else [value]:
                before += [flag, json.dumps(v) if isinstance(v, dict) else str(v)]
    out, seen = [], set()
    todo = list(argv)
    while todo:
        a = todo.pop(0)
        if a in ("-q", "--query") and todo:
            name = todo.pop(0)
            if name in seen or name not in named:
                raise CanonError(f"unknown or recursive query: {name}")
            seen.add(name)
            todo = shlex.split(named[name]) + todo
        else:
            out.append(a)
    return before + out


def _json_file(path: str) -> dict:
    return json.loads(Path(path).read_text() if not path.lstrip().startswith("{") else path)


def load_canon(a: argparse.Namespace) -> Canon:
    canon = Canon.from_json(Path(a.canon).read_text()) if a.canon else Canon()
    for p in a.merge_data:
        canon = canon.merged(_json_file(p))
    for p in a.remove_data:
        canon = canon.removed(_json_file(p))
    return canon


def load_filter(a: argparse.Namespace, canon: Canon) -> RefFilter:
    finder = Finder(canon)

    def passages(texts: list[str]) -> tuple:
        out = []
        for t in texts:
            if (got := finder.read(t)) is None:
                raise CanonError(f"not a reference: {t}")
            out.append(got)
        return tuple(out)

    scope = BookScope(tuple(a.testament), tuple(a.genre), tuple(a.book), tuple(a.exclude_testament), tuple(a.exclude_genre), tuple(a.exclude_book))
    f = RefFilter(
        scope, passages(a.inside), passages(a.any_overlap), passages(a.explicit_overlap), passages(a.exact_overlap), passages(a.exclude_overlap),
        single_chapter_books=not a.skip_single_chapter, translations=tuple(a.translation),
    )
    return filters.auto_verses(f, a.chapters)


def load_options(a: argparse.Namespace, canon: Canon) -> Options:
    pairs = [x.strip().split("=") for x in (a.translations or "").split(",") if x.strip()]
    tr = Translations(tuple(p[0] for p in pairs) + tuple(t for t in a.translation if t not in {p[0] for p in pairs}), tuple((x, p[0]) for p in pairs for x in p[1:]))
    return Options(canon.find(a.context_book) if a.context_book else None, a.context_heading, a.books_alone, tr if tr.keys else None)


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    try:
        a = parser().parse_args(expand(list(sys.argv[1:] if argv is None else argv)))
        canon = load_canon(a)
        if a.list_books:
            for b in canon.books:
                print(b.name, file=out)
            return 0 if canon.books else 1
        if a.complete is not None:
            fmt = Format.from_dict({"book": a.format, **dict(x.split("=", 1) for x in a.fmt)})
            got = Completer(canon, load_options(a, canon).translations).complete(a.complete, None, CompletionOptions(format=fmt, include_typed=a.complete_typed))
            for c in got:
                print(c.label, file=out)
            return 0 if got else 1
        return search(a, canon, out)
    except (CanonError, NotationError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def search(a: argparse.Namespace, canon: Canon, out) -> int:
    spark = local_session(a.cpus)
    ship_package(spark)
    f, options = load_filter(a, canon), load_options(a, canon)
    if why := f.contradiction(canon):
        print(f"warning: {why}", file=sys.stderr)
    errors = None
    if a.text is not None or (not a.paths and not sys.stdin.isatty()):
        docs = spark.createDataFrame([("", a.text if a.text is not None else sys.stdin.read())], "path string, text string")
        refs = extract.extract_refs(docs, canon, options=options).withColumn("label", F.lit(None).cast("string"))
    else:
        walk = files_.Walk(a.hidden, a.no_ignore, (".gitignore", ".ignore", *a.ignore_file), a.follow, a.max_depth, a.max_filesize)
        listed = files_.list_files(a.paths or ["."], walk)
        pf = PathFilter(globs=tuple(a.glob or a.iglob), regexes=tuple(a.path_regex), extensions=tuple(a.ext), exclude_extensions=tuple(a.exclude_ext), ignore_case=bool(a.iglob))
        if not listed:
            return 1
        content = spark.read.format("binaryFile").load([str(Path(p).resolve()) for p in listed]).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")
        content = content.where(pf.predicate(F.col("path")))
        if a.files:
            for r in content.select("path").orderBy("path").collect():
                print(r[0], file=out)
            return 0
        docs = files_.text_files(content, a.binary).select("path", "text", "kind")
        plain = extract.extract_refs(docs, canon, keys=["path", "kind"], options=options)
        cues = subtitles.cue_rows(docs.where("kind = 'subtitles'").select("path", "text"))
        refs = subtitles.place_in_cues(plain, cues, ["path"]).select(*plain.columns, "label").drop("kind")
        books = content.where(files_.kind_of(F.col("path")) == "epub").select("path", "content")
        found = adapters.extract_with(books, canon, _EpubPieces(a.cfi_assertions), epub.COLUMNS, options=options)
        errors = found.where("error IS NOT NULL").select("path", "error")
        hits = found.where("error IS NULL").withColumnRenamed("chapter", "label").withColumn("col_utf16", F.col("utf16_column") + 1)
        refs = refs.unionByName(hits.select("path", "ref_no", "book_id", "segments", "written", "label", "line", "col_utf16", "cfi"), allowMissingColumns=True)
    refs = f.apply(refs, canon).cache()
    n = print_refs(a, canon, docs, refs, out)
    failed = errors.collect() if errors is not None else []
    for r in failed:
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    return 2 if failed else 0 if n else 1


class _EpubPieces:
    def __init__(self, assertions: bool):
        self.assertions = assertions

    def __call__(self, data: bytes):
        return epub.pieces(bytes(data), self.assertions)


def print_refs(a: argparse.Namespace, canon: Canon, docs, refs, out) -> int:
    if a.files_with_matches or a.files_without_match:
        chosen = (ordering.files_with if a.files_with_matches else ordering.files_without)(docs, refs).select("path").distinct().orderBy("path").collect()
        for r in chosen:
            print(r[0], file=out)
        return len(chosen)
    if a.mode == "total-count":
        n = refs.count()
        print(n, file=out)
        return n
    if a.mode == "count":
        rows = ordering.counts_per_file(refs).orderBy("path").collect()
        for r in rows:
            print(f"{r['path']}:{r['refs']}", file=out)
        return len(rows)
    if a.mode == "index":
        s = F.transform("segments", lambda x: F.array(x["kind"], x["sc"], x["sv"], x["ec"], x["ev"]))
        one = F.struct("ref_no", "book_id", s.alias("segments"), "line", "label")
        rows = refs.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("refs")).orderBy("path").select(F.to_json(F.struct("path", "refs")))
        n = 0
        for r in rows.toLocalIterator():
            print(r[0], file=out)
            n += 1
        return n
    shown = sinks.named(refs, canon)
    order = ordering.bible_order() if a.sort == "bible" else ordering.file_order()
    shown = shown.orderBy(*order)
    n = 0
    if a.mode == "json":
        keep = [c for c in shown.columns if c != "segments"]
        for r in shown.withColumn("segments_json", C.segments_json(F.col("segments"))).select(F.to_json(F.struct(*keep, "segments_json")).alias("j")).toLocalIterator():
            print(r[0], file=out)
            n += 1
    elif a.mode == "table":
        rows = [r.asDict() for r in shown.select(F.col("reference").alias("Reference"), F.col("path").alias("Path"), F.col("line").alias("Line"), F.col("label").alias("Location")).collect()]
        print(sinks.markdown_table(rows, ["Reference", "Path", "Line", "Location"]), file=out)
        n = len(rows)
    elif a.mode == "grouped" and not a.epub_links:
        around = max(a.context, 0)
        rows = sinks.context_lines(docs, refs.where("line IS NOT NULL AND end_line IS NOT NULL"), max(around, a.before), max(around, a.after)).orderBy("path", "line_no").collect()
        last = None
        for r in rows:
            if last and (r["path"], r["line_no"]) != (last[0], last[1] + 1):
                print("--", file=out)
            if not last or last[0] != r["path"]:
                print(r["path"], file=out)
            print(f"{r['line_no']}{':' if r['hit'] else '-'}{r['line']}", file=out)
            last = (r["path"], r["line_no"])
            n += r["hit"]
    else:
        column = F.coalesce("col_char", "col_utf16") if "col_char" in shown.columns else F.col("col_utf16")
        text = F.concat(F.when(F.col("path") != "", F.concat(F.col("path"), F.lit(":"))).otherwise(""), F.col("line").cast("string"), F.lit(":"), column.cast("string"), F.lit(": "), F.col("reference"), F.coalesce(F.concat(F.lit(" ("), F.col("label"), F.lit(")")), F.lit("")))
        if a.epub_links:
            text = F.coalesce(epub.wiki_link(F.col("path"), F.col("cfi"), F.col("reference")), text)
        for r in shown.select(text.alias("t")).toLocalIterator():
            print(r[0], file=out)
            n += 1
    return n


if __name__ == "__main__":
    sys.exit(main())
