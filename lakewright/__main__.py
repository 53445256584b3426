"""python -m lakewright query|ast|check|fix|soql: the surfaces from a shell.

Hits print as path:line:col:text, findings with severity. Exit status: 0, 1 if
`check` found errors, 2 for arguments that make no sense.
"""

from __future__ import annotations

import argparse
import os
import sys

from .apex import corpus, diagnostics
from .apex.bind import Program
from .apex.dynamic import dynamic_queries
from .apex.fix import fix
from .functions.text import PatternError
from .session import session


def project_root(start: str) -> str | None:
    """The nearest folder at or above start with a project file."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(at, "sfdx-project.json")):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakewright")
    sub = p.add_subparsers(dest="cmd", required=True)
    q = sub.add_parser("query")
    q.add_argument("pattern")
    q.add_argument("paths", nargs="*")
    q.add_argument("--and", dest="ands", action="append", default=[])
    q.add_argument("--not", dest="nots", action="append", default=[])
    q.add_argument("--let", dest="lets", action="append", default=[])
    q.add_argument("-r", "--replace", action="append", default=[])
    for name in ("ast", "check", "fix", "soql"):
        sub.add_parser(name).add_argument("paths", nargs="*")
    a = p.parse_args(argv)
    missing = [x for x in a.paths if not os.path.exists(x)]
    if missing:
        print(f"no such path: {missing[0]}", file=sys.stderr)
        return 2
    root = project_root(".")
    writes = a.cmd == "fix" or a.cmd == "query" and a.replace
    if writes and not a.paths and root is None:
        print("no project here; name the paths to change", file=sys.stderr)
        return 2
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    files = None
    for path in a.paths or [root or "."]:
        got = corpus.read_files(spark, os.path.abspath(path)).where("file_class = 'apex'").withColumn("path", corpus.F.regexp_replace("path", "^file:/*", "/"))
        files = got if files is None else files.unionByName(got)
    try:
        if a.cmd == "query" and not a.replace:
            for r in corpus.ordered(corpus.search(files, a.pattern, a.ands, a.nots, a.lets)).toLocalIterator():
                print(f"{r['path']}:{r['line']}:{r['col']}:{r['text']}")
        elif a.cmd == "query":
            out = corpus.rewrite(files, a.pattern, a.replace, a.ands, a.nots, a.lets)
            for r in out.toLocalIterator():
                if r["status"] == "changed":
                    _save(r["path"], r["new_text"])
                print(f"{r['path']}: {r['status']}" + (f": {r['reason']}" if r["reason"] else f", {r['edits']} edits"))
        elif a.cmd == "ast":
            for r in corpus.nodes(files).orderBy("path", "node_id").toLocalIterator():
                print(f"{'  ' * r['depth']}{r['kind']} {r['start']}..{r['end']}")
        elif a.cmd == "soql":
            for r in corpus.query_kind(files).orderBy("path", "line", "col").toLocalIterator():
                print(f"{r['path']}:{r['line']}:{r['col']}:{r['form']}: {r['text']}")
            for r in dynamic_queries(files).where("binds <> ''").toLocalIterator():
                print(f"{r['path']}:{r['line']}:{r['col']}:binds: {r['binds']}")
        elif a.cmd == "fix":
            before = files.select("path", corpus.F.col("text").alias("old"))
            after, passes = fix(files)
            for r in after.join(before, "path").where("text <> old").toLocalIterator():
                _save(r["path"], r["text"])
                print(f"{r['path']}: changed")
            print(f"{passes} passes")
        else:
            errors = 0
            for r in diagnostics.located(Program(files)).orderBy("path", "line", "col").toLocalIterator():
                errors += r["severity"] == "error"
                print(f"{r['path']}:{r['line']}:{r['col']}: {r['severity']}: {r['message']}")
            return int(errors > 0)
    except PatternError as e:
        print(e, file=sys.stderr)
        return 2
    except BrokenPipeError:
        return 0
    return 0


def _save(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


if __name__ == "__main__":
    sys.exit(main())
