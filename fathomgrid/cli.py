"""Command line over a folder of tables: python -m fathomgrid.cli FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from fathomgrid import tools
from fathomgrid.session import local_session
from fathomgrid.sources.tables import table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fathomgrid")
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "query"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("-n", type=int, default=5)
        c.add_argument("-c", "--collection")
    for name in ("get", "multi-get", "ls"):
        sub.add_parser(name).add_argument("name")
    sub.add_parser("status")
    a = p.parse_args(args)
    docs = table(local_session(), a.folder, "documents")
    rows = {
        "search": lambda: tools.search(docs, a.text, a.n, collection=a.collection),
        "query": lambda: tools.deep_search(docs, a.text, limit=a.n),
        "get": lambda: tools.get(docs, a.name),
        "multi-get": lambda: tools.multi_get(docs, a.name),
        "ls": lambda: docs.where("active = 1").where(docs.collection == a.name).select("path").orderBy("path"),
        "status": lambda: tools.status(docs),
    }[a.command]()
    for r in rows.toJSON().toLocalIterator():
        print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
