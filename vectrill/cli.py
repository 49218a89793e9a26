"""Command line: ``add``, ``query`` and ``count`` on a collection; results are JSON."""

from __future__ import annotations

import argparse
import json
import sys

from .database import connect


def _vector(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vectrill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("add", "query", "count"):
        p = commands.add_parser(name)
        p.add_argument("--db", required=True)
        p.add_argument("--collection", required=True)
        if name != "count":
            p.add_argument("--vector", type=_vector, required=True, help="comma-separated numbers")
        if name == "add":
            p.add_argument("--id", required=True)
            p.add_argument("--document", default="")
            p.add_argument("--metadata", default="{}", help="a JSON object")
        if name == "query":
            p.add_argument("--k", type=int, default=10)
            p.add_argument("--where", type=json.loads, default=None)
    a = parser.parse_args(argv)
    with connect(a.db) as db:
        target = db.collection(a.collection, create=a.command == "add", dim=len(a.vector) if a.command == "add" else None)
        if a.command == "add":
            target.add(ids=[a.id], documents=[a.document], metadatas=[json.loads(a.metadata)], vectors=[a.vector])
            out = {"added": a.id}
        elif a.command == "query":
            r = target.query(vector=a.vector, k=a.k, where=a.where)
            out = [{"id": i, "score": d, "document": t, "metadata": m} for i, d, t, m in zip(r.ids, r.distances, r.documents, r.metadatas, strict=True)]
        else:
            out = {"count": target.count()}
    json.dump(out, sys.stdout)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
