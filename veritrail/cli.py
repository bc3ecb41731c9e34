"""Command line: ``python -m veritrail.cli --store PATH --workspace NAME VERB ...``; exits 0, 1 (a reason code) or 2 (usage)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError
from .sources import workspace
from .store import Store


def _show(df: DataFrame, limit: int = 1000) -> None:
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        print(f"the first {limit} rows of more", file=sys.stderr)
    for row in rows[:limit]:
        print(row)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veritrail")
    top.add_argument("--store", help="a folder; that of the workspace found from --start or the environment where it is left out")
    top.add_argument("--workspace", help="its name; the folder's where it is left out")
    top.add_argument("--start", help="where to begin looking for a workspace")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **flags) -> None:
        p = verbs.add_parser(name)
        for a in args:
            p.add_argument(a)
        for flag, default in flags.items():
            p.add_argument(f"--{flag.replace('_', '-')}", default=default, type=type(default) if default is not None else str)

    verb("record", "kind", "id", "content", valid_from=None, valid_until=None)
    verb("link", "source", "target", "type", weight=1.0)
    verb("retract", "id", "reason", at=None)
    verb("purge", "id", "reason")
    verb("at", "valid_at", as_of=None)
    verb("why", "id", direction="upstream", depth=5)
    verb("find", "query", limit=10, record="no")
    verb("suggest", min_score=0.7)
    verb("merge", "canonical", "members", "reason")
    verb("extract", source=None)
    verb("confirm", "proposal", "source", "target", note="")
    verb("refers", "mention", limit=5)
    verb("view", "id", at=None)
    verb("evidence")
    verb("verify")
    verb("log", limit=50)
    return top


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    found = workspace.resolve(os.environ, a.start) if a.store is None or a.workspace is None else None
    s = Store(spark, a.store or str(workspace.prepare(found)), a.workspace or found.root.name)
    if a.verb == "record":
        s.append([{"kind": a.kind, "id": a.id, "content": json.loads(a.content), "meta": {"validFrom": a.valid_from, "validUntil": a.valid_until}}])
    elif a.verb == "link":
        s.link_records(a.source, a.target, a.type, a.weight)
    elif a.verb == "retract":
        s.retract(a.id, a.reason, a.at)
    elif a.verb == "purge":
        s.purge(a.id, a.reason)
    elif a.verb == "at":
        for part in s.state_at(a.valid_at, a.as_of):
            _show(part)
    elif a.verb == "why":
        _show(s.why([a.id], a.direction, a.depth))
    elif a.verb == "find":
        found = s.find({"q": a.query}, a.limit)
        _show(found.served.orderBy("position"))
        _show(found.decisions)
        if a.record == "yes":
            s.record_retrieval(found)
    elif a.verb == "suggest":
        _show(s.suggest(a.min_score)[1])
    elif a.verb == "merge":
        s.merge([*a.members.split(","), a.canonical], a.canonical, a.reason)
    elif a.verb == "extract":
        for part in s.propose():
            _show(part)
    elif a.verb == "confirm":
        row = s.propose()[0].where(f"proposal = '{a.proposal}'").first() if "'" not in a.proposal else None
        if row is None:
            raise EngineError("not_found")
        s.confirm(row.asDict(recursive=True), a.source, a.target, a.note)
    elif a.verb == "refers":
        ranked, verdict = s.link(spark.createDataFrame([("m", a.mention)], "mention_id string, mention string"), a.limit)
        _show(ranked)
        _show(verdict)
    elif a.verb == "view":
        canonical = s.resolve_ids([a.id], a.at).first()["canonical"]
        for part in s.merged_view(a.at):
            _show(part.where(part["canonical"] == canonical))
    elif a.verb == "evidence":
        _show(s.evidence())
    elif a.verb == "verify":
        _show(s.verify())
    elif a.verb == "log":
        _show(s.read_log(a.limit))
    return 0


def main() -> int:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
