"""python -m vellumry COMMAND: import, export, reconcile, migrate, doctor, recover. Prints JSON."""

from __future__ import annotations

import argparse
import json

from vellumry import commands
from vellumry.operators import documents, reconcile
from vellumry.session import open_session


def main(args: list[str] | None = None, spark=None) -> dict:
    p = argparse.ArgumentParser(prog="vellumry")
    p.add_argument("command", choices=("import", "export", "reconcile", "migrate", "doctor", "recover"))
    p.add_argument("--files", required=True)
    p.add_argument("--store", help="where generations are kept")
    p.add_argument("--excluded", nargs="*", default=(), help="types without files")
    p.add_argument("--profile", choices=documents.PROFILES, default="native")
    p.add_argument("--apply", action="store_true", help="carry out what reconcile or recover would else only list")
    p.add_argument("--plan-id")
    p.add_argument("--source-identity")
    p.add_argument("--direction", choices=reconcile.DIRECTIONS, default="bidirectional")
    p.add_argument("--deletion", choices=reconcile.DELETIONS, default="preserve")
    p.add_argument("--preference", choices=reconcile.PREFERENCES, default="none")
    p.add_argument("--root-id", type=int, default=0)
    p.add_argument("--least-id", type=int, default=0)
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--database", help="a SQLite file left behind")
    a = p.parse_args(args)
    if a.command != "migrate" and not a.store:
        p.error("--store is required")
    spark, excluded = spark or open_session(), tuple(a.excluded)
    if a.command == "import":
        out = commands.import_files(spark, a.files, a.store, excluded)
    elif a.command == "export":
        out = commands.export_files(spark, a.files, a.store, a.profile, excluded)
    elif a.command == "reconcile":
        out = commands.reconcile(spark, a.files, a.store, a.apply, a.plan_id, a.source_identity, direction=a.direction, deletion=a.deletion, preference=a.preference)
    elif a.command == "migrate":
        out = commands.migrate(spark, a.files, excluded)
    elif a.command == "doctor":
        out = commands.doctor(spark, a.files, a.store)
    else:
        out = commands.recover(spark, a.files, a.store, a.root_id, a.least_id, a.limit, a.database, dry=not a.apply)
    print(json.dumps(out, sort_keys=True))
    return out


if __name__ == "__main__":
    main()
