"""Commands: profile, review, load, verify, resolve, run."""

from __future__ import annotations

import argparse
import sys

import yaml

from cellprobe import migrate
from cellprobe.operators import verify
from cellprobe.operators.profile import SAMPLE_ROWS
from cellprobe.operators.resolver import THRESHOLD, FileResolver
from cellprobe.plans import config as configs
from cellprobe.plans import ddl
from cellprobe.plans.load import load
from cellprobe.plans.review import Review
from cellprobe.session import session
from cellprobe.sources.sqlite_cells import read_table


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellprobe")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for flag, options in flags.items():
            s.add_argument(f"--{flag.replace('_', '-')}", **options)
        return s

    threshold, size = {"type": float, "default": THRESHOLD}, {"type": int, "default": SAMPLE_ROWS}
    target = {"required": True, "help": "folder of the target tables"}
    switch = {"action": "store_true"}
    add("profile", "source", out={"default": None}, sample_size=size, threshold=threshold)
    add("review", "config", threshold=threshold, accept_all=switch)
    add("load", "config", target={"default": None}, dry_run=switch, force=switch, resume=switch, threshold=threshold, verify=switch, noverify=switch)
    add("verify", "config", target=target, out={"default": None})
    add("resolve", "config", apply={"required": True})
    add("run", "source", target=target, sample_size=size, threshold=threshold, keep_config=switch, verify=switch, noverify=switch)
    return p


def _load(spark, path: str, args) -> None:
    config = configs.load(path)
    rows = load(spark, config, lambda t: read_table(spark, config.source, t), args.target, f"{path}.state", force=getattr(args, "force", False), resume=getattr(args, "resume", False), threshold=args.threshold, on_table=lambda t, n: print(f"{t}: {n} rows"))
    print(f"loaded {len(rows)} table(s)")


def _verify(spark, path: str, target: str, out: str | None = None) -> int:
    results = migrate.verify_load(spark, configs.load(path), target, f"{path}.state")
    text = verify.report(results)
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    print(text)
    return int(not all(r.passed() for r in results))


def _profile(spark, args, out: str) -> int:
    config, unresolved = migrate.profile_file(spark, args.source, args.sample_size, args.threshold)
    configs.save(config, out)
    for note in [*config.skipped, *(f"system table {t}" for t in config.filtered)]:
        print(f"skipped {note}", file=sys.stderr)
    if unresolved:
        FileResolver(f"{out}.unresolved.yaml").resolve(unresolved)
        print(f"{len(unresolved)} column(s) need review", file=sys.stderr)
    return int(bool(unresolved))


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if getattr(args, "verify", False) and args.command != "verify" and args.noverify:
        parser.error("--verify and --noverify exclude each other")
    if args.command == "resolve":
        config = configs.load(args.config)
        with open(args.apply, encoding="utf-8") as f:
            configs.apply_answers(config, yaml.safe_load(f))
        configs.save(config, args.config)
        return 0
    if args.command == "review":
        review = Review(configs.load(args.config), lambda c: configs.save(c, args.config))
        for table, (open_, fine) in review.summary().items():
            print(f"{table}: {open_} to review, {fine} approved", *review.flagged(table))
        if args.accept_all:
            review.finish()
        return 0
    if args.command == "load" and args.dry_run:
        print(ddl.dry_run(configs.load(args.config)))
        return 0
    spark = session()
    if args.command == "profile":
        return _profile(spark, args, args.out or f"{args.source}.yaml")
    if args.command == "verify":
        return _verify(spark, args.config, args.target, args.out)
    if args.command == "load":
        _load(spark, args.config, args)
        return _verify(spark, args.config, args.target) if args.verify and not args.noverify else 0
    out = f"{args.source}.yaml"
    if _profile(spark, args, out):
        print(f"review {out}, then load it", file=sys.stderr)
        return 1
    _load(spark, out, args)
    code = _verify(spark, out, args.target) if args.verify and not args.noverify else 0
    if not code and not args.keep_config:
        import os

        for path in (out, f"{out}.state"):
            if os.path.exists(path):
                os.remove(path)
    return code


if __name__ == "__main__":
    sys.exit(main())
