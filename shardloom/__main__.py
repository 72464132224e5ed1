"""Command line: ``spark-submit ... -m shardloom --root <folder> <command>`` or ``python -m shardloom``."""

from __future__ import annotations

import argparse
import importlib
import json
from functools import partial

from shardloom.operators import embed
from shardloom.plans import jobs
from shardloom.plans.collections import CollectionStore
from shardloom.session import build_session
from shardloom.sinks import writers
from shardloom.sources.vectors import scan_query_vectors


def load_object(spec: str):
    """The object that ``module:name`` stands for."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def embed_step(model: str, input_type: str, batch_size: int = 100, any_text: bool = False) -> jobs.EmbedStep:
    """``hash:<dim>``, or ``module:function`` of a function that loads a batch model."""
    module, _, name = model.partition(":")
    if module == "hash":
        return partial(embed.embed_by_hash, dim=int(name), input_type=input_type, any_text=any_text)
    return partial(embed.embed_text, load_model=load_object(model), input_type=input_type, batch_size=batch_size,
                   any_text=any_text)


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="shardloom", description=__doc__)
    main.add_argument("--root", required=True, help="folder of the collections")
    main.add_argument("--master", help="Spark master, where spark-submit does not set it")
    commands = main.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for argument in positional:
            sub.add_argument(argument)
        return sub

    def csv_options(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--csv", required=True)
        sub.add_argument("--tenant-field", default="org_id")
        sub.add_argument("--single-line", action="store_true", help="no cell holds a line feed: large files split")

    def model_options(sub: argparse.ArgumentParser, input_type: str) -> None:
        sub.add_argument("--model", required=True, help="hash:<dim> or module:function")
        sub.add_argument("--input-type", default=input_type)
        sub.add_argument("--batch-size", type=int, default=100)

    create = command("create", "collection")
    create.add_argument("-t", "--tenant", action="append", default=[])
    create.add_argument("--vector-size", type=int, default=1024)
    create.add_argument("--buckets", type=int, default=16)
    create.add_argument("--promote", action="append", default=[], help="payload key to store as a column")
    create.add_argument("--force-recreate", action="store_true")

    command("list")
    command("persist", "path")
    restore = command("restore", "path")
    restore.add_argument("--vector-size", type=int, default=1024)
    restore.add_argument("--force-recreate", action="store_true")

    csv_options(command("ingest", "collection", "tenant"))
    upsert = command("embed-upsert", "collection", "tenant")
    csv_options(upsert)
    model_options(upsert, "")
    upsert.add_argument("--text-field", default="text")

    embed_csv = command("embed", "output")
    csv_options(embed_csv)
    model_options(embed_csv, "passage")
    embed_csv.add_argument("-t", "--tenant")
    embed_csv.add_argument("--keep-other-tenants", action="store_true")
    embed_csv.add_argument("--text-field", default="text")
    embed_csv.add_argument("--window-size", type=int, default=400)
    embed_csv.add_argument("--overlap", type=int, default=80)
    embed_csv.add_argument("--min-tokens", type=int, default=100)
    embed_csv.add_argument("--counter", help="module:function that builds a token counter; words are counted without it")

    query = command("query", "collection")
    query.add_argument("-Q", "--query", action="append", default=[])
    query.add_argument("-q", "--queries-file")
    query.add_argument("--model", help="hash:<dim> or module:function, for -Q")
    query.add_argument("--input-type", default="")
    query.add_argument("-l", "--limit", type=int, default=10)
    query.add_argument("-t", "--tenant")
    query.add_argument("--match", action="append", default=[], metavar="KEY=VALUE")
    query.add_argument("--payload-keys")
    query.add_argument("--with-vectors", action="store_true")
    query.add_argument("--full-payload", action="store_true")
    query.add_argument("--probes", type=int, help="search only so many cells for each query; see set-cells")
    query.add_argument("-o", "--output")

    export = command("export", "collection", "path")
    export.add_argument("-t", "--tenant")
    imports = command("import", "path")
    imports.add_argument("-c", "--collection")
    imports.add_argument("-t", "--tenant")
    imports.add_argument("--dry-run", action="store_true")
    one = command("restore-tenant", "path", "tenant")
    one.add_argument("-c", "--collection")
    one.add_argument("--dry-run", action="store_true")

    command("snapshot-create", "collection")
    command("snapshot-list", "collection")
    snapshot = command("snapshot-restore", "collection", "snapshot")
    snapshot.add_argument("--source", help="the collection that the snapshot is of, if it is another one")
    snapshot.add_argument("--priority", choices=("snapshot", "replica"), default="snapshot")
    command("vacuum", "collection")
    command("compact", "collection")
    cells = command("set-cells", "collection")
    cells.add_argument("--cells", type=int, required=True, help="number of centroids to find by k-means")
    command("delete-collection", "collection")
    commands.choices["delete-collection"].add_argument("--yes", action="store_true")
    delete = command("delete-tenants", "collection")
    delete.add_argument("-t", "--tenant", action="append", required=True)
    delete.add_argument("--yes", action="store_true")
    return main


def _query(store: CollectionStore, args: argparse.Namespace):
    if bool(args.query) == bool(args.queries_file):
        raise SystemExit("Give either -Q (repeatable) or -q, not both.")
    options = {
        "tenant": args.tenant,
        "matches": dict(pair.split("=", 1) for pair in args.match),
        "payload_keys": args.payload_keys,
        "with_vectors": args.with_vectors,
        "full_payload": args.full_payload,
        "probes": args.probes,
    }
    if args.query:
        if not args.model:
            raise SystemExit("-Q needs --model.")
        texts = jobs.query_texts(store.spark, args.query)
        hits = jobs.text_search(store, args.collection, texts, embed_step(args.model, args.input_type), args.limit, **options)
    else:
        queries = scan_query_vectors(store.spark, args.queries_file)
        hits = jobs.search_collection(store, args.collection, queries, args.limit, **options)
    nested = writers.nest_results(hits, "payload", *(["vector"] if args.with_vectors else []))
    if args.output:
        writers.write_results(nested, args.output)
        return args.output
    return [json.loads(row["value"]) for row in writers.result_json(nested.orderBy("query_index")).toLocalIterator()]


def run(store: CollectionStore, args: argparse.Namespace):
    multi_line = not getattr(args, "single_line", False)
    match args.command:
        case "create":
            return vars(store.ensure(args.collection, args.tenant, args.vector_size, args.force_recreate, args.buckets,
                                     args.promote))
        case "list":
            return {name: store.tenants(name) for name in store.names()}
        case "persist":
            return jobs.persist_registry(store, args.path)
        case "restore":
            return [vars(r) for r in jobs.restore_registry(store, args.path, args.force_recreate,
                                                           vector_size=args.vector_size)]
        case "ingest":
            return jobs.ingest_csv(store, args.collection, args.tenant, args.csv, args.tenant_field, multi_line)
        case "embed-upsert":
            step = embed_step(args.model, args.input_type, args.batch_size, any_text=True)
            return jobs.embed_upsert_csv(store, args.collection, args.tenant, args.csv, partial(step, text=args.text_field),
                                         args.tenant_field, args.text_field, multi_line=multi_line)
        case "embed":
            step = embed_step(args.model, args.input_type, args.batch_size)
            return jobs.embed_csv(
                store.spark, args.csv, args.output, partial(step, text=args.text_field), args.tenant, args.tenant_field,
                args.keep_other_tenants, multi_line, text=args.text_field, window_size=args.window_size,
                overlap=args.overlap, min_tokens=args.min_tokens, counter=load_object(args.counter) if args.counter else None)
        case "query":
            return _query(store, args)
        case "export":
            return jobs.export_collection(store, args.collection, args.path, args.tenant)
        case "import":
            return jobs.import_collection(store, args.path, args.collection, args.tenant, args.dry_run)
        case "restore-tenant":
            return jobs.restore_tenant(store, args.path, args.tenant, args.collection, args.dry_run)
        case "snapshot-create":
            return store.create_snapshot(args.collection)
        case "snapshot-list":
            return [row.asDict() for row in store.list_snapshots(args.collection).collect()]
        case "snapshot-restore":
            return store.restore_snapshot(args.collection, args.snapshot, args.priority, args.source).number
        case "compact":
            return store.compact(args.collection)
        case "set-cells":
            return jobs.train_cells(store, args.collection, args.cells)
        case "vacuum":
            return store.vacuum(args.collection)
        case "delete-collection" | "delete-tenants" if not args.yes:
            raise SystemExit("Deleting needs --yes.")
        case "delete-collection":
            return store.delete_collection(args.collection)
        case "delete-tenants":
            deleted, skipped = store.delete_tenants(args.collection, args.tenant)
            return {"deleted": deleted, "skipped": skipped}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    store = CollectionStore(build_session("shardloom", args.master), args.root)
    print(json.dumps(run(store, args), indent=2))


if __name__ == "__main__":
    main()
