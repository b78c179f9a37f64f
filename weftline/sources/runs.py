"""A run's life on disk: begun, journaled, stopped or done, taken up again, deleted.

A run's folder holds ``run.json`` (what lists show), ``manifest.json`` (all of it, once it ended) and a folder for each
scan with its files, its chat and, while it may be taken up again, its journal.
"""

from __future__ import annotations

import dataclasses
import json
import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.url import canonical, parse
from . import files
from .catalog import read_journal, run_path, sanitized

JOURNAL = "pages.jsonl"
TOKENS = ("calls", "input_tokens", "output_tokens", "cached_input_tokens")


def cache_root(option: str | None, environment: dict[str, str], here: str) -> str:
    """Where runs are kept: the option, else the environment's WEFTLINE_RUNS, else a folder of the current one."""
    return option or environment.get("WEFTLINE_RUNS") or f"{here.rstrip('/')}/.weftline"


def scan_of(url: str, nth: int) -> str:
    """The id of the nth target's scan, from 0."""
    u = parse(url)
    name = re.sub(r"[^A-Za-z0-9_]+", "-", u.host.lower() if u else "").strip("-")[:80]
    return f"{nth + 1:02d}-{name or 'section'}"


def scan_pages(scan: dict) -> int:
    pages = scan.get("pages")
    return (scan.get("stats") or {}).get("pages") or (len(pages) if isinstance(pages, list) else pages) or 0


def totals(scans: list[dict], warnings: list | None = None, tokens: dict | None = None) -> dict:
    """Pages, tokens and warnings of a run; a total that is given for tokens goes before the sum of its scans'."""
    each = {k: sum((s.get("tokens") or {}).get(k) or 0 for s in scans) for k in TOKENS}
    return {"pages": sum(map(scan_pages, scans)), "scans": len(scans), "tokens": tokens or each, "warnings": len(warnings or [])}


def _json(text: str | None) -> dict | None:
    try:
        out = json.loads(text) if text else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def _write(spark: SparkSession, root: str, run_id: str, name: str, value: dict) -> None:
    files.write(spark, run_path(root, run_id, name), json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def begin(spark: SparkSession, root: str, run_id: str, created_at: str, targets: list[tuple[str, str | None]], options: dict) -> None:
    """Writes what a run that crashes is taken up from."""
    listed = [{"url": u, "task": t} for u, t in targets]
    _write(spark, root, run_id, "run.json", {"id": run_id, "createdAt": created_at, "status": "running", "targets": listed, "options": sanitized(options), "pages": 0})


def save(
    spark: SparkSession, root: str, run_id: str, created_at: str, targets: list[tuple[str, str | None]], options: dict, scans: list[dict],
    duration_ms: int = 0, warnings: list[str] | None = None, tokens: dict | None = None, status: str = "done",
) -> dict:
    """Writes manifest and summary. A run that is done and not incremental needs its journals no more."""
    t = totals(scans, warnings, tokens)
    head = {"createdAt": created_at, "status": status, "durationMs": duration_ms}
    manifest = {
        "runId": run_id, **head, "targets": [{"url": u, "task": x} for u, x in targets], "options": sanitized(options),
        "stats": {"pages": t["pages"], "durationMs": duration_ms, "scans": t["scans"], "tokens": t["tokens"]}, "scans": scans, "warnings": warnings or [],
    }
    listed = [
        {k: s.get(k) for k in ("scanId", "url", "task", "title")} | {
            "pages": scan_pages(s), "warnings": len(s.get("warnings") or []),
            "files": [{"filename": f.get("filename"), "bytes": f.get("bytes")} for f in s.get("files") or []],
        }
        for s in scans
    ]
    _write(spark, root, run_id, "manifest.json", manifest)
    _write(spark, root, run_id, "run.json", {"id": run_id, **head, "pages": t["pages"], "tokens": t["tokens"], "scans": listed, "warnings": t["warnings"]})
    if status == "done" and not options.get("incremental"):
        for s in scans:
            files.delete(spark, run_path(root, run_id, str(s["scanId"]), JOURNAL))
    return manifest


def summary(value: dict) -> dict:
    """A run's summary in today's form: one without a status is done, one without scans had one target."""
    out = {**value, "status": value.get("status") or "done"}
    if isinstance(out.get("scans"), list):
        return out
    first = (out.get("targets") or [{}])[0]
    u = parse(first.get("url") or "")
    scan = {
        "scanId": "", "url": first.get("url") or "", "task": out.get("task") or first.get("task") or "", "title": u.host if u else "",
        "pages": scan_pages(out), "files": out.get("files") or [], "warnings": out.get("warnings") or 0,
    }
    return {**out, "scans": [scan]}


def get(spark: SparkSession, root: str, run_id: str) -> dict:
    """A run's manifest, or its summary where there is none, in today's form."""
    found = _json(files.read(spark, run_path(root, run_id, "manifest.json"))) or _json(files.read(spark, run_path(root, run_id, "run.json")))
    if found is None:
        raise LookupError(f"no run {run_id!r}")
    return summary(found)


def scan(run: dict, scan_id: str = "") -> dict | None:
    """The scan of that id; the first one where none is named."""
    scans = run.get("scans") or []
    return next((s for s in scans if str(s.get("scanId") or "") == scan_id), scans[0] if scans and not scan_id else None)


@dataclasses.dataclass
class Stopped:
    """What a run is taken up from."""

    run_id: str
    created_at: str | None
    targets: list[tuple[str, str | None]]
    options: dict
    journals: dict[str, DataFrame]


def load_for_resume(spark: SparkSession, root: str, run_id: str) -> Stopped:
    """Targets and options of the manifest, which a stopped run has, else of what it began with; and its journals.

    A run that is done, or has no targets, is refused.
    """
    begun = _json(files.read(spark, run_path(root, run_id, "run.json")))
    if begun is None:
        raise LookupError(f"no run {run_id!r}")
    ended = _json(files.read(spark, run_path(root, run_id, "manifest.json"))) or {}
    status = begun.get("status") or ended.get("status") or "done"
    targets = [(t["url"], t.get("task")) for t in ended.get("targets") or begun.get("targets") or [] if t.get("url")]
    if status == "done":
        raise ValueError(f"run {run_id!r} is done")
    if not targets:
        raise ValueError(f"run {run_id!r} has no targets")
    journals = {}
    for i, (url, _) in enumerate(targets):
        sid = scan_of(url, i)
        if files.read(spark, path := run_path(root, run_id, sid, JOURNAL)) is not None:
            journals[sid] = read_journal(spark, path)
    return Stopped(run_id, begun.get("createdAt"), targets, ended.get("options") or begun.get("options") or {}, journals)


def same_targets(a: list[str], b: list[str]) -> bool:
    """Whether two lists name the same pages."""
    known = lambda urls: {canonical(u) or u for u in urls if u}
    return known(a) == known(b)


def delete_all(spark: SparkSession, root: str) -> int:
    """Deletes all runs below a folder, and nothing else there."""
    ids = [n for n in files.folders(spark, root) if files.read(spark, f"{root.rstrip('/')}/{n}/run.json") is not None]
    return sum(files.delete(spark, run_path(root, n)) for n in ids)


def read_file(spark: SparkSession, root: str, run_id: str, scan_id: str, name: str) -> str | None:
    """A file of a scan; one of a run of one target, whose scan has no id, lies in the run's own folder."""
    return files.read(spark, run_path(root, run_id, *([scan_id] if scan_id else []), name))


def session(spark: SparkSession, root: str, run_id: str, scan_id: str) -> dict:
    """A scan's conversation: its messages and the files that came of it."""
    found = _json(files.read(spark, run_path(root, run_id, f"chat-{scan_id}.json"))) or {}
    return {"messages": found.get("messages") or [], "files": found.get("files") or []}


def write_session(spark: SparkSession, root: str, run_id: str, scan_id: str, value: dict) -> None:
    _write(spark, root, run_id, f"chat-{scan_id}.json", value)


def chat_name(name: str, used: set[str]) -> str:
    """A name that stays in its folder, ends in .md and isn't used yet; it is from now on."""
    base = re.sub(r"[^\w-]+", "-", re.sub(r"(?i)\.md$", "", name)).strip("-")[:80] or "file"
    out, n = f"{base}.md", 2
    while out in used:
        out, n = f"{base}-{n}.md", n + 1
    used.add(out)
    return out


def write_chat_file(spark: SparkSession, root: str, run_id: str, scan_id: str, name: str, text: str) -> None:
    files.write(spark, run_path(root, run_id, f"chat-{scan_id}-{name}"), text if text.endswith("\n") else text + "\n")


def read_chat_file(spark: SparkSession, root: str, run_id: str, scan_id: str, name: str) -> str | None:
    return files.read(spark, run_path(root, run_id, f"chat-{scan_id}-{name}"))


def read_activity(spark: SparkSession, root: str, run_id: str, schema: str = "type string, ts string, scan_id string, payload map<string,string>") -> DataFrame:
    """Events that a run has left, without torn lines; none where it left none."""
    path = run_path(root, run_id, "activity")
    if files.read(spark, path) is None:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, _corrupt_record string").json(path)
    return found.filter("_corrupt_record is null and type is not null").drop("_corrupt_record")
