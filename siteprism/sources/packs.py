"""Signature packs and blocklists from files to tables."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
HERE = Path(__file__).parent / "packs"

#: Pack keys that can be told from a landed page, and the source each is matched in.
SOURCES = {
    "scriptSrc": "script_src", "html": "html", "css": "css", "headers": "headers", "cookies": "cookies", "meta": "meta",
    "url": "url", "robots": "robots", "text": "text", "dns": "dns_header",
}
#: Keys whose values are by name.
NAMED = ("headers", "cookies", "meta", "dns")
#: What stands for a version number in vulnerable-library extractors, and the group that takes its place.
VERSION_MARK, VERSION_GROUP = "§§version§§", r"([0-9][0-9.a-z_\-]+)"


@dataclass
class Stats:
    """A11."""

    pack: str
    total: int = 0
    loaded: int = 0
    empty: int = 0
    patterns: int = 0
    invalid: int = 0


@dataclass
class Pack:
    """A pack as rows: ``tech``, ``pattern``, ``edge``, and its stats."""

    tech: list[dict] = field(default_factory=list)
    pattern: list[dict] = field(default_factory=list)
    edge: list[dict] = field(default_factory=list)
    stats: list[Stats] = field(default_factory=list)


def annotated(text: str) -> tuple[str, dict[str, str]]:
    """A pattern and the notes behind it, each after a backslash and semicolon."""
    head, *notes = text.split("\\;")
    return head, {k.strip(): v for k, _, v in (n.partition(":") for n in notes)}


def confidence(notes: dict[str, str]) -> int:
    """0 to 100; 100 where there is none or it is no number."""
    value = notes.get("confidence", "100").strip()
    return max(0, min(100, int(value))) if re.fullmatch(r"[+-]?\d+", value) else 100


def strings(value: object) -> list[str]:
    """A text or a list of texts as a list."""
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def valid(pattern: str) -> bool:
    """Whether a pattern can be compiled and isn't empty."""
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return bool(pattern)


def _patterns(entry: dict) -> Iterable[tuple[str, str | None, str]]:
    """(source, qualifier, pattern) of an entry, in its order; an empty value by name matches anything."""
    for key, value in entry.items():
        if key in NAMED and isinstance(value, dict):
            yield from ((SOURCES[key], name, v or ".*") for name, v in value.items() if isinstance(v, str))
        elif key in SOURCES:
            yield from ((SOURCES[key], None, v) for v in strings(value))


def add_entry(pack: Pack, stats: Stats, name: str, entry: object, label: str) -> None:
    """One technology's rows; an entry without a usable pattern is only counted."""
    stats.total += 1
    if not isinstance(entry, dict):
        return
    rows = []
    for source, qualifier, text in _patterns(entry):
        regex, notes = annotated(text)
        if not valid(regex):
            stats.invalid += 1
            continue
        rows.append({"name": name, "pack": label, "source": source, "qualifier": qualifier, "idx": len(rows), "regex": regex, "confidence": confidence(notes), "version": notes.get("version") or None})
    if not rows:
        stats.empty += 1
        return
    stats.loaded += 1
    stats.patterns += len(rows)
    pack.pattern += rows
    digits = lambda v: [int(c) for c in (v if isinstance(v, list) else [v]) if str(c).isdigit()]
    own = {"name": name, "pack": label, "categories": digits(entry.get("cats") or []), "pricing": strings(entry.get("pricing")), "saas": bool(entry.get("saas")), "oss": bool(entry.get("oss"))}
    pack.tech.append(own | {k: entry[k] if isinstance(entry.get(k), str) else None for k in ("website", "cpe")})
    for kind in ("implies", "requires", "excludes"):
        targets = [annotated(t)[0].strip() for t in strings(entry.get(kind))]
        pack.edge += [{"name": name, "kind": kind, "target": t, "category": None, "pos": i} for i, t in enumerate(x for x in targets if x)]
    # numbers are honoured here, as packs give numbers
    pack.edge += [{"name": name, "kind": "requires_category", "target": None, "category": c, "pos": i} for i, c in enumerate(digits(entry.get("requiresCategory") or []))]


def _json_files(folder: Path, skip: tuple[str, ...] = ("categories", "groups")) -> Iterable[tuple[str, dict]]:
    """The folder's JSON objects in the order of names; broken files are skipped with a warning."""
    for path in sorted(folder.glob("*.json")) if folder.is_dir() else []:
        if path.stem in skip:
            continue
        try:
            value = json.loads(path.read_text("utf-8"))
        except (OSError, ValueError) as e:
            log.warning("skipped %s: %s", path, e)
            continue
        if isinstance(value, dict):
            yield path.name, value


def fingerprint_pack(folder: Path = HERE / "fingerprints", label: str = "wappalyzer") -> Pack:
    """A folder of fingerprint files; ``label`` names the pack. The small pack here is replaced by a full one's folder."""
    pack, stats = Pack(), Stats(label)
    for _, entries in _json_files(folder):
        for name, entry in entries.items():
            add_entry(pack, stats, name, entry, label)
    pack.stats.append(stats)
    return pack


def library_pack(path: Path = HERE / "libraries.json", label: str = "retirejs") -> Pack:
    """A file of vulnerable libraries; URI and file name extractors match scripts, contents match html."""
    pack, stats = Pack(), Stats(label)
    try:
        entries = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError) as e:
        log.warning("skipped %s: %s", path, e)
        entries = {}
    for name, entry in entries.items():
        if name == "retire-example" or not isinstance(entry, dict):
            continue
        found = entry.get("extractors") or {}
        told = lambda key: [p.replace(VERSION_MARK, VERSION_GROUP) + "\\;version:\\1" for p in strings(found.get(key))]  # noqa: E731,B023
        add_entry(pack, stats, name, {"cats": [], "oss": True, "scriptSrc": told("uri") + told("filename"), "html": told("filecontent")}, label)
    for t in pack.tech:
        t["categories"] = [-1]
    pack.stats.append(stats)
    return pack


def overridden(*packs: Pack) -> Pack:
    """All packs, later ones replacing earlier ones' technologies of the same name altogether."""
    out, owner = Pack(), {}
    for i, p in enumerate(packs):
        owner |= {t["name"]: i for t in p.tech}
        out.stats += p.stats
    for i, p in enumerate(packs):
        for kind in ("tech", "pattern", "edge"):
            getattr(out, kind).extend(r for r in getattr(p, kind) if owner[r["name"]] == i)
    return out


TECH = "name string, pack string, categories array<int>, pricing array<string>, saas boolean, oss boolean, website string, cpe string"
PATTERN = "name string, pack string, source string, qualifier string, idx int, regex string, confidence int, version string"
EDGE = "name string, kind string, target string, category int, pos int"


def tables(spark: SparkSession, pack: Pack) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tech, pattern and edge as DataFrames."""
    return spark.createDataFrame(pack.tech, TECH), spark.createDataFrame(pack.pattern, PATTERN), spark.createDataFrame(pack.edge, EDGE)


def default_pack(root: Path = HERE) -> Pack:
    """Fingerprints, then vulnerable libraries, then the local pack."""
    return overridden(fingerprint_pack(root / "fingerprints"), library_pack(root / "libraries.json"), fingerprint_pack(root / "local", "local_biz"))


@dataclass
class Blocklist:
    suppressed: list[tuple[str, str]] = field(default_factory=list)
    rules: list[tuple[int, str, str, list[str], int, bool]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        return (
            spark.createDataFrame(self.suppressed, "name string, pack string"),
            spark.createDataFrame(self.rules, "ord int, name string, pack string, sources array<string>, cap int, corroborate boolean"),
            spark.createDataFrame([(n,) for n in self.names], "name string"),
        )


def blocklist(path: Path = HERE / "blocklist.yaml") -> Blocklist:
    """Suppressions, downgrade rules in order, names that need company; empty where the file is missing or broken."""
    import yaml

    try:
        value = yaml.safe_load(path.read_text("utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        log.warning("no blocklist: %s", e)
        return Blocklist()
    out = Blocklist()
    text = lambda e, *keys: isinstance(e, dict) and all(isinstance(e.get(k), str) for k in keys)
    out.suppressed = sorted({(e["name"], e["pack"]) for e in value.get("suppress") or [] if text(e, "name", "pack")})
    for e in value.get("downgrade") or []:
        if text(e, "name", "pack") and isinstance(e.get("only_source") or [], list) and re.fullmatch(r"[+-]?\d+", str(e.get("cap_confidence"))):
            out.rules.append((len(out.rules), e["name"], e["pack"], list(map(str, e.get("only_source") or [])), max(0, min(100, int(e["cap_confidence"]))), bool(e.get("requires_corroboration"))))
    out.names = [n for n in value.get("require_corroboration") or [] if isinstance(n, str)]
    return out


def filter_entries(entries: DataFrame, keep: DataFrame) -> DataFrame:
    """Entries (file, name, cats) with a category of ``keep`` (category)."""
    hit = entries.select("file", "name", F.explode("cats").alias("category")).join(keep, "category", "left_semi").select("file", "name").distinct()
    return entries.join(hit, ["file", "name"], "left_semi")


def referenced_groups(categories: DataFrame, groups: DataFrame, keep: DataFrame) -> DataFrame:
    """The groups (group) that kept categories (category, groups) name."""
    used = categories.join(keep, "category", "left_semi").select(F.explode("groups").alias("group")).distinct()
    return groups.join(used, "group", "left_semi")


def retention(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries in and out of each file, and in all (file null)."""
    both = entries.select("file", F.lit(1).alias("n_in"), F.lit(0).alias("n_out")).unionByName(kept.select("file", F.lit(0).alias("n_in"), F.lit(1).alias("n_out")))
    return both.rollup("file").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def unknown_categories(keep: DataFrame, categories: DataFrame) -> DataFrame:
    """U4: allowed categories that the pack does not know."""
    return keep.select("category").subtract(categories.select("category"))
