"""Architecture rules: globs, validation, matching of edges, and import from dependency-rule files."""

from __future__ import annotations

import functools
import json
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settle


def glob_pattern(glob: str) -> str:
    """`**` for anything, `*` and `?` within a segment, all else as it stands; anchored."""
    signs = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*|\*|\?|[^*?]+", glob)
    return "^" + "".join(signs.get(p) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in parts) + "$"


def _java_takes(spark, pattern: str) -> bool:
    if spark is None:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  py4j wraps PatternSyntaxException
        return False
    return True


def parse_rules(raw: object, spark=None) -> list[dict]:
    """The valid rules under `boundaries` of a parsed file, in order: {from, to, except, pathKind, severity, reason}.

    Without a kind a rule is a glob, without a severity an error. A rule with a field of a wrong type (null too) is
    dropped, as is one whose pattern the regex engine of the queries rejects: it would abort a query.
    """
    listed = raw.get("boundaries") if isinstance(raw, dict) else None
    out = []
    for rule in listed if isinstance(listed, list) else []:
        if not isinstance(rule, dict) or not all(isinstance(rule.get(k), str) for k in ("from", "to")):
            continue
        kind, severity, but, reason = rule.get("pathKind", "glob"), rule.get("severity", "error"), rule.get("except", []), rule.get("reason", "")
        but = [but] if isinstance(but, str) else but
        if kind not in ("glob", "regex") or severity not in ("warn", "error") or not isinstance(reason, str) or not isinstance(but, list) or not all(isinstance(x, str) for x in but):
            continue
        made = {"from": rule["from"], "to": rule["to"], "except": but, "pathKind": kind, "severity": severity, "reason": reason}
        if all(_java_takes(spark, pattern_of(p, kind)) for p in (made["from"], made["to"], *but)):
            out.append(made)
    return out


def load_rules(path: str, spark=None) -> list[dict]:
    """Rules of a JSON file; none if it is missing or malformed."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse_rules(json.load(f), spark)
    except (OSError, ValueError):
        return []


def pattern_of(pattern: str, kind: str) -> str:
    return glob_pattern(pattern) if kind == "glob" else pattern


def _hits(rule: dict, source: Column, target: Column) -> Column:
    like = lambda c, p: c.rlike(pattern_of(p, rule["pathKind"]))
    hit = like(source, rule["from"]) & like(target, rule["to"])
    for p in rule["except"]:
        hit = hit & ~like(target, p)
    return hit


def reason_of(rule: dict) -> str:
    return rule["reason"] or f"Forbidden import: {rule['from']} must not import {rule['to']}"


#: Rules to a word of a bitmap; the sign stays free.
WORD = 62


def literal_folder(pattern: str, kind: str) -> str:
    """The folder, with its slash, that all files below a glob lie in; empty where the glob tells none, and for regexes."""
    if kind != "glob":
        return ""
    bare = re.split(r"[*?]", pattern, maxsplit=1)[0]
    return bare[: bare.rfind("/") + 1]


def literal_part(pattern: str, kind: str) -> str:
    """The longest piece without wildcards of a glob, which every file that it matches has in it; empty for regexes."""
    return max(re.split(r"[*?]+", pattern), key=len) if kind == "glob" else ""


def _matches(pattern: str, kind: str) -> Column:
    """Whether the file matches: plain comparisons of bytes come before the regex."""
    hit = F.col("file").rlike(pattern_of(pattern, kind))
    for plain, piece in ((F.contains, literal_part(pattern, kind)), (F.startswith, literal_folder(pattern, kind))):
        hit = plain(F.col("file"), F.lit(piece)) & hit if piece else hit
    return hit


def file_bitmaps(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(file, from_bits, to_bits) of different files (file): which rules' from, and which rules' to but for its exceptions, match it.

    Each different pattern is a literal of the plan and looks at a file once, however many rules and edges have them; a
    file makes rows for what matches it only. Files that nothing matches are left out. Names are few bytes but much work,
    so they are dealt to a fixed number of tasks.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known: dict[tuple[str, str], int] = {}
    listed = []
    for i, rule in enumerate(rules):
        for side, what in (("from", [rule["from"]]), ("to", [rule["to"]]), ("but", rule["except"])):
            listed += [(i // WORD, 1 << i % WORD, side, known.setdefault((p, rule["pathKind"]), len(known))) for p in what]
    table = files.sparkSession.createDataFrame(listed, "word int, bit long, side string, n int")  # a row a pattern of a rule
    found = F.array_compact(F.array(*[F.when(_matches(*pattern), F.lit(n)) for pattern, n in known.items()]))
    seen = settle(files.where("file IS NOT NULL").repartition(parts, "file").select("file", found.alias("found")))  # else a filter and explode() would look twice more
    met = seen.select("file", F.explode("found").alias("n")).join(F.broadcast(table), "n")
    side = lambda x: F.max(F.col("side") == x).alias(f"is_{x}")
    sides = met.groupBy("file", "word", "bit").agg(*[side(x) for x in ("from", "to", "but")])
    words = range((len(rules) + WORD - 1) // WORD)
    bit = lambda k, on: F.coalesce(F.bit_or(F.when(on & (F.col("word") == k), F.col("bit"))), F.lit(0))
    both = {"from_bits": F.col("is_from"), "to_bits": F.col("is_to") & ~F.col("is_but")}
    return sides.groupBy("file").agg(*[F.array(*[bit(k, on) for k in words]).alias(name) for name, on in both.items()])


def _first_by_bitmaps(edges: DataFrame, rules: list[dict]) -> DataFrame:
    """Edges with rule_pos: the lowest bit that the bitmaps of both files have."""
    files = edges.select(F.explode(F.array("from_file", "to_file")).alias("file")).distinct()
    bits = settle(file_bitmaps(files, rules))
    a = bits.where(F.exists("from_bits", lambda w: w != 0)).select(F.col("file").alias("from_file"), "from_bits")
    b = bits.where(F.exists("to_bits", lambda w: w != 0)).select(F.col("file").alias("to_file"), "to_bits")
    out = edges.join(a, "from_file").join(b, "to_file")
    common = [F.col("from_bits")[k].bitwiseAND(F.col("to_bits")[k]) for k in range((len(rules) + WORD - 1) // WORD)]
    lowest = lambda w: F.bit_count(w.bitwiseXOR(w - 1)) - 1
    first = F.coalesce(*[F.when(w != 0, k * WORD + lowest(w)) for k, w in enumerate(common)])
    return out.withColumn("rule_pos", first.cast("int")).where(F.col("rule_pos").isNotNull()).select(*edges.columns, "rule_pos")


def violations(edges: DataFrame, rules: list[dict]) -> DataFrame:
    """Edges (with from_file, to_file) that a rule forbids, with rule_pos, severity, score and reason of the first that does.

    As many rules as a word has bits are one literal branch each, and the first match ends the search. More are matched
    once a file and meet as bitmaps; the result is the same.
    """
    if not rules:
        return edges.limit(0).withColumns({"rule_pos": F.lit(0), "severity": F.lit(""), "violation_score": F.lit(0.5), "reason": F.lit("")})
    if len(rules) > WORD:
        out = _first_by_bitmaps(edges, rules)
    else:
        hits = [_hits(r, F.col("from_file"), F.col("to_file")) for r in rules]
        first = functools.reduce(lambda c, x: c.when(x[1], F.lit(x[0])), enumerate(hits[1:], 1), F.when(hits[0], F.lit(0)))
        out = edges.withColumn("rule_pos", first).where(F.col("rule_pos").isNotNull())
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule_pos") + 1)
    return out.withColumns({"severity": pick([r["severity"] for r in rules]), "violation_score": pick([0.9 if r["severity"] == "error" else 0.5 for r in rules]), "reason": pick([reason_of(r) for r in rules])})


def rules_touching(rules: list[dict], file: str) -> list[tuple[int, dict]]:
    """(position, rule) of those whose from or to matches the file."""
    return [(i, r) for i, r in enumerate(rules) if any(re.search(pattern_of(r[k], r["pathKind"]), file) for k in ("from", "to"))]


# Where a project keeps its dependency rules, in the order they are looked for.
CONFIG_FILES = (
    ".dependency-cruiser.json",
    ".dependency-cruiser.cjs",
    ".dependency-cruiser.js",
    ".dependency-cruiserrc.json",
    ".dependency-cruiserrc.cjs",
    ".dependency-cruiserrc.js",
    ".dependency-cruiserrc",
)


def find_config(root: str) -> str | None:
    """The first of CONFIG_FILES that a folder has."""
    return next((p for p in (os.path.join(root, n) for n in CONFIG_FILES) if os.path.exists(p)), None)


def load_config(path: str) -> dict:
    """The parsed file. Only JSON is read: a file of another kind, which would have to be run, is a ValueError."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except ValueError:
        raise ValueError(f"{path} is not JSON; a script is not run") from None


def import_config(root: str) -> tuple[dict, list[str]]:
    """The rules file, {boundaries: [...]}, made of a project's dependency rules, and its notes; FileNotFoundError without any."""
    path = find_config(root)
    if path is None:
        raise FileNotFoundError(root)
    made, notes = from_dependency_rules(load_config(path))
    return {"boundaries": made}, notes


def from_dependency_rules(config: dict) -> tuple[list[dict], list[str]]:
    """Rules of a `forbidden` list that go from path to path, and a line for each that can't be taken or loses a part."""
    out, notes = [], []
    join = lambda p: (p[0] if len(p) == 1 else f"(?:{'|'.join(p)})") if isinstance(p, list) else p
    back = lambda p: re.search(r"\$\d", p or "")
    listed = config.get("forbidden") if isinstance(config, dict) else None
    for rule in listed if isinstance(listed, list) else []:
        name, a, b = rule.get("name") or "(unnamed)", rule.get("from") or {}, rule.get("to") or {}
        if "path" not in a or "path" not in b:
            notes.append(f"{name}: not from path to path")
            continue
        source, target, but = join(a["path"]), join(b["path"]), b.get("pathNot")
        if back(target) or back(join(but)):
            notes.append(f"{name}: refers back to a group")
            continue
        made = {"from": source, "to": target, "pathKind": "regex", "severity": "error" if rule.get("severity") == "error" else "warn"}
        made["reason"] = rule.get("comment") or rule.get("name") or f"Forbidden: {source} -> {target}"
        if but is not None:
            made["except"] = but if isinstance(but, list) else [but]
        if "pathNot" in a:
            notes.append(f"{name}: from.pathNot is left out")
        out.append(made)
    for kind in ("allowed", "required"):
        if isinstance(config, dict) and config.get(kind):
            notes.append(f"{kind}: {len(config[kind])} rules of another kind")
    return out, notes
