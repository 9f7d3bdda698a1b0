"""URL verdicts by rules and, where no rule fits, by a tree of path templates per host.

A path is cut at its slashes. Segments are generalised by form first: runs of digits become <d>, long hexadecimal
ones <x>, those over 40 characters <long>. Then, per host, the tree is grown level by level from the counts of such paths: at a
node a segment is a branch of its own if it has at least `least` urls and `share` of the node's, all others
together are the wildcard *; branches are merged, largest first, where the kinds of segments that follow and the labels (blocked,
allowed, none) of their urls are distributed alike (Jensen-Shannon divergence of at most `alike` bits for both, with half a url
added to each kind). A merged branch is named {a|b}. A leaf's path from the root is its template. A template is rejected if
the smoothed share of blocked urls among its labelled ones, (blocked + 1) / (blocked + allowed + 2), is `reject` or
more: without labels it is 0.5, and the url is allowed. Labels are the verdicts of the rules.

Segments from the `depth`-th on are one segment <rest>, so that the number of rounds is bounded. Everything is
counted by grouped aggregates; keys that hold a large share of all rows (at most `_OFTEN` of them, by that share) are broadcast
with what belongs to them, so no join sends one host or path to one task. A node's branches are at most 1 / `share` and the wildcard.

A null url, or one without ://, has an empty host and path, and is allowed unless a rule fits. Equal urls get equal verdicts;
repeated rows are all returned and counted. An empty table gives no rows. Very long urls are judged whole by the rules, and
by <long> and <rest> in the tree. The longest fitting rule (host and path together) wins, of equal ones the first. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import lean_memory, ship, store

#: (verdict, rule): host, then the path from its slash on.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
KINDS = ["end", "slash", "digits", "word", "mixed"]
_OFTEN = 1000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; blank without."""
    found = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; NULL where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int) -> Column:
    """Generalised segments of a path, `depth` at most; none of a blank path."""
    raw = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "^/", ""), "/"))
    hexadecimal = lambda s: s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-fA-F]")
    shaped = F.transform(F.slice(raw, 1, depth), lambda s: F.when(F.length(s) > 40, "<long>").when(hexadecimal(s), "<x>").otherwise(F.regexp_replace(s, "[0-9]+", "<d>")))
    return F.when(F.size(raw) > depth, F.concat(F.slice(shaped, 1, depth - 1), F.array(F.lit("<rest>")))).otherwise(shaped)


def kind_of(segment: Column) -> Column:
    """The kind of a segment that follows another: an index of KINDS."""
    return F.when(segment.isNull(), 0).when(segment == "", 1).when(segment == "<d>", 2).when(segment.rlike(r"^[^<>\d.]+$"), 3).otherwise(4)


def matched(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the table's columns by key (unique in the table, there for every row); n: how many rows each has."""
    whole = table.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * _OFTEN >= whole  # so many keys at most
    few = F.broadcast(table.filter(often))
    hot = rows.join(few, key)
    return hot.unionByName(rows.join(few.select(key), key, "left_anti").join(table.filter(~often), key))


def divergence(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits of two arrays of counts, with a half added to each."""
    p, q = (a + 0.5) / (a + 0.5).sum(), (b + 0.5) / (b + 0.5).sum()
    m = (p + q) / 2
    return float((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)


def merged(branches: list[tuple[str, list[int], list[int]]], alike: float) -> dict[str, str]:
    """Name of the merged branch for each (segment, counts of what follows, counts of labels) of a node."""
    groups: list[tuple[list[str], np.ndarray, np.ndarray]] = []
    for segment, follows, labels in sorted(branches, key=lambda b: (-sum(b[2]), b[0])):
        f, y = np.array(follows, float), np.array(labels, float)
        for k, (names, g, z) in enumerate(groups):
            if divergence(f, g) <= alike and divergence(y, z) <= alike:
                groups[k] = ([*names, segment], g + f, z + y)
                break
        else:
            groups.append(([segment], f, y))
    return {s: names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}" for names, _, _ in groups for s in names}


def _merge_nodes(alike: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            out = []
            for node, branches in zip(batch.column("node").to_pylist(), batch.column("branches").to_pylist(), strict=True):
                names = merged([(b["segment"], b["follows"], b["labels"]) for b in branches], alike)
                out += [(node, s, name) for s, name in names.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["node", "segment", "branch"])

    return run


def grown(paths: DataFrame, least: int, share: float, alike: float, depth: int) -> DataFrame:
    """paths (key, host, s: segments, n, blocked, allowed) with their templates."""
    # a node is named by a digest of host and template: keys stay short
    at = paths.withColumn("template", F.lit("")).withColumn("node", F.md5("host"))
    for k in range(depth):
        here, done = at.filter(F.size("s") > k), at.filter(F.size("s") <= k)
        if here.isEmpty():
            break
        here = here.withColumn("segment", F.get("s", F.lit(k))).withColumn("follows", kind_of(F.get("s", F.lit(k + 1)))).withColumn("branch_key", F.md5(F.concat_ws("/", "node", "segment")))
        branches = here.groupBy("branch_key", "node", "segment").agg(
            F.sum("n").alias("n"), F.count("*").alias("rows"), F.array(*(F.sum(F.when(F.col("follows") == j, F.col("n")).otherwise(0)) for j in range(len(KINDS)))).alias("follows"),
            F.array(F.sum("blocked"), F.sum("allowed"), F.sum(F.col("n") - F.col("blocked") - F.col("allowed"))).alias("labels"),
        )
        branches = store(branches, "branches")
        nodes = branches.groupBy("node").agg(F.sum("n").alias("whole"), F.count("*").alias("_rows"))
        own = matched(branches, nodes, "node", "_rows").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("whole")))
        of_node = own.groupBy("node").agg(F.collect_list(F.struct("segment", "follows", "labels")).alias("branches"))  # 1 / share at most
        names = of_node.mapInArrow(_merge_nodes(alike), "node string, segment string, branch string").withColumn("branch_key", F.md5(F.concat_ws("/", "node", "segment")))
        table = branches.select("branch_key", "rows").join(names.select("branch_key", "branch"), "branch_key", "left").withColumn("branch", F.coalesce("branch", F.lit("*")))
        moved = matched(here.drop("follows", "segment"), store(table, "names"), "branch_key", "rows")
        moved = moved.withColumn("template", F.concat("template", F.lit("/"), "branch")).withColumn("node", F.md5(F.concat_ws("/", "node", "branch")))
        at = store(done.unionByName(moved.select(at.columns)), "paths")
    return at


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: list[str] | None = None, least: int = 20, share: float = 0.05, alike: float = 0.05, depth: int = 8, reject: float = 0.9) -> DataFrame:
    """Columns `keep` of pages with host, path, rule, verdict (allow or block), template and purity."""
    ship(pages.sparkSession)
    rows = pages.select(*(keep or []), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_own", verdict).withColumn("s", segments(F.col("path"), depth)).withColumn("key", F.md5(F.concat(F.col("host"), F.lit("/"), F.array_join("s", "/"), F.size("s").cast("string"))))
    rows = store(rows, "urls")
    paths = rows.groupBy("key", "host", "s").agg(F.count("*").alias("n"), F.count_if(F.col("_own") == "block").alias("blocked"), F.count_if(F.col("_own") == "allow").alias("allowed"))
    leaves = grown(store(paths, "paths"), least, share, alike, depth)
    of_template = leaves.groupBy("node").agg(F.count("*").alias("_rows"), ((F.sum("blocked") + 1) / (F.sum("blocked") + F.sum("allowed") + 2)).alias("purity"))
    known = matched(leaves.select("key", "n", "node", "template"), store(of_template, "purity"), "node", "_rows").select("key", "n", "template", "purity")
    out = matched(rows.drop("s"), store(known, "verdicts"), "key", "n")
    learned = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select(*(keep or []), "host", "path", "rule", F.coalesce("_own", learned).alias("verdict"), "template", "purity")


def op11(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, keep=["page_id"])
