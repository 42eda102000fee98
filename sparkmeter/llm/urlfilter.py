"""URL filter by a path-template tree, in DataFrame functions only.

Every host has a tree of path templates. Segments are first generalised by their form (digit runs and long
hexadecimal strings become ``*``). Then, level by level from the root, siblings are merged into ``*``: all of a
variable node, which has very many thin branches; thin branches of any node; and branches that are statistically
alike, that is, have labels enough for a test to tell a difference of ``DELTA`` and a labelled bad share within ``z``
standard errors of their node's. A branch with few labels keeps its segment. A template's bad share is smoothed towards
its host's, and that towards the whole corpus's; a template at or over ``reject`` is blocked. Fixed rules stand
above the method.

Pages are aggregated to (host, lexical template) with map-side combine before anything else, so a host with
a third of all pages is a few rows from there on; counts cover all pages and all labels. Paths of any depth are
followed to their end: a path that is alone at its node is done there, and a chain of nodes with one child each is passed in one step, so there are as many rounds as branchings on a way.

Results for odd input: a null url and a url without ``://`` have empty host and path, hence the template of
the empty host; a null page id keeps its row and has no label; repeated pages each give a row; several labels
of a page count as one, bad if any of them is; without labels nothing is blocked by the method; extra columns
are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Smoothing weight, rejection threshold, standard errors, the difference that a test must be able to tell and the least labels for one.
ALPHA, REJECT, Z, DELTA, TESTED = 4.0, 0.5, 2.0, 0.25, 8
#: Children of a variable node (more than), and rows of a branch that is not thin.
MANY, SUPPORT = 20, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def lexical(path: Column) -> Column:
    """Array of a path's segments, generalised by form."""
    segments = F.split(path, "/")
    segments = F.when(F.size(segments) > 1, F.slice(segments, 2, F.size(segments))).otherwise(F.array().cast("array<string>"))
    return F.transform(segments, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "*")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest fixed rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _joined(segments: Column) -> Column:
    """Segments as a path, each with a slash before it."""
    return F.array_join(F.transform(segments, lambda x: F.concat(F.lit("/"), x)), "")


def templates(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", label_id: str = "doc_id") -> DataFrame:
    """One row for each host and lexical template: its final template, bad share and verdict.

    ``pages``: ``id_col``, host, path. ``labels``: ``label_id``, quality (0 is bad), toxic (1 is bad).
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    known = labels.where("quality is not null or toxic is not null").groupBy(F.col(label_id).alias("id")).agg(F.max(bad).alias("bad"))
    rows = pages.select(F.col(id_col).alias("page"), "host", lexical(F.col("path")).alias("lex"))
    rows = rows.join(known, rows["page"] == known["id"], "left")
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    counted = rows.groupBy("host", "lex").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    base = saved(counted)
    total = base.agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    prior = (total["bad"] or 0) / total["lab"] if total["lab"] else 0.0
    active, tables, done = base.withColumns({"prefix": F.lit(""), "depth": F.lit(0)}), [base], []
    while True:
        # what all paths of a node share goes on in one step: a node with one child keeps its segment as it is
        rest = F.expr("slice(lex, depth + 1, greatest(size(lex) - depth, 0))")
        nodes = active.groupBy("host", "prefix").agg(F.count("*").alias("paths"), F.min(rest).alias("low"), F.max(rest).alias("high"))
        alike = F.zip_with("low", F.expr("slice(high, 1, size(low))"), lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(alike, False)
        shared = F.when(F.col("paths") > 1, F.when(first > 0, first - 1).otherwise(F.size(alike))).otherwise(0).cast("int")
        active = active.join(nodes, ["host", "prefix"]).withColumn("shared", shared)
        active = active.withColumn("prefix", F.concat("prefix", _joined(F.expr("slice(lex, depth + 1, shared)")))).withColumn("depth", F.col("depth") + F.col("shared"))
        active = saved(active.withColumn("open", (F.col("paths") > 1) & (F.size("lex") > F.col("depth"))).drop("low", "high", "shared"))
        tables.append(active)
        ends = active.where("not open")  # at its end, or alone at its node: the segments that are left stay as they are
        done.append(ends.select("host", "lex", "n", "lab", "bad", F.concat("prefix", _joined(rest)).alias("template")))
        now = active.where("open").withColumn("seg", F.expr("element_at(lex, depth + 1)"))
        if now.isEmpty():
            break
        child = now.groupBy("host", "prefix", "seg").agg(*sums)
        node = child.groupBy("host", "prefix").agg(F.count("*").alias("k"), *[F.sum(c).alias(f"p_{c}") for c in ("n", "lab", "bad")])
        share = (F.col("p_bad") + F.lit(prior)) / (F.col("p_lab") + 1)
        spread = share * (1 - share)
        tested = (F.col("lab") >= TESTED) & (F.lit(Z) * F.sqrt(spread) <= F.lit(DELTA) * F.sqrt("lab"))
        alike = tested & (F.abs(F.col("bad") - share * F.col("lab")) <= F.lit(Z) * F.sqrt(F.col("lab") * spread))
        variable = (F.col("k") > MANY) & (F.col("p_n") < F.col("k") * SUPPORT)
        wide = (F.col("k") > 1) & (alike | variable | (F.col("n") < SUPPORT))
        merged = child.join(node, ["host", "prefix"]).select("host", "prefix", "seg", F.when(wide, F.lit("*")).otherwise(F.col("seg")).alias("to"))
        active = now.join(merged, ["host", "prefix", "seg"]).select("host", "lex", "n", "lab", "bad", F.concat("prefix", F.lit("/"), "to").alias("prefix"), (F.col("depth") + 1).alias("depth"))
    tree = done[0]
    for more in done[1:]:
        tree = tree.union(more)
    tree = saved(tree)
    for old in tables:
        discard(old)
    by_template = tree.groupBy("host", "template").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "lab", "bad")])
    by_host = by_template.groupBy("host").agg(F.sum("t_lab").alias("h_lab"), F.sum("t_bad").alias("h_bad"))
    judged = by_template.join(by_host, "host")
    host_share = (F.col("h_bad") + F.lit(ALPHA * prior)) / (F.col("h_lab") + F.lit(ALPHA))
    bad_share = (F.col("t_bad") + F.lit(ALPHA) * host_share) / (F.col("t_lab") + F.lit(ALPHA))
    method = F.when((bad_share >= REJECT) & F.lit(bool(total["lab"])), F.lit("block")).otherwise(F.lit("allow"))
    judged = judged.withColumn("bad_share", bad_share).withColumn("method", method)
    return tree.select("host", "lex", "template").join(judged.select("host", "template", "bad_share", "method"), ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """One row for each page: ``id_col``, host, path, rule, verdict, template, bad_share.

    ``rules``: (``allow`` or ``block``, host, path); a rule fits its host and all subdomains where the url's
    path starts with the rule's, and the longest one wins.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    found = templates(parsed, labels, id_col, label_id)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = parsed.withColumn("lex", lexical(F.col("path"))).join(found, ["host", "lex"], "left")
    return rows.select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, "method").alias("verdict"), "template", "bad_share")
