"""URL filters by a path-template tree, with DataFrame functions only.

Each URL is cut into host and path segments. Per host the segments are generalised: digit runs and
long hexadecimal parts become classes, and below a node (host and template so far) with many
different children every child becomes a wildcard. Labelled pages are counted per template.
From the deepest level up, sibling branches whose share of blocked pages does not differ
significantly from that of their siblings together are merged, with what is below them.

The labels are the verdicts of the rules, whatever host they fit. What they say of a template
crosses hosts: the share of blocked pages of a template, over all hosts that have it, smoothed
towards that of the node above and so on up to all labelled pages, is what the template's own
branch on a host is smoothed towards. A template is rejected if that smoothed share is PURITY or
more, so a host without a rule is judged by the templates it shares with hosts that have one.

All statistics are over rows (host, template) with counts, never over lists of pages, so a hot
host costs a few partially aggregated rows; verdicts go back to the pages by a join on host and
segments, whose small side is broadcast up to BROADCAST_FORMS rows; beyond that adaptive
execution splits the join where one of them is hot.

Edge cases: a null URL or one without "://" has empty host and path and is allowed unless a rule
fits or the templates say otherwise; a very long path is generalised level by level to DEPTH, and
what is below is its last segment; of fitting rules the longest counts, which is one (ties cannot
be); without labels all is allowed; repeated rows are judged alike; only page_id and url are read, so
other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, ascii_lower

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEPTH, MANY_CHILDREN, Z, ALPHA, PURITY = 8, 32, 1.96, 4.0, 0.7
#: The verdicts of more forms (host, segments) are not broadcast.
BROADCAST_FORMS = 10_000


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.expr("substring(u_url, length(substring_index(u_url, '://', 1)) + 4)")
    return F.when(rest == url, "").otherwise(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.expr("substring(u_url, length(substring_index(u_url, '://', 1)) + 4)")
    return F.when(rest == url, "").otherwise(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    cut = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("u_url"))
    return cut.select("page_id", host_of(F.col("u_url")).alias("host"), path_of(F.col("u_url")).alias("path"))


def rule_for(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) columns over host and path; the longest fitting rule, null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical_segments(path: Column) -> Column:
    """The non-empty segments, generalised by their form; below DEPTH levels the rest is one."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    rest = F.array_join(F.slice(parts, DEPTH + 1, F.size(parts)), "/")
    cut = F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(rest))).otherwise(parts)
    return F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F]{16,}", "{hex}"), r"[0-9]+", "{n}"))


def templates(forms: Stash, many: int = MANY_CHILDREN) -> Stash:
    """Adds `node`, the generalised segments, to rows (host, segs, ...): level by level, children
    of nodes with more than `many` different ones become '*'. As many rounds as the deepest path
    has levels, DEPTH + 1 at most."""
    depth = forms.df.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0]
    out = Stash(forms.df.withColumn("node", F.slice("segs", 1, 0)), "url-forms")
    for level in range(depth):
        seg = F.get(F.col("segs"), F.lit(level))
        wide = out.df.where(seg.isNotNull()).groupBy("host", "node").agg(F.count_distinct(seg).alias("children")).where(F.col("children") > many).select("host", "node", F.lit(True).alias("wide"))
        here = F.when(seg.isNull(), F.col("node")).otherwise(F.concat("node", F.array(F.when(F.col("wide"), "*").otherwise(seg))))
        deeper = Stash(out.df.join(wide, ["host", "node"], "left").select(*forms.df.columns, here.alias("node")), "url-forms")
        out.drop()
        out = deeper
    return out


def merged(nodes: DataFrame, depth: int, z: float = Z) -> Stash:
    """Adds `branch` to rows (host, node, n, blocked): the node with merged segments as '~'. At each
    level, the deepest first, a labelled branch is compared with its labelled siblings together by
    the two-proportion z test, and merged with those like it, if the two are not significantly
    apart."""
    out = Stash(nodes.withColumn("branch", F.col("node")), "url-branches")
    for level in range(depth, 0, -1):
        deep = F.size("branch") >= level
        per = out.df.where(deep).groupBy("host", F.slice("branch", 1, level).alias("at")).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        per = per.withColumn("above", F.slice("at", 1, level - 1))
        whole = per.groupBy("host", "above").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
        rest_n, rest_b = F.col("all_n") - F.col("n"), F.col("all_blocked") - F.col("blocked")
        pooled = F.try_divide("all_blocked", "all_n")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), rest_n)))
        gap = F.abs(F.try_divide("blocked", "n") - F.try_divide(rest_b, rest_n))
        # null, so not alike, where either side has no labelled page
        alike = per.join(whole, ["host", "above"]).where(gap <= z * spread).select("host", "at", F.lit(True).alias("alike"))
        at = out.df.withColumn("at", F.when(deep, F.slice("branch", 1, level)))
        joined = F.concat(F.slice("branch", 1, level - 1), F.array(F.lit("~")), F.slice("branch", level + 1, F.size("branch")))
        up = Stash(at.join(alike, ["host", "at"], "left").select("host", "node", "n", "blocked", F.when(F.col("alike"), joined).otherwise(F.col("branch")).alias("branch")), "url-branches")
        out.drop()
        out = up
    return out


def shares(nodes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(node, prior) from rows (host, node, n, blocked): the share of blocked pages of a template
    over all hosts, each level smoothed towards the one above it."""
    n0, b0 = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    per = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    levels = F.when(F.size("node") > 0, F.sequence(F.lit(1), F.size("node"))).otherwise(F.array().cast("array<int>"))
    above = per.select("node", "n", "blocked", F.explode_outer(levels).alias("level")).withColumn("at", F.slice("node", 1, F.coalesce("level", F.lit(0))))
    pooled = above.where("level is not null").groupBy("at").agg(F.sum("n").alias("at_n"), F.sum("blocked").alias("at_blocked"))
    # at most DEPTH + 1 levels a node
    path = above.join(pooled, "at", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "at_n", "at_blocked")))).alias("path"))
    prior = F.aggregate("path", F.lit(b0 / max(n0, 1)), lambda p, x: (x["at_blocked"] + alpha * p) / (x["at_n"] + alpha))
    return path.select("node", prior.alias("prior"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, alpha: float = ALPHA, purity: float = PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for pages (page_id, url)."""
    rule, says = rule_for(rules)
    rows = parsed(pages).withColumn("rule", rule).withColumn("says", says).withColumn("segs", lexical_segments(F.col("path")))
    forms = rows.groupBy("host", "segs").agg(F.count("says").alias("n"), F.count(F.when(F.col("says") == "block", 1)).alias("blocked"))
    plain = Stash(forms, "url-forms")
    forms = templates(plain)
    plain.drop()
    nodes = Stash(forms.df.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")), "url-nodes")
    depth = nodes.df.agg(F.coalesce(F.max(F.size("node")), F.lit(0))).first()[0]
    branches = merged(nodes.df, depth)
    pooled = branches.df.groupBy("host", "branch").agg(F.sum("n").alias("n_"), F.sum("blocked").alias("blocked_"))
    smooth = (F.col("blocked_") + alpha * F.col("prior")) / (F.col("n_") + alpha)
    per_node = branches.df.join(pooled, ["host", "branch"]).join(shares(nodes.df, alpha), "node").select("host", "node", (smooth >= purity).alias("rejected"))
    template = F.concat(F.lit(""), *[F.array_join(F.transform("node", lambda s: F.concat(F.lit("/"), s)), "")])
    per_form = Stash(forms.df.select("host", "segs", "node").join(per_node, ["host", "node"]).select("host", "segs", template.alias("template"), "rejected"), "url-verdicts")
    for used in (forms, nodes, branches):
        used.drop()
    known = F.broadcast(per_form.df) if per_form.df.count() <= BROADCAST_FORMS else per_form.df
    verdict = F.coalesce("says", F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.join(known, ["host", "segs"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    rule, says = "NULL", "NULL"
    for text, verdict in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rule, says = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    down, up, priors = [], [], []
    for k in range(1, DEPTH + 2):
        down += [
            f"w{k} AS MATERIALIZED (SELECT host, node FROM t{k - 1} WHERE len(segs) >= {k} GROUP BY host, node HAVING count(DISTINCT segs[{k}]) > {MANY_CHILDREN})",
            f"t{k} AS MATERIALIZED (SELECT t.host, t.segs, t.n, t.blocked, CASE WHEN len(t.segs) < {k} THEN t.node ELSE list_append(t.node, CASE WHEN w.host IS NOT NULL THEN '*' ELSE t.segs[{k}] END) END AS node FROM t{k - 1} t LEFT JOIN w{k} w ON t.host = w.host AND t.node = w.node)",
        ]
        priors += [
            f"x{k} AS MATERIALIZED (SELECT node[1:{k}] AS pre, sum(n) AS n, sum(blocked) AS blocked FROM nodes WHERE len(node) >= {k} GROUP BY 1)",
            f"q{k} AS MATERIALIZED (SELECT q.node, CASE WHEN x.pre IS NULL THEN q.prior ELSE (x.blocked + {ALPHA}::DOUBLE * q.prior) / (x.n + {ALPHA}::DOUBLE) END AS prior FROM q{k - 1} q LEFT JOIN x{k} x ON len(q.node) >= {k} AND q.node[1:{k}] = x.pre)",
        ]
    last = DEPTH + 1
    for k in range(last, 0, -1):
        above = f"pre[1:{k - 1}]" if k > 1 else "1"
        before = f"m.branch[1:{k - 1}]" if k > 1 else "[]::VARCHAR[]"
        rest = "(all_n - n)"
        up += [
            f"p{k} AS MATERIALIZED (SELECT host, branch[1:{k}] AS pre, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(blocked) AS DOUBLE) AS blocked FROM m{k + 1} WHERE len(branch) >= {k} GROUP BY 1, 2)",
            f"s{k} AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY host, {above}) AS all_n, sum(blocked) OVER (PARTITION BY host, {above}) AS all_b FROM p{k})",
            f"a{k} AS MATERIALIZED (SELECT host, pre FROM s{k} WHERE n > 0 AND all_n > n AND abs(blocked / n - (all_b - blocked) / {rest}) <= {Z}::DOUBLE * sqrt(all_b / all_n * (1 - all_b / all_n) * (1 / n + 1 / {rest})))",
            f"m{k} AS MATERIALIZED (SELECT m.host, m.node, m.n, m.blocked, CASE WHEN a.host IS NULL THEN m.branch ELSE {before} || ['~'] || m.branch[{k + 1}:] END AS branch FROM m{k + 1} m LEFT JOIN a{k} a ON m.host = a.host AND len(m.branch) >= {k} AND m.branch[1:{k}] = a.pre)",
        ]
    return f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, contains(coalesce(url, ''), '://') AS ok, substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3) AS rest FROM pages
), h AS (
  SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u
), r AS (
  SELECT *, {rule} AS rule, {says} AS says, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM h
), p AS MATERIALIZED (
  SELECT page_id, host, path, rule, says,
    list_transform(CASE WHEN len(parts) > {DEPTH} THEN list_append(parts[1:{DEPTH}], array_to_string(parts[{DEPTH + 1}:], '/')) ELSE parts END, lambda s: regexp_replace(regexp_replace(s, '[0-9a-fA-F]{{16,}}', '{{hex}}', 'g'), '[0-9]+', '{{n}}', 'g')) AS segs FROM r
), t0 AS MATERIALIZED (
  SELECT host, segs, count(says) AS n, count(*) FILTER (WHERE says = 'block') AS blocked, []::VARCHAR[] AS node FROM p GROUP BY host, segs
), {", ".join(down)}, nodes AS MATERIALIZED (
  SELECT host, node, sum(n) AS n, sum(blocked) AS blocked FROM t{last} GROUP BY host, node
), m{last + 1} AS MATERIALIZED (SELECT *, node AS branch FROM nodes
), {", ".join(up)}, pooled AS (
  SELECT host, branch, sum(n) AS n, sum(blocked) AS blocked FROM m1 GROUP BY host, branch
), q0 AS MATERIALIZED (
  SELECT DISTINCT node, (SELECT CAST(coalesce(sum(blocked), 0) AS DOUBLE) / greatest(coalesce(sum(n), 0), 1) FROM nodes) AS prior FROM nodes
), {", ".join(priors)}, verdicts AS (
  SELECT m.host, m.node, (b.blocked + {ALPHA}::DOUBLE * q.prior) / (b.n + {ALPHA}::DOUBLE) >= {PURITY}::DOUBLE AS rejected
  FROM m1 m JOIN pooled b ON m.host = b.host AND m.branch = b.branch JOIN q{last} q ON q.node = m.node
)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.says, CASE WHEN v.rejected THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(list_transform(f.node, lambda s: '/' || s), '') AS template
FROM p JOIN t{last} f ON p.host = f.host AND p.segs = f.segs JOIN verdicts v ON v.host = f.host AND v.node = f.node
"""
