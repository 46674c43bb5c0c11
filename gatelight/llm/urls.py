"""URL filters with redirect equivalence; DataFrame functions only.

Block rules decide on urls by host suffix and path prefix. Redirect and canonical-link edges join
urls into classes of aliases (connected components); a block of any member reaches the members that
no rule of their own decides on. An explicit allow rule keeps its urls, whatever their aliases are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.llm import common as C
from gatelight.llm.components import connected_components

# The rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\s\"'>]+)"
REFRESH = r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*?\burl\s*=\s*[\"']?([^\s\"'>]+)"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_replace(rest, r"(?s)[/?#].*", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(rest, r"(?s)^[^/?#]*|[?#].*", "")), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    Length is that of host and path together; of equally long rules an allow goes first. The list is
    part of the plan, so it is meant for rules by the hundred.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def key_of(url: Column) -> Column:
    """What makes urls the same node: host, path without closing slashes, and query."""
    query = F.regexp_replace(url, r"(?s)^[^?#]*|#.*", "")
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), query)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) keys of a page's url and the url that its canonical link or refresh names.

    Relative references to a path are taken up with the page's scheme and host.
    """
    url, html = F.col(url_col), F.col(html_col)
    origin = F.concat(F.coalesce(F.regexp_substr(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), F.lit("")), host_of(url))
    ref = lambda tag, pattern: F.regexp_replace(F.regexp_substr(tag, F.lit(pattern)), pattern, "$1")
    refs = F.array_compact(F.array(ref(F.regexp_substr(html, F.lit(LINK)), HREF), ref(html, REFRESH)))
    one = pages.where(F.instr(url, "://") > 0).where(html.rlike(LINK) | html.rlike(REFRESH))
    one = one.select(url.alias("u"), origin.alias("o"), F.explode(refs).alias("r"))
    full = F.when(F.col("r").startswith("//"), F.concat(F.substring_index("o", "//", 1), "r")).when(F.col("r").startswith("/"), F.concat("o", "r")).otherwise(F.col("r"))
    one = one.withColumn("r", full).where(F.instr("r", "://") > 0)
    return one.select(key_of(F.col("u")).alias("a"), key_of(F.col("r")).alias("b"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """`pages` with host, path, rule, alias_root and verdict (allow or block).

    Edges come from the pages' html and from `redirects` (source, target: urls). verdict is the
    rule's, or else block if any alias, an edge's end that isn't a page included, is blocked by its
    own rule, or else allow. Null urls and urls without "://" have empty host and path, no rule, and
    are allowed. Null html has no links. alias_root names the class of a url that has aliases, else
    null. Rows stay one to one; columns of these names are replaced.
    """
    edges = [link_edges(pages, url_col, html_col)] if html_col else []
    if redirects is not None:
        ends = redirects.where((F.instr("source", "://") > 0) & (F.instr("target", "://") > 0))
        edges.append(ends.select(key_of(F.col("source")).alias("a"), key_of(F.col("target")).alias("b")))
    names = ["host", "path", "rule", "alias_root", "verdict"]
    base = C.replace_columns(pages, names)
    url = F.col(f"`{url_col}`")
    base = base.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("__gl_own", rule_of(F.col("host"), F.col("path"), rules))
    all_edges = None
    for e in edges:
        all_edges = e if all_edges is None else all_edges.union(e)
    if all_edges is None:
        judged = base.withColumn("alias_root", F.lit(None).cast("string")).withColumn("__gl_hit", F.lit(None).cast("boolean"))
    else:
        roots = connected_components(all_edges)
        # a key keeps host and path but for closing slashes, which rules may name
        node = F.concat(F.lit("x://"), F.col("node"), F.when(F.instr("node", "?") > 0, "").otherwise("/"))
        nodes = roots.withColumn("own", rule_of(host_of(node), path_of(node), rules)["verdict"])
        blocked = nodes.groupBy("root").agg(F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("__gl_hit"))
        alias = roots.join(blocked, "root").select(F.col("node").alias("__gl_key"), F.col("root").alias("alias_root"), "__gl_hit")
        judged = base.withColumn("__gl_key", key_of(url)).join(alias, "__gl_key", "left").drop("__gl_key")
    verdict = F.coalesce(F.col("__gl_own.verdict"), F.when(F.col("__gl_hit"), "block"), F.lit("allow"))
    return judged.withColumn("rule", F.col("__gl_own.rule")).withColumn("verdict", verdict).drop("__gl_own", "__gl_hit")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`filter_urls` of `pages` by RULES, with the links of their html."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql_url(u: str) -> tuple[str, str]:
    rest = f"substr({u}, strpos({u}, '://') + 3)"
    host = f"CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_replace({rest}, '(?s)[/?#].*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
    path = f"CASE WHEN strpos({u}, '://') > 0 THEN regexp_replace({rest}, '(?s)^[^/?#]*|[?#].*', '', 'g') ELSE '' END"
    return host, path


def _sql_key(u: str) -> str:
    host, path = _sql_url(u)
    return rf"({host}) || regexp_replace({path}, '/+$', '') || coalesce(regexp_replace({u}, '(?s)^[^?#]*|#.*', '', 'g'), '')"


_HOST, _PATH = _sql_url("url")
_NHOST, _NPATH = _sql_url("u")
_quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_LINK, _HREF, _REFRESH = map(_quoted, (LINK, HREF, REFRESH))
_FITS = "((host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))"
OP2_SQL = rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
refs AS (
  SELECT url AS u, unnest([
    CASE WHEN regexp_matches(tag, {_HREF}) THEN regexp_replace(tag, '(?is)^.*?' || {_HREF} || '.*$', '\1') END,
    CASE WHEN regexp_matches(html, {_REFRESH}) THEN regexp_replace(html, '(?is)^.*?' || {_REFRESH} || '.*$', '\1') END]) AS r
  FROM (SELECT *, CASE WHEN regexp_matches(html, {_LINK}) THEN regexp_replace(html, '(?is)^.*?(' || {_LINK} || ').*$', '\1') END AS tag FROM pages)
  WHERE strpos(url, '://') > 0),
whole AS (
  SELECT u, CASE WHEN starts_with(r, '//') THEN split_part(u, '//', 1) || r
    WHEN starts_with(r, '/') THEN split_part(u, '//', 1) || '//' || ({_NHOST}) || r ELSE r END AS r FROM refs),
edges AS (SELECT DISTINCT {_sql_key("u")} AS a, {_sql_key("r")} AS b FROM whole WHERE strpos(r, '://') > 0),
pairs AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, root) AS (SELECT a, a FROM pairs UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON pairs.a = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
nodes AS (SELECT node, root, 'x://' || node || CASE WHEN strpos(node, '?') > 0 THEN '' ELSE '/' END AS u FROM roots),
split AS (SELECT node, root, {_NHOST} AS host, {_NPATH} AS path FROM nodes),
own AS (SELECT node, root, (SELECT r.verdict FROM rules r WHERE {_FITS} ORDER BY length(r.h || r.p) DESC, r.verdict LIMIT 1) AS verdict FROM split),
hit AS (SELECT root, bool_or(coalesce(verdict = 'block', false)) AS blocked FROM own GROUP BY root),
alias AS (SELECT node, blocked FROM own JOIN hit USING (root)),
parts AS (SELECT page_id, {_sql_key("url")} AS k, {_HOST} AS host, {_PATH} AS path FROM pages),
ruled AS (SELECT page_id, k, host, path,
  (SELECT r.h || r.p FROM rules r WHERE {_FITS} ORDER BY length(r.h || r.p) DESC, r.verdict LIMIT 1) AS rule,
  (SELECT r.verdict FROM rules r WHERE {_FITS} ORDER BY length(r.h || r.p) DESC, r.verdict LIMIT 1) AS v FROM parts)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN alias ON node = k
"""
