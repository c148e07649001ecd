"""URL block and allow rules whose decisions travel along redirect and canonical-link equivalence.

DataFrame operators only. Pages that declare a canonical link or a redirect give edges between
normalised URLs; connected components over those edges are equivalence classes. A URL with a rule of
its own keeps that rule's verdict. Otherwise its class decides: an explicit allow anywhere in the
class wins over a block; a class with a block and no allow is blocked; everything else is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .components import connected_components

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rule tables up to this many rows are unrolled into one expression, larger ones are joined.
UNROLLED = 64


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tail(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(_tail(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def plain(url: Column) -> Column:
    """Scheme-free form: lower-case host, path as it stands (rules tell ``/en`` from ``/en/``), query without tracking keys, no
    fragment."""
    tail = _tail(F.trim(url))
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|gclid|fbclid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    path = path_of(F.trim(url))
    return F.when(tail.isNotNull(), F.concat(host_of(F.trim(url)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def normalised(url: Column) -> Column:
    """``plain`` without a slash at the path's end: the node of a url among its equivalents."""
    return F.regexp_replace(plain(url), r"^([^?]*?)/+(\?|$)", "$1$2")


def _without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved; ``..`` never leaves the root."""
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved(target: Column, base: Column) -> Column:
    """``target`` as an absolute url, seen from the page ``base`` (RFC 3986; dot segments of relative paths only)."""
    target, base = F.trim(target), F.trim(base)
    start = F.concat(F.lit("http://"), F.regexp_extract(_tail(base), r"^[^/?#]*", 0))
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"^/(.*/)", 1))
    relative = (
        F.when(target.startswith("#"), base).when(own == "", F.concat(start, path_of(base), rest))
        .when(own.startswith("/"), F.concat(start, _without_dots(own), rest)).otherwise(F.concat(start, _without_dots(F.concat(folder, own)), rest))
    )
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(relative)


def _split(rule: str) -> tuple[str, str]:
    at = rule.index("/")
    return rule[:at], rule[at:]


def with_rule(df: DataFrame, rules=RULES, host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: the longest rule whose host is this or a parent domain and whose path is a prefix."""
    if len(rules) <= UNROLLED:
        hit = F.lit(None).cast("struct<rule:string,verdict:string>")
        for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
            h, p = _split(rule)
            fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
            hit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
        return df.withColumn("_hit", hit).withColumns({"rule": F.col("_hit.rule"), "rule_verdict": F.col("_hit.verdict")}).drop("_hit")
    known = df.sparkSession.createDataFrame([(r, v) for r, v in rules], "_key string, _verdict string")
    sizes = sorted({len(_split(r)[1]) for r, _ in rules})
    distinct = df.select(host, path).distinct()
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(F.col(path), 1, n)) for n in sizes])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(heads), lambda p: F.concat(s, p))))
    found = (
        distinct.select(host, path, F.explode(keys).alias("_key")).join(known, "_key")
        .groupBy(host, path).agg(F.max(F.struct(F.length("_key").alias("n"), F.col("_key").alias("rule"), F.col("_verdict").alias("rule_verdict"))).alias("_hit"))
        .select(host, path, "_hit.rule", "_hit.rule_verdict")
    )
    return df.join(found, [host, path], "left")


def declared_edges(pages: DataFrame) -> DataFrame:
    """``(u, v, u_at, v_at)``: normalised and plain form of a page's url and of the target of its canonical link or of its meta
    refresh, relative ones seen from the page's url or its ``<base>``.

    Written before it is filtered: a condition on ``u`` and ``v`` would go below the projections that they come from, with every
    column spelled out wherever another names it, and one page would take thousands of regular expressions.
    """
    base = F.regexp_extract("html", r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    link = F.regexp_extract("html", r"""(?i)<link\b[^>]*?\brel\s*=\s*["']?canonical["']?[^>]*>""", 0)
    refresh = F.regexp_extract("html", r"""(?i)<meta\b[^>]*?http-equiv\s*=\s*["']?refresh["']?[^>]*>""", 0)
    canonical = F.regexp_extract(link, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    redirect = F.regexp_extract(refresh, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1)
    edges = (
        pages.select("url", base.alias("base"), F.explode(F.array(canonical, redirect)).alias("to")).where("to <> ''")
        .withColumn("base", F.when(F.col("base") != "", resolved(F.col("base"), F.col("url"))).otherwise(F.col("url")))
        .withColumn("to", resolved(F.col("to"), F.col("base")))
        .select(normalised(F.col("url")).alias("u"), normalised(F.col("to")).alias("v"), plain(F.col("url")).alias("u_at"), plain(F.col("to")).alias("v_at"))
    )
    return materialize(edges, "url-edges").where("u is not null and v is not null and u <> v")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, via_alias`` for every row of ``pages(page_id, url, html)``.

    ``edges(u, v)`` may add known redirects (normalised URLs). Null urls and urls without ``://`` have
    empty host and path, no rule, and are allowed. Repeated rows keep their rows; extra columns are
    ignored; without any edge nothing is shuffled.
    """
    links = declared_edges(pages)
    if edges is not None:
        links = materialize(links.unionByName(edges.select("u", "v", F.col("u").alias("u_at"), F.col("v").alias("v_at"))), "url-edges")
    rows = with_rule(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if links.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(False).alias("via_alias"))
    home = connected_components(links)
    # every url that was declared is judged as it stands, then the class takes allow before block
    members = links.select(F.col("u").alias("node"), F.col("u_at").alias("at")).unionByName(links.select(F.col("v").alias("node"), F.col("v_at").alias("at"))).distinct()
    url = F.concat(F.lit("http://"), F.col("at"))
    judged = with_rule(members.select("node", host_of(url).alias("host"), path_of(url).alias("path")), rules).where("rule_verdict is not null")
    own = judged.groupBy("node").agg(F.min("rule_verdict").alias("rule_verdict"))  # 'allow' sorts before 'block'
    decided = home.join(own, "node").groupBy("root").agg(F.min("rule_verdict").alias("class_verdict"))
    decided = home.join(decided, "root").select("node", "class_verdict")
    return rows.withColumn("node", normalised(F.col("url"))).join(decided, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"),
        (F.col("rule").isNull() & F.col("class_verdict").isNotNull()).alias("via_alias"),
    )
