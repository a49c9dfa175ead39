"""URL filters by a path-template tree, with built-in columns only.

Explicit rules come first: a rule fits its host and all subdomains when the url's path starts with the
rule's path; the longest rule wins. Every other url gets the verdict of its path template.

Tree: level by level, from the root of each host, a segment stays literal if its share of bad labels differs from that of
its siblings (both with ``MIN_LABELLED`` labels at least; z test at ``Z2``, raised by twice the logarithm of the number of
segments tested under the parent, so that many siblings do not make chance differences). Literal segments then merge:
in the order of their shares, neighbours that do not differ (``Z2``) become one branch, ``[least segment+]``. All other segments,
those with too few labels included, become the wildcard ``*`` and pool their labels. Levels go on as deep as any
template has enough labels to tell segments apart. A template is blocked if its smoothed purity reaches ``PURITY``:
(bad + ``ALPHA`` * host share) / (labelled + ``ALPHA``), the host's share being smoothed likewise by that of all pages; a host
without a bad label is never blocked.

Labels of a page are those of the document that its url names by the last number of its path (``with_labels``).

Scale: only ids, hosts and paths travel, never html. Each level sums nodes with map-side combine and joins back the literal
ones; nodes of more than a thousandth of the pages are joined by broadcast (``common.keyed_join``). Merging sorts, of each
parent, one row for each distinct pair of label counts.

Defined cases: a null url or one without ``://`` has empty host and path and an empty template; null page_ids keep their
rows; pages without a number, or whose number has no label, have none; repeated pages count each, repeated labels of a
document count as bad if any is; ties of equal shares merge; paths of any depth and length are one row; without labels nothing is blocked
beyond the rules; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelink.llm.common import dropped, keyed_join, lower_ascii, written

# The explicit rules (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

MIN_LABELLED = 5
Z2 = 3.84
ALPHA = 4.0
PURITY = 0.7
NUMBER = r"/([0-9]{1,18})(?:\.[a-z]+)?/?$"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    host = lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule (host and path joined) that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later, longer rules take over
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def with_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, bad): pages with the label of the document that their url names; labels: (doc_id, bad)."""
    marks = labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    named = pages.select("page_id", "url", F.regexp_extract(url_parts(F.col("url"))[1], NUMBER, 1).try_cast("long").alias("doc_id"))
    numbered = named.where("doc_id is not null").join(marks, "doc_id", "left").select("page_id", "url", "bad")
    return numbered.unionByName(named.where("doc_id is null").select("page_id", "url", F.lit(None).cast("int").alias("bad")))


def _differ(l: Column, b: Column, other_l: Column, other_b: Column, z2) -> Column:
    """Whether two shares of bad labels differ by the z test."""
    l, b, other_l, other_b = (x.cast("double") for x in (l, b, other_l, other_b))
    p, gap = (b + other_b) / (l + other_l), b / l - other_b / other_l
    return (gap != 0) & (gap * gap >= z2 * p * (1 - p) * (1 / l + 1 / other_l))


def _literal(nodes: DataFrame) -> DataFrame:
    """(host, template, segment, token, _rows): the segments that stay, merged where alike."""
    enough = F.col("l") >= MIN_LABELLED
    parents = nodes.groupBy("host", "template").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count_if(enough).alias("m")).where(F.col("pl") >= 2 * MIN_LABELLED)
    tested = nodes.where(enough).join(parents, ["host", "template"]).where(F.col("pl") - F.col("l") >= MIN_LABELLED)
    stays = tested.where(_differ(F.col("l"), F.col("b"), F.col("pl") - F.col("l"), F.col("pb") - F.col("b"), Z2 + 2 * F.log(F.col("m").cast("double"))))
    stays = written(stays.select("host", "template", "segment", "l", "b", F.col("n").alias("_rows")))
    shapes = stays.groupBy("host", "template", "l", "b").agg(F.min("segment").alias("name"), F.count("*").alias("names"))
    line = Window.partitionBy("host", "template").orderBy(F.col("b").cast("double") / F.col("l").cast("double"), "l", "b")
    new = F.coalesce(_differ(F.col("l"), F.col("b"), F.lag("l").over(line), F.lag("b").over(line), F.lit(Z2)).cast("int"), F.lit(1))
    grouped = shapes.withColumn("new", new).withColumn("branch", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    branch = Window.partitionBy("host", "template", "branch")
    first, size = F.min("name").over(branch), F.sum("names").over(branch)
    tokens = grouped.select("host", "template", "l", "b", F.when(size == 1, first).otherwise(F.concat(F.lit("["), first, F.lit("+]"))).alias("token"))
    literal = written(stays.join(tokens, ["host", "template", "l", "b"]).select("host", "template", "segment", "token", "_rows"))
    dropped(stays)
    return literal


def templates(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, template, labelled, bad) for each page (page_id, url, bad); the result of ``written``."""
    host, path = url_parts(F.col("url"))
    bad = F.col("bad").cast("int")
    base = pages.select("page_id", host.alias("host"), path.alias("path"), bad.isNotNull().cast("int").alias("labelled"), F.coalesce(bad, F.lit(0)).alias("bad"))
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    base, level = written(base.withColumns({"segments": segments, "template": F.lit("")})), 0
    while True:
        nodes = base.where(F.size("segments") > level).groupBy("host", "template", F.get("segments", F.lit(level)).alias("segment"))
        nodes = written(nodes.agg(F.count("*").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b")))
        if nodes.groupBy("host", "template").agg(F.sum("l").alias("l")).where(F.col("l") >= 2 * MIN_LABELLED).isEmpty():
            break  # no template left whose segments could differ
        literal = _literal(nodes)
        joined = keyed_join(base.withColumn("segment", F.get("segments", F.lit(level))), literal, ["host", "template", "segment"], "left")
        token = F.concat("template", F.lit("/"), F.coalesce("token", F.lit("*")))
        nxt = written(joined.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(token)).select(base.columns))
        dropped(base, nodes, literal)
        base, level = nxt, level + 1
    rest = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - level, F.lit(0)))
    found = written(base.withColumn("template", F.concat("template", rest)).drop("segments"))
    dropped(base, nodes)
    return found


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, n_labelled, n_bad); pages: (page_id, url, bad), bad null where unknown."""
    found = templates(pages)
    sums = written(found.groupBy("host", "template").agg(F.count("*").alias("_rows"), F.sum("labelled").alias("n_labelled"), F.sum("bad").alias("n_bad")))
    hosts = sums.groupBy("host").agg(F.sum("n_labelled").alias("hl"), F.sum("n_bad").alias("hb"))
    overall = sums.agg(F.coalesce(F.sum("n_bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("n_labelled"), F.lit(0)).alias("l")).first()
    prior = overall["b"] / overall["l"] if overall["l"] else 0.0
    share = (F.col("hb") + ALPHA * prior) / (F.col("hl") + ALPHA)
    purity = (F.col("n_bad") + ALPHA * share) / (F.col("n_labelled") + ALPHA)
    known = written(sums.join(hosts, "host").select(*sums.columns, ((F.col("hb") > 0) & (purity >= PURITY)).alias("block")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = keyed_join(found, known, ["host", "template"])
    verdict = F.coalesce(verdict, F.when(F.col("block"), "block").otherwise("allow"))
    dropped(sums)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "template").alias("template"), "n_labelled", "n_bad")


ORACLE_LEVELS = 4  # segments that the SQL looks at; no url of the tables has more


def oracle(pages: str = "pages", labels: str = "labels") -> str:
    """DuckDB SQL for ``judge`` over pages (page_id, url) and labels (doc_id, quality, toxic)."""
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " ELSE NULL END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    z = "(b / l - {b} / {l}) * (b / l - {b} / {l}) >= {z2} * ((b + {b}) / (l + {l})) * (1 - (b + {b}) / (l + {l})) * (1 / l + 1 / {l}) AND b / l <> {b} / {l}"
    levels = [
        f"""marks AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM {labels} WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
t0 AS (SELECT page_id, host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS template,
    (m.bad IS NOT NULL)::INT AS labelled, coalesce(m.bad, 0) AS bad
  FROM (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM {pages}) p LEFT JOIN marks m ON m.doc_id = TRY_CAST(regexp_extract(path, '{NUMBER}', 1) AS BIGINT))"""
    ]
    for k in range(ORACLE_LEVELS):
        levels.append(f"""n{k} AS (SELECT host, template, segments[{k + 1}] AS segment, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS b FROM t{k} WHERE len(segments) > {k} GROUP BY ALL),
q{k} AS (SELECT *, sum(l) OVER w - l AS rl, sum(b) OVER w - b AS rb, count(*) FILTER (l >= {MIN_LABELLED}) OVER w AS m FROM n{k} WINDOW w AS (PARTITION BY host, template)),
k{k} AS (SELECT * FROM q{k} WHERE l >= {MIN_LABELLED} AND rl >= {MIN_LABELLED} AND {z.format(b="rb", l="rl", z2=f"({Z2} + 2 * ln(m))")}),
s{k} AS (SELECT host, template, l, b, min(segment) AS name, count(*) AS names FROM k{k} GROUP BY ALL),
r{k} AS (SELECT *, lag(l) OVER w AS rl, lag(b) OVER w AS rb FROM s{k} WINDOW w AS (PARTITION BY host, template ORDER BY b / l, l, b)),
g{k} AS (SELECT *, sum(CASE WHEN rl IS NULL OR {z.format(b="rb", l="rl", z2=Z2)} THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY b / l, l, b ROWS UNBOUNDED PRECEDING) AS branch FROM r{k}),
b{k} AS (SELECT *, CASE WHEN sum(names) OVER w = 1 THEN min(name) OVER w ELSE '[' || min(name) OVER w || '+]' END AS token FROM g{k} WINDOW w AS (PARTITION BY host, template, branch)),
t{k + 1} AS (SELECT page_id, t.host, path, segments, labelled, bad, CASE WHEN len(segments) <= {k} THEN t.template ELSE t.template || '/' || coalesce(x.token, '*') END AS template
  FROM t{k} t LEFT JOIN (SELECT s.host, s.template, s.segment, x.token FROM k{k} s JOIN b{k} x ON x.host = s.host AND x.template = s.template AND x.l = s.l AND x.b = s.b) x
  ON x.host = t.host AND x.template = t.template AND x.segment = t.segments[{k + 1}])""")
    return f"""WITH {", ".join(levels)},
s AS (SELECT *, sum(labelled) OVER w AS n_labelled, sum(bad) OVER w AS n_bad, sum(labelled) OVER h AS hl, sum(bad) OVER h AS hb, sum(labelled) OVER () AS al, sum(bad) OVER () AS ab
  FROM t{ORACLE_LEVELS} WINDOW w AS (PARTITION BY host, template), h AS (PARTITION BY host)),
j AS (SELECT *, (n_bad + {ALPHA} * ((hb + {ALPHA} * CASE WHEN al > 0 THEN ab / al ELSE 0 END) / (hl + {ALPHA}))) / (n_labelled + {ALPHA}) AS purity FROM s)
SELECT page_id, host, path, {rule} AS rule,
  {verdict} WHEN hb > 0 AND purity >= {PURITY} THEN 'block' ELSE 'allow' END AS verdict,
  host || template AS template, n_labelled::BIGINT AS n_labelled, n_bad::BIGINT AS n_bad
FROM j"""
