"""URL filters: listed rules first, then a tree of path templates for each host.

Only DataFrame functions. Pages shrink to counts for each (host, shape) before anything else is done, a shape
being the path with runs of digits as ``#``. Level by level below each host, as long as paths differ,

* a branching into many segments that are rarely seen becomes one wildcard ``*``,
* the other siblings that have labels are put in order of their share of blocked labels, smoothed towards their parent's, and neighbours
  that a test on two shares can't tell apart become one branch: ``*`` if all do, else ``~`` and a number.

Where one path is left below a branch, the rest of it is its template, so any depth is told apart. A template is
rejected when its smoothed share of blocked labels reaches one half. Shares are smoothed towards that of
the same template on all hosts of the domain (the last two names of a host), that one towards the same template's
everywhere, that one towards that of the template's shapes everywhere, in whatever templates, and that one towards what
is assumed. So a template without labels of its own is judged by its likes.

Labels are a table (url, label: 'allow' or 'block'), or else the pages on which a rule has a say, so the tree carries
over to other hosts what the rules say of paths that look alike. ``unlisted_blocked`` counts what it changes.

A null url, or one without ``://``, has an empty host and path, and is judged as such. Repeated rows each get a verdict,
an empty table an empty one. Hosts and shapes may be skewed: sums are combined before each shuffle, what is known of
a parent joins its rows in salted copies, and pages aren't grouped by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, stored, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A branching is variable from this many segments on, if they are seen less often than SUPPORT on average.
FANOUT, SUPPORT = 16, 8
#: Weight and share of blocked pages that are assumed beforehand; squared quantile of the test; share that rejects.
WEIGHT, ASSUMED, SQUARED_Z, REJECT = 2.0, 0.1, 3.84, 0.5
#: Steps into which shares are sorted before neighbours are compared; copies of what is known of a parent.
STEPS, SALTS = 64, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); rules are a parameter, a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Runs of digits as #, no empty segments."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "[0-9]+", "#"), "/+", "/"), "^/|/$", "")


def share(blocked: Column, labelled: Column, prior: Column | None = None) -> Column:
    return (blocked + F.lit(WEIGHT) * (F.lit(ASSUMED) if prior is None else prior)) / (labelled + F.lit(WEIGHT))


SUMS = ("n", "blocked", "labelled")


def _salt() -> Column:
    return F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int")


def _copies(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def branches(siblings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of siblings (host, template, segment, shapes, sums): parents (host, template, variable, single), and (host, template, segment, branch)."""
    parents = siblings.groupBy("host", "template").agg(F.count("*").alias("fan"), F.sum("shapes").alias("shapes"), *[F.sum(c).alias(f"all_{c}") for c in SUMS])
    parents = parents.withColumns({"variable": (F.col("fan") >= FANOUT) & (F.col("all_n") < F.col("fan") * SUPPORT), "single": F.col("shapes") == 1})
    told = _copies(parents.filter("not variable and not single").select("host", "template", "fan", share(F.col("all_blocked"), F.col("all_labelled")).alias("whole")))
    # nothing tells whether siblings without labels are like others, so they stay apart
    own = siblings.filter("labelled > 0").withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(told, ["host", "template", "salt"])
    own = own.withColumn("step", F.floor(share(F.col("blocked"), F.col("labelled"), F.col("whole")) * F.lit(STEPS)).cast("int"))
    steps = own.groupBy("host", "template", "fan", "step").agg(F.count("*").alias("members"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    # at most STEPS + 1 rows for each parent
    order = Window.partitionBy("host", "template").orderBy("step")
    here, past = ((F.col(b) + F.lit(WEIGHT * ASSUMED)) / (F.col(n) + F.lit(WEIGHT)) for b, n in (("b", "l"), ("b0", "l0")))
    steps = steps.withColumns({"b0": F.lag("b").over(order), "l0": F.lag("l").over(order)}).withColumn("pooled", (F.col("b") + F.col("b0") + F.lit(WEIGHT * ASSUMED)) / (F.col("l") + F.col("l0") + F.lit(WEIGHT)))
    apart = (here - past) * (here - past) > F.lit(SQUARED_Z) * F.col("pooled") * (F.lit(1.0) - F.col("pooled")) * (F.lit(1.0) / (F.col("l") + F.lit(WEIGHT)) + F.lit(1.0) / (F.col("l0") + F.lit(WEIGHT)))
    steps = steps.withColumn("group", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "template", "group")
    steps = steps.select("host", "template", "fan", "step", "group", F.sum("members").over(whole).alias("members"))
    named = own.select("host", "template", "segment", "step", "salt").join(_copies(steps), ["host", "template", "step", "salt"])
    branch = F.when((F.col("members") == F.col("fan")) & (F.col("fan") > 1), "*").when(F.col("members") == 1, F.col("segment")).otherwise(F.concat(F.lit("~"), F.col("group").cast("string")))
    return parents.select("host", "template", "variable", "single"), named.select("host", "template", "segment", branch.alias("branch"))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, blocked, labelled) with the template of each shape; as many rounds as the deepest branching has levels."""
    found, level = None, 0
    now = stored(shapes.withColumns({"template": F.lit(""), "salt": _salt()}))
    columns = ["host", "shape", *SUMS, "template"]
    while True:
        parts = F.split("shape", "/")
        more = (F.col("shape") != "") & (F.size(parts) > level)
        ended = now.filter(~more).select(columns)
        now = now.filter(more).withColumn("segment", F.get(parts, F.lit(level)))
        siblings = stored(now.groupBy("host", "template", "segment").agg(F.count("*").alias("shapes"), *[F.sum(c).alias(c) for c in SUMS]))
        if siblings.isEmpty():
            dropped(siblings)
            return ended if found is None else found.unionByName(ended)
        parents, known = branches(siblings)
        joined = now.join(_copies(parents), ["host", "template", "salt"]).join(_copies(known), ["host", "template", "segment", "salt"], "left")
        rest = F.array_join(F.slice(parts, F.lit(level + 1), F.size(parts)), "/")
        step = F.when(F.col("single"), rest).when(F.col("variable"), "*").otherwise(F.coalesce("branch", "segment"))
        placed = stored(joined.withColumn("template", F.concat("template", F.lit("/"), step)).select(*columns, "salt", "single"))
        dropped(siblings)
        ended = ended.unionByName(placed.filter("single").select(columns))
        found = ended if found is None else found.unionByName(ended)
        now, level = placed.filter("not single").drop("single"), level + 1


def domain(host: Column) -> Column:
    """The last two names of a host."""
    return F.substring_index(host, ".", -2)


def rejections(placed: DataFrame) -> DataFrame:
    """(host, template, method): shares smoothed towards the domain's, that towards everywhere's, that towards that of the template's shapes."""
    sums = [F.sum("blocked").alias("b"), F.sum("labelled").alias("l")]
    own = placed.groupBy("host", "template").agg(*sums).withColumns({"domain": domain(F.col("host")), "salt": F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")})
    near = own.groupBy("domain", "template").agg(F.sum("b").alias("nb"), F.sum("l").alias("nl")).withColumn("dealt", F.pmod(F.xxhash64("domain"), F.lit(SALTS)).cast("int"))
    far = near.groupBy("template").agg(F.sum("nb").alias("fb"), F.sum("nl").alias("fl")).withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_shapes = placed.groupBy("shape").agg(F.sum("blocked").alias("sb"), F.sum("labelled").alias("sl"))
    alike = placed.select("template", "shape").distinct().join(of_shapes, "shape").groupBy("template").agg(F.sum("sb").alias("sb"), F.sum("sl").alias("sl"))
    far = far.join(alike, "template")
    everywhere = share(F.col("fb"), F.col("fl"), share(F.col("sb"), F.col("sl")))
    prior = near.join(far, ["template", "dealt"]).select("domain", "template", share(F.col("nb"), F.col("nl"), everywhere).alias("prior"))
    whole = own.join(_copies(prior), ["domain", "template", "salt"])
    return whole.select("host", "template", F.when(share(F.col("b"), F.col("l"), F.col("prior")) >= REJECT, "block").otherwise("allow").alias("method"))


def judge(pages: DataFrame, url: str = "url", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and template; columns of these names give way.

    labels: (url, label 'allow' or 'block') that the tree learns from, in place of what the rules say of the pages.
    """
    made = ("host", "path", "rule", "verdict", "template", "shape", "listed")
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made])
    placed_at = lambda df, of: df.withColumns({"host": url_host(F.col(of)), "path": url_path(F.col(of))}).withColumn("shape", shape_of(F.col("path")))
    seen = placed_at(pages, url)
    rule, listed = rule_for(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "listed": listed})
    if labels is None:
        shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(F.when(F.col("listed") == "block", 1)).alias("blocked"), F.count("listed").alias("labelled"))
    else:
        taught = placed_at(labels.select(F.col("url").alias("_url"), F.col("label").alias("_label")), "_url").filter(F.col("_label").isin("allow", "block"))
        rows = seen.select("host", "shape", F.lit(1).alias("n"), F.lit(None).cast("string").alias("_label")).unionByName(taught.select("host", "shape", F.lit(0).alias("n"), "_label"))
        shapes = rows.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.count(F.when(F.col("_label") == "block", 1)).alias("blocked"), F.count("_label").alias("labelled"))
    # few rows next to the pages
    placed = stored(templates(shapes))
    verdicts = stored(placed.withColumn("salt", _salt()).join(_copies(rejections(placed)), ["host", "template", "salt"]).select("host", "shape", "template", "method"))
    return seen.join(verdicts, ["host", "shape"], "left").withColumn("verdict", F.coalesce("listed", "method")).drop("shape", "listed", "method")


def unlisted_blocked(judged: DataFrame) -> DataFrame:
    """(pages, unlisted, blocked): how many pages no rule lists, and how many of them the tree rejects."""
    none = F.col("rule").isNull()
    return judged.agg(F.count("*").alias("pages"), F.count_if(none).alias("unlisted"), F.count_if(none & (F.col("verdict") == "block")).alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")


#: Levels that the SQL below writes out; it is the same as long as no branching lies deeper.
SQL_LEVELS = 4


def oracle() -> str:
    """The same in SQL."""
    host, path = (f"coalesce(regexp_extract(url, '{p}', 1), '')" for p in ("(?s)^.*?://([^/?#]*)", "(?s)^.*?://[^/?#]*([^?#]*)"))
    rule, says = "", ""
    for text, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        of, _, rest = text.partition("/")
        fits = f"when (host = '{of}' or ends_with(host, '.{of}')) and starts_with(path, '/{rest}') then "
        rule, says = rule + f"{fits} '{text}' ", says + f"{fits} '{verdict}' "
    d = lambda x: f"cast({x} as double)"
    p = lambda b, n, prior=None: f"(({b} + {d(WEIGHT)} * {prior or d(ASSUMED)}) / ({n} + {d(WEIGHT)}))"
    q = lambda b, n: f"(({b} + {d(WEIGHT * ASSUMED)}) / ({n} + {d(WEIGHT)}))"
    sql = f"""with a as (select page_id, translate({host}, '{UPPER}', '{LOWER}') host, {path} path from pages),
b as (select *, case {rule} end as rule, case {says} end as listed, regexp_replace(regexp_replace(regexp_replace(path, '[0-9]+', '#', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') shape from a),
t0 as (select host, shape, count(*) n, count(*) filter (listed = 'block') blocked, count(listed) labelled, '' as template, false done from b group by host, shape)"""
    for k in range(SQL_LEVELS):
        sql += f""",
g{k} as (select *, case when not done and shape <> '' then string_split(shape, '/')[{k + 1}] end segment from t{k}),
s{k} as (select host, template, segment, count(*) shapes, sum(n) n, sum(blocked) blocked, sum(labelled) labelled from g{k} where segment is not null group by all),
p{k} as (select host, template, count(*) fan, sum(shapes) shapes, sum(n) n, {p("sum(blocked)", "sum(labelled)")} whole from s{k} group by all),
o{k} as (select s.*, fan, cast(floor({p("blocked", "labelled", "whole")} * {STEPS}) as int) step from s{k} s join p{k} q using (host, template) where not (q.fan >= {FANOUT} and q.n < q.fan * {SUPPORT}) and q.shapes > 1 and s.labelled > 0),
u{k} as (select host, template, step, count(*) members, sum(blocked) b, sum(labelled) l from o{k} group by all),
v{k} as (select *, lag(b) over w b0, lag(l) over w l0 from u{k} window w as (partition by host, template order by step)),
w{k} as (select *, (b + b0 + {d(WEIGHT * ASSUMED)}) / (l + l0 + {d(WEIGHT)}) pooled, {q("b", "l")} - {q("b0", "l0")} diff from v{k}),
x{k} as (select *, sum(case when diff * diff > {d(SQUARED_Z)} * pooled * (1e0 - pooled) * (1e0 / (l + {d(WEIGHT)}) + 1e0 / (l0 + {d(WEIGHT)})) then 1 else 0 end) over (partition by host, template order by step rows unbounded preceding) grp from w{k}),
y{k} as (select *, sum(members) over (partition by host, template, grp) of_group from x{k}),
r{k} as (select o.host, o.template, o.segment, case when of_group = fan and fan > 1 then '*' when of_group = 1 then o.segment else '~' || cast(grp as varchar) end branch from o{k} o join y{k} y on o.host = y.host and o.template = y.template and o.step = y.step),
t{k + 1} as (select g.host, g.shape, g.n, g.blocked, g.labelled, case when g.segment is null then g.template else g.template || '/' || case when q.shapes = 1 then array_to_string(string_split(g.shape, '/')[{k + 1}:], '/') when q.fan >= {FANOUT} and q.n < q.fan * {SUPPORT} then '*' else coalesce(r.branch, g.segment) end end as template, g.segment is null or q.shapes = 1 done
 from g{k} g left join p{k} q on g.host = q.host and g.template = q.template left join r{k} r on g.host = r.host and g.template = r.template and g.segment = r.segment)"""
    return sql + f""",
z as (select * from t{SQL_LEVELS}),
own as (select host, template, sum(blocked) b, sum(labelled) l, array_to_string(string_split(host, '.')[-2:], '.') as dom from z group by host, template),
near as (select dom, template, sum(b) b, sum(l) l from own group by all),
far as (select template, sum(b) b, sum(l) l from near group by all),
shaped as (select shape, sum(blocked) b, sum(labelled) l from z group by shape),
alike as (select template, sum(b) b, sum(l) l from (select distinct template, shape from z) join shaped using (shape) group by template),
prior as (select n.dom, n.template, {p("n.b", "n.l", p("f.b", "f.l", p("e.b", "e.l")))} prior from near n join far f using (template) join alike e using (template)),
verdicts as (select o.host, o.template, case when {p("o.b", "o.l", "prior")} >= {REJECT} then 'block' else 'allow' end as method from own o join prior using (dom, template))
select b.page_id, b.host, b.path, b.rule, coalesce(b.listed, v.method) verdict, v.template from b join z on b.host = z.host and b.shape = z.shape join verdicts v on z.host = v.host and z.template = v.template"""
