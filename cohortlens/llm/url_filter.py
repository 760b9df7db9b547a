"""Verdicts on page addresses: stated rules first, mined rules for the rest.

An address is a set of tokens (host labels, path segments, query pairs, fragment). FP-growth over
the bad labelled addresses (toxic, or of low quality) finds the token combinations that occur there
at least ``min_count`` times, at every size of the table; those that are bad in ``min_confidence``
of all labelled addresses that hold them are rules, and an address that holds all tokens of a rule
is blocked. Combinations are counted and rules found by an inverted index: every combination is
filed under its rarest token, so an address meets only those whose rarest token it holds.

Tokens that stand in exactly the same labelled addresses (the query pairs of one generator, say)
form a class, and classes are mined instead of tokens: of interchangeable tokens each combination
has the same counts, so an address holds a rule's tokens exactly if it holds one token of each of
the rule's classes. Without this, addresses that share many tokens would yield all their subsets.

Only DataFrame functions and the JVM's FP-growth are used.

Defined results: a null address, or one without ``://``, has an empty host and path, fits no
stated rule, holds no tokens and is allowed; labels other than 0 and 1, or null, say nothing bad;
an id with several labels is bad if one of them is; rows that repeat an address get the same
verdict; an address is read whole, however long; without enough bad labels nothing is mined. Every
row gives one row, an empty table none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty if it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host and path) that fits, and its verdict; else nulls.

    A rule fits its host and all subdomains where the path begins with the rule's. The list is short:
    each rule is one condition.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for stated, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(stated)).otherwise(verdict)
    return rule, verdict


def _prefixed(kind: str):
    return lambda v: F.concat(F.lit(kind), v)


def tokens(url: Column) -> Column:
    """Distinct tokens of an address, sorted."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(F.coalesce(url, F.lit("")), "#(.*)$", 1)
    parts = [("h:", F.split(host, r"\.")), ("p:", F.split(path, "/")), ("q:", F.split(query, "&")), ("f:", F.array(fragment))]
    named = [F.transform(F.filter(values, lambda v: v != ""), _prefixed(kind)) for kind, values in parts]
    found = F.array_sort(F.array_distinct(F.concat(*named)))
    return F.when(F.instr(url, "://") > 0, found).otherwise(F.expr("cast(array() as array<string>)"))


def mine(pages: DataFrame, labels: DataFrame, min_count: int = 20, min_confidence: float = 0.8) -> tuple[DataFrame, DataFrame] | None:
    """Rules (``body``: sorted classes, ``bad``, ``freq``, ``confidence``) and the classes (``token``, ``class``) they speak of.

    A combination must come with a bad label at least ``min_count`` times. None if no label can reach that.
    """
    bad = F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)))
    judged = labels.groupBy(F.col("doc_id").alias("id")).agg(bad.alias("is_bad"))
    known = pages.select(F.col("page_id").alias("id"), tokens(F.col("url")).alias("tokens")).where(F.size("tokens") > 0).join(judged, "id")
    known = staged(known.select(F.monotonically_increasing_id().alias("row"), "tokens", "is_bad"), "labelled-urls")
    if known.where("is_bad").count() < min_count:
        return None
    # Where a token stands: number of rows, and two digests of which rows.
    spread = known.select(F.explode("tokens").alias("token"), "is_bad", F.xxhash64("tokens").alias("at"))
    where = [F.count("*").alias("n"), F.sum(F.col("at").cast("decimal(38,0)")).alias("sum"), F.bit_xor("at").alias("mix")]
    classes = spread.groupBy("token").agg(*where, F.count_if("is_bad").alias("bad")).where(F.col("bad") >= min_count)
    classes = staged(classes.select("token", F.concat_ws(":", "n", "sum", "mix").alias("class")), "url-classes")
    rows = staged(with_classes(known, "row", classes).join(known.select("row", "is_bad"), "row"), "classed-urls")
    baskets = rows.where("is_bad").select(F.col("held").alias("items"))
    total = baskets.count()
    if not total:
        return None
    sets = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / total).fit(baskets).freqItemsets
    sets = staged(sets.select(F.array_sort("items").alias("body"), F.col("freq").alias("bad")), "itemsets")
    counted = matches(rows, sets).groupBy("body").agg(F.count("*").alias("freq"))
    rules = sets.join(counted, "body").withColumn("confidence", F.col("bad") / F.col("freq"))
    return staged(rules.where(F.col("confidence") >= min_confidence), "url-rules"), classes


def with_classes(rows: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """``key`` and the distinct classes ``held`` by its ``tokens``; rows without any are left out."""
    met = rows.select(key, F.explode("tokens").alias("token")).join(classes, "token")
    return met.groupBy(key).agg(F.collect_set("class").alias("held"))


def matches(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows (with ``held``) beside each ``body`` whose classes they all hold."""
    spread = bodies.select(F.explode("body").alias("item"), "body")
    uses = spread.groupBy("item").agg(F.count("*").alias("uses"))
    # The rarest class of each combination, by the number of combinations that hold it.
    index = spread.join(uses, "item").groupBy("body").agg(F.min(F.struct("uses", "item")).alias("key"))
    index = index.select(F.col("key.item").alias("item"), "body")
    met = rows.withColumn("item", F.explode("held")).join(index, "item").drop("item")
    return met.where(F.size(F.array_intersect("held", "body")) == F.size("body"))


def blocked_urls(pages: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct addresses (``url``) that hold all classes of a mined rule."""
    used = classes.join(rules.select(F.explode("body").alias("class")).distinct(), "class")
    held = pages.select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    return matches(with_classes(held, "url", used), rules.select("body")).select("url").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", **mining) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` (a mined rule blocks it) of every row."""
    found = mine(pages, labels, **mining)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key), F.col("url"), host.alias("host"), path.alias("path"))
    if found is None:
        rows = rows.withColumn("mined", F.lit(False))
    else:
        blocked = staged(blocked_urls(pages, *found), "blocked-urls").withColumn("mined", F.lit(True))
        rows = rows.join(blocked, "url", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("mined"), "block").otherwise("allow")
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "mined")


ORACLE_SQL = r"""
with cut as (
  select page_id, url, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages
), parts as (
  select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1) query,
         regexp_extract(coalesce(url, ''), '#(.*)$', 1) fragment, rest <> '' or contains(coalesce(url, ''), '://') ok from cut
), tokened as (
  select *, case when ok then list_sort(list_distinct(
      list_transform(list_filter(string_split(host, '.'), lambda v: v <> ''), lambda v: 'h:' || v)
   || list_transform(list_filter(string_split(path, '/'), lambda v: v <> ''), lambda v: 'p:' || v)
   || list_transform(list_filter(string_split(query, '&'), lambda v: v <> ''), lambda v: 'q:' || v)
   || list_transform(list_filter([fragment], lambda v: v <> ''), lambda v: 'f:' || v))) else [] end toks from parts
), judged as (
  select doc_id, bool_or(coalesce(toxic = 1 or quality = 0, false)) bad from labels group by doc_id
), known as (
  select toks, bad from tokened join judged on page_id = doc_id where len(toks) > 0
), subsets as (
  select list_filter(toks, lambda x, i: (m >> (i - 1)) & 1 = 1) body, bad
  from (select toks, bad, unnest(generate_series(1, (1 << len(toks)) - 1)) m from known)
), mined as (
  select body from subsets group by body
  having count(*) filter (where bad) >= 20
     and count(*) filter (where bad) / count(*) >= 0.8
), hit as (
  select distinct url from tokened t where exists (select 1 from mined where list_has_all(t.toks, mined.body))
), rules(verdict, rule, h, p) as (
  values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fits as (
  select t.page_id, t.url, arg_max(r.rule, length(r.rule)) rule, arg_max(r.verdict, length(r.rule)) verdict
  from (select distinct page_id, url, host, path from tokened) t join rules r
    on (t.host = r.h or ends_with(t.host, '.' || r.h)) and starts_with(t.path, r.p) group by t.page_id, t.url
)
select t.page_id, t.host, t.path, f.rule, coalesce(f.verdict, case when h.url is not null then 'block' else 'allow' end) verdict, h.url is not null mined
from tokened t left join fits f on f.page_id = t.page_id and f.url is not distinct from t.url left join hit h on h.url = t.url
"""
