"""URL filtering with association rules.

URLs become sets of tokens (host labels and their parts, path words with their
depth, query names).  Rules of one token are counted directly; FP-growth mines the
token sets of labelled pages together with their label for rules of several.  Rules whose
consequent is the block label are pruned by support, confidence and lift, and a rule
goes where a shorter one is as confident.

FP-growth doubles with each further token that frequent pages share, so combinations
are mined without tokens that cannot be in a minimal rule: those with full confidence by
themselves and those on too few blocked pages.  Of tokens that stand on the same labelled
pages one is mined, and in matching each of the others counts as that one.  If on as many pages as a rule
needs more than ``MAX_ITEMS`` tokens are left, FP-growth leaves out the ones beyond, the least
confident, and combinations with one of these are mined by length (``completed``).  A set is
extended only while each of its tokens keeps out a page that is not blocked: without such a token
the set would be as confident, and so would each longer one.  No combination is dropped, so
where very many tokens are shared unevenly their number sets the time.

The remaining rules form an inverted index, a hash table from each rule's rarest token to
the rules it opens, which is a constant of the plan: matching needs neither a join
nor a shuffle.  Rules beyond the size of that index are matched by a join on their
rarest token.  A list of given host and path rules comes first; the longest that
fits decides.

Defined results: a null url and one without ``://`` have an empty host and path and
match no rule.  With no labelled page there are no mined rules and the verdict is allow.
Pages are judged one by one, so a repeated page_id has as many rows; urls of any length are
taken whole; of equally confident rules any gives the confidence; columns beyond page_id and
url are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import xxhash
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, stash

#: Verdict, host and path of the given rules.
GIVEN = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
LABEL = "label=block"
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE, MIN_LIFT = 0.002, 10, 0.6, 2.0
#: At most so many mined rules are in the constant index, so that it has a bounded size; a join matches the others.
MAX_RULES = 2000
#: At most so many tokens of a page go into FP-growth, on all pages but fewer than a rule needs; ``completed`` adds the rest.
MAX_ITEMS = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def given(host: Column, path: Column, rules=GIVEN) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; equal lengths go to the longer host."""
    found = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; none for a null one."""
    h, p = host(url), path(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    parts = F.filter(F.split(h, r"[.-]"), lambda x: x != "")
    steps = F.filter(F.split(p, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+(\\.[a-z]+)?$"))
    names = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")
    every = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("part:"), x)),
        F.transform(steps, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
    )
    return F.array_distinct(every)


class Rules(list):
    """Mined rules: (tokens, confidence, support).

    ``same`` leads from a token to the one that is mined for it.  ``rest`` is what FP-growth left out; ``judge``
    asks ``completed`` for the rules of it.
    """

    same: dict[str, str] = {}
    rest: Rest | None = None


@dataclass
class Rest:
    """The rules found, and what the others are mined from.

    ``baskets`` (items, n, hits) counts labelled pages by their tokens, ``singles`` (s, good) has each token's pages
    that are not blocked, ``classes`` (same, token) the tokens that another one stands for.  In the first two a token
    follows ``0`` if FP-growth left it out, else ``1``.
    """

    rules: DataFrame
    baskets: DataFrame
    singles: DataFrame
    classes: DataFrame
    least: float
    base: float
    pages: int


def mine(labelled: DataFrame) -> Rules:
    """(url, bad) to pruned rules: tokens, confidence, support."""
    sets = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(tokens(F.col("url")).alias("items"), "bad", F.xxhash64("url").alias("h"), F.xxhash64(F.lit(1), "url").alias("g"))
    sets = stash(sets.withColumn("id", F.monotonically_increasing_id()), "labelled")
    pages, bad = sets.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return Rules()
    least, base = max(MIN_SUPPORT * pages, min(MIN_PAGES, pages)), bad / pages
    # Pages of a token as two sums of hashes: tokens with equal sums stand on the same pages.
    each = sets.select(F.explode("items").alias("token"), "bad", "h", "g").groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("hits"), F.bit_xor("h").alias("x"), F.sum(F.col("g").cast("decimal(38,0)")).alias("y"))
    each = stash(each.where(F.col("hits") >= least).withColumn("confidence", F.col("hits") / F.col("n")), "tokens")
    fits = (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") / base >= MIN_LIFT)
    rules = each.where(fits).select(F.array("token").alias("tokens"), "confidence", (F.col("hits") / pages).alias("support"))
    pages_of = ["n", "hits", "x", "y"]
    usable = each.where("hits < n").groupBy(*pages_of).agg(F.min("token").alias("token"), F.count("*").alias("tokens")).withColumn("c", F.col("hits") / F.col("n"))
    usable = stash(usable, "usable")  # its size is then known: broadcast where small, else the join can split a hot token
    classes = each.select("token", *pages_of).join(usable.where("tokens > 1").select(F.col("token").alias("same"), *pages_of), pages_of)
    classes = stash(classes.where("token <> same").select("same", "token"), "classes")
    found = sets.select("bad", "id", F.explode("items").alias("token")).join(usable.select("token", "c"), "token")
    ranked = stash(found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "token"))), "items")
    crowded = ranked.where(F.col("rank") > MAX_ITEMS).groupBy("token").count().where(F.col("count") >= least).select("token")
    crowded = stash(crowded, "crowded")
    held = ranked.join(crowded, "token", "left_anti").groupBy("id", "bad").agg(F.collect_list("token").alias("items"))
    held = stash(held.select(F.when(F.col("bad"), F.array_append("items", F.lit(LABEL))).otherwise(F.col("items")).alias("items")), "baskets")
    if held.limit(1).count():
        # Pages without a token left are not among the transactions: shares and lifts are taken of all pages here.
        total = held.count()
        model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (least - 1e-6) / total)), minConfidence=MIN_CONFIDENCE).fit(held)
        more = model.associationRules.where((F.element_at("consequent", 1) == LABEL) & (F.size("antecedent") > 1) & (F.col("confidence") / base >= MIN_LIFT))
        rules = rules.union(more.select(F.array_sort("antecedent"), "confidence", F.col("support") * total / pages))
    rules = minimal(stash(rules, "rules"))
    out = listed(rules, classes)
    if crowded.limit(1).count():
        beyond = crowded.select("token", F.lit("0").alias("mark"))
        mark = F.concat(F.coalesce("mark", F.lit("1")), "token")
        baskets = ranked.join(beyond, "token", "left").groupBy("id", "bad").agg(F.array_sort(F.collect_list(mark)).alias("items"))
        baskets = baskets.where(F.element_at("items", 1).startswith("0")).groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("hits"))
        singles = usable.join(beyond, "token", "left").select(F.array(mark).alias("s"), (F.col("n") - F.col("hits")).alias("good"))
        out.rest = Rest(rules, stash(baskets, "sets"), stash(singles, "singles"), classes, least, base, pages)
    return out


def listed(rules: DataFrame, classes: DataFrame) -> Rules:
    """The rules and the tokens that others stand for in combinations."""
    out = Rules((r["tokens"], r["confidence"], r["support"]) for r in rules.collect())
    out.sort(key=lambda r: (len(r[0]), -r[1], r[0]))
    used = rules.where(F.size("tokens") > 1).select(F.explode("tokens").alias("same")).distinct()
    out.same = {r["token"]: r["same"] for r in classes.join(used, "same", "left_semi").collect()}
    return out


def completed(rules: list) -> list:
    """``rules`` with those of the combinations that FP-growth left out.

    Level by level, native joins and grouped sums only: what is left of the pages with a set, after its last token, is
    counted by what it is.  Sets with a token that FP-growth left out are made once each, as such tokens come first.
    """
    rest = getattr(rules, "rest", None)
    if rest is None:
        return rules
    found, known = rest.rules, rest.singles

    def opened(rows: DataFrame, s: Column, tail: str, first: Column) -> DataFrame:
        """A row for each token of ``tail`` that may be next: the longer set and what follows the token."""
        at = rows.select("*", F.posexplode(tail).alias("p", "x")).where(first)
        longer = at.select(F.concat(s, F.array("x")).alias("s"), F.slice(tail, F.col("p") + 2, F.size(tail)).alias("tail"), "n", "hits")
        return stash(longer.where(F.size("tail") > 0).groupBy("s", "tail").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "sets")

    rows = opened(rest.baskets, F.array().cast("array<string>"), "items", F.col("x").startswith("0"))
    while rows.limit(1).count():
        tried = rows.select("s", F.explode("tail").alias("x"), "n", "hits").groupBy("s", "x").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        tried = tried.where(F.col("hits") >= rest.least).withColumn("t", F.concat("s", F.array("x"))).withColumn("good", F.col("n") - F.col("hits"))
        # Parts without a token that FP-growth left out were not counted here, but for single tokens.
        parts = tried.select("*", F.explode(F.transform("t", lambda x: F.array_except("t", F.array(x)))).alias("part"))
        parts = parts.where((F.size("part") == 1) | F.element_at("part", 1).startswith("0"))
        parts = parts.join(known.select(F.col("s").alias("part"), F.col("good").alias("more")), "part", "left")
        free = parts.groupBy("s", "x", "t", "n", "hits", "good").agg(F.bool_and(F.coalesce(F.col("more") > F.col("good"), F.lit(False))).alias("free")).where("free")
        free = stash(free.withColumn("confidence", F.col("hits") / F.col("n")), "free")
        fits = (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") / rest.base >= MIN_LIFT)
        plain = F.array_sort(F.transform("t", lambda x: x.substr(F.lit(2), F.length(x))))
        found = found.union(free.where(fits).select(plain, "confidence", F.col("hits") / rest.pages))
        known = free.where("good > 0").select(F.col("t").alias("s"), "good")
        nexts = free.where("good > 0").groupBy("s").agg(F.collect_list("x").alias("next"))
        before, rows = rows, opened(rows.join(nexts, "s").withColumn("tail", F.array_intersect("tail", "next")), F.col("s"), "tail", F.lit(True))
        release(before)
    return listed(minimal(stash(found, "rules")), rest.classes)


def minimal(rules: DataFrame) -> DataFrame:
    """Rules (tokens, confidence, support) of which no part is as confident.

    By length, the shortest first: what is left of a length removes longer rules in an equi-join on its rarest token.
    """
    n = F.size("tokens")
    lengths = sorted(r["n"] for r in rules.select(n.alias("n")).distinct().collect())
    for length in lengths[:-1]:
        longer = rules.where(n > length).select("tokens", "confidence", F.explode("tokens").alias("token"))
        often = longer.groupBy("token").count()
        short = rules.where(n == length).select(F.col("tokens").alias("t"), F.col("confidence").alias("c"), F.explode("tokens").alias("token")).join(often, "token")
        short = short.groupBy("t", "c").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
        gone = longer.join(short, "token").where((F.col("c") >= F.col("confidence")) & (F.size(F.array_except("t", "tokens")) == 0))
        rules = stash(rules.join(gone.select("tokens").distinct(), "tokens", "left_anti"), "rules")
    return rules


def anchored(rules: list[tuple[list[str], float, float]]) -> list[tuple[str, list[str], float]]:
    """(rarest token, tokens, confidence) of each rule."""
    frequency: dict[str, int] = {}
    for t, _, _ in rules:
        for x in t:
            frequency[x] = frequency.get(x, 0) + 1
    return [(min(t, key=lambda x: (frequency[x], x)), t, c) for t, c, _ in rules]


def opens(own: Column, rows: list[dict], fields: str) -> Column:
    """The rows whose ``x`` is one of the tokens, from a hash table of constants."""
    buckets: list[list[dict]] = [[] for _ in range(1 << max(1, 2 * len(rows) - 1).bit_length())]
    for r in rows:
        buckets[xxhash.xxh64_intdigest(r["x"].encode(), 42) % len(buckets)].append(r)  # as Spark's xxhash64
    held = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<x:string,{fields}>>>")
    return F.flatten(F.transform(own, lambda x: F.filter(F.get(held, F.pmod(F.xxhash64(x), F.lit(len(buckets))).cast("int")), lambda r: r["x"] == x)))


def matched(url: Column, rules: list[tuple[list[str], float, float]], same: dict[str, str]) -> Column:
    """The highest confidence of the rules whose tokens are all in the url; null without one."""
    if not rules:
        return F.lit(None).cast("double")
    own = tokens(url)
    if same:
        own = F.array_union(own, F.transform(opens(own, [{"x": x, "y": y} for x, y in same.items()], "y:string"), lambda r: r["y"]))
    found = opens(own, [{"x": x, "t": t, "c": c} for x, t, c in anchored(rules)], "t:array<string>,c:double")
    fits = F.filter(found, lambda r: F.size(F.array_except(r["t"], own)) == 0)
    return F.array_max(F.transform(fits, lambda r: r["c"]))


def joined(pages: DataFrame, rules: list[tuple[list[str], float, float]], same: dict[str, str]) -> DataFrame:
    """``pages`` with ``joined``, what ``matched`` gives, by a join of the tokens of distinct urls."""
    held = pages.sparkSession.createDataFrame(anchored(rules), "token string, t array<string>, c double")
    urls = pages.select("url").where("url IS NOT NULL").distinct().select("url", tokens(F.col("url")).alias("own"))
    if same:
        names = pages.sparkSession.createDataFrame(list(same.items()), "token string, same string")
        more = urls.select("url", F.explode("own").alias("token")).join(names, "token").groupBy("url").agg(F.collect_set("same").alias("more"))
        urls = urls.join(more, "url", "left").select("url", F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))).alias("own"))
    fits = urls.select("url", "own", F.explode("own").alias("token")).join(held, "token").where(F.size(F.array_except("t", "own")) == 0)
    return pages.join(fits.groupBy("url").agg(F.max("c").alias("joined")), "url", "left")


def judge(pages: DataFrame, rules: list[tuple[list[str], float, float]]) -> DataFrame:
    """(page_id, url) to page_id, host, path, rule, verdict, confidence."""
    rules = completed(rules)
    same = getattr(rules, "same", {})
    held, rest = rules[:MAX_RULES], rules[MAX_RULES:]
    if len(same) > MAX_RULES:  # only single tokens then match by themselves
        held, rest = [r for r in held if len(r[0]) == 1], [r for r in held if len(r[0]) > 1] + rest
    inline = same if len(same) <= MAX_RULES else {}
    pages = pages.select("page_id", "url")
    pages = joined(pages, rest, same) if rest else pages.withColumn("joined", F.lit(None).cast("double"))
    out = pages.select("page_id", "url", "joined", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = out.withColumn("g", given(F.col("host"), F.col("path"))).withColumn("confidence", F.greatest(matched(F.col("url"), held, inline), "joined"))
    learned = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("g.rule").alias("rule"), F.coalesce(F.col("g.verdict"), learned).alias("verdict"), "confidence")
