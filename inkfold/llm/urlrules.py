"""URL filters: listed rules first, then association rules mined from labelled URLs.

The labels are the listed rules' own verdicts. FP-growth finds the combinations of URL tokens
that are frequent among the labelled URLs, together with their label. Rules "tokens -> label"
are pruned by support (a share MIN_SUPPORT of the labelled URLs, and LEAST_ROWS of them) and by
confidence among the labelled URLs, and where a part of the tokens is as sure alone. An inverted
index from token to rules, with a count of the tokens met, finds the rules that a URL fulfils;
the surest decides (confidence, then support), else the URL is allowed.

Mining takes all labelled rows, and is complete for antecedents of up to MAX_TOKENS tokens. FP-growth
itself knows no such limit, and URLs that share thirty query keys would have 2^30 frequent
itemsets; so where URLs have more than WIDE frequent tokens, the tokens are dealt into groups,
and each URL gives a transaction for every choice of MAX_TOKENS groups, marked with that choice.
Every antecedent lies in some choice, where its count is exact, and no transaction is wide.
Rules are pruned before any comes to the driver; there are at most (choices of MAX_TOKENS from
a URL's tokens) / MIN_SUPPORT of them.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule,
has no tokens and is allowed. Repeated rows give equal results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import columns, prepare, written

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT, LEAST_ROWS, MIN_CONFIDENCE, MAX_TOKENS = 0.002, 5, 0.9, 3
#: Frequent tokens of a URL up to which it is one transaction.
WIDE = 12


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL."""
    at = F.locate("://", url)
    rest = F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    query = F.regexp_extract(tail, r"\?([^#]*)", 1)
    return _ascii_lower(host), path, query


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones take precedence
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: host labels, path segments and query keys, each with its place; numbers look alike."""
    plain = lambda c: F.regexp_replace(c, r"\d+", "#")
    of = lambda mark, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(mark), plain(x)))
    keys = F.transform(F.split(query, "&"), lambda x: F.element_at(F.split(x, "="), 1))
    return F.array_distinct(F.concat(of("h:", F.split(host, r"\.")), of("p:", F.split(path, "/")), of("q:", keys)))


def _transactions(rank: dict[str, int], groups: int, most: int):
    """For every choice of groups, a row's tokens of these groups and its label, each marked with the choice."""
    choices = [frozenset(c) for c in combinations(range(groups), min(most, groups))]

    def run(batches):
        for batch in batches:
            out = []
            for own, verdict in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = [t for t in own if t in rank]
                for i, choice in enumerate(choices):
                    part = [f"{i} {t}" for t in known if rank[t] % groups in choice]
                    if part:
                        out.append([*part, f"{i} ={verdict}"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["items"])

    return run


def mine(
    labelled: DataFrame, *, min_support: float = MIN_SUPPORT, least_rows: int = LEAST_ROWS, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, wide: int = WIDE
) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Rules (tokens, label, confidence, support) from rows (tokens, verdict or null), surest first."""
    spark = prepare(labelled.sparkSession)
    rows = written(labelled.where("verdict is not null and size(tokens) > 0").select("tokens", "verdict"), "labelled-urls")
    total = rows.count()
    if not total:
        return []
    need = max(least_rows, math.ceil(min_support * total))
    counts = rows.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    found = sorted(((-r["n"], r["t"]) for r in counts.collect()))  # at most (tokens of a URL) / min_support
    if not found:
        return []
    # Tokens of about the same frequency, which may well go together, are dealt to different groups.
    rank = spark.sparkContext.broadcast({t: i for i, (_, t) in enumerate(found)})

    def known(batches):
        for batch in batches:
            n = max((sum(t in rank.value for t in own) for own in batch.column(0).to_pylist()), default=0)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    widest = rows.select("tokens").mapInArrow(known, "n long").agg(F.max("n")).first()[0] or 0
    groups = 1 if widest <= wide else max(max_tokens, math.ceil(max_tokens * widest / wide))

    def run(batches):
        yield from _transactions(rank.value, groups, max_tokens)(batches)

    items = written(rows.mapInArrow(run, "items array<string>"), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / max(1, items.count())).fit(items)
    plain = F.array_sort(F.transform(F.filter("items", lambda x: ~x.rlike("^[0-9]+ =")), lambda x: F.regexp_replace(x, "^[0-9]+ ", "")))
    label = F.regexp_replace(F.get(F.filter("items", lambda x: x.rlike("^[0-9]+ =")), F.lit(0)), "^[0-9]+ =", "")
    sets = model.freqItemsets.select(plain.alias("own"), label.alias("label"), "freq").where((F.size("own") > 0) & (F.size("own") <= max_tokens))
    sets = written(sets.groupBy("own", "label").agg(F.max("freq").alias("n")), "url-itemsets")  # an itemset within fewer groups is found in several choices
    every = sets.where("label is null").select("own", F.col("n").alias("among"))
    rules = sets.where("label is not null").join(every, "own").withColumn("confidence", F.col("n") / F.col("among")).where(F.col("confidence") >= min_confidence)
    rules = written(rules.select("own", "label", "n", "confidence"), "url-rules")
    places = [c for k in range(1, max_tokens) for c in combinations(range(max_tokens), k)]
    part = F.array(*(F.when(F.size("own") > max(c), F.array(*(F.get("own", F.lit(i)) for i in c))) for c in places)) if places else F.array().cast("array<array<string>>")
    parts = rules.select("own", "label", "confidence", F.explode(part).alias("part")).where("part is not null and size(part) < size(own)")
    simpler = rules.select(F.col("own").alias("part"), "label", F.col("confidence").alias("sure"))
    needless = parts.join(simpler, ["part", "label"]).where("sure >= confidence").select("own", "label").distinct()
    kept = rules.join(needless, ["own", "label"], "left_anti").collect()
    return sorted(((tuple(r["own"]), r["label"], r["confidence"], r["n"] / total) for r in kept), key=lambda r: (-r[2], -r[3], r))


class Matcher:
    """Inverted index: a rule is met when all its tokens have been seen."""

    def __init__(self, rules):
        self.rules, self.by_token = rules, defaultdict(list)
        for i, (own, *_) in enumerate(rules):
            for t in own:
                self.by_token[t].append(i)

    def __call__(self, own: list[str] | None) -> int | None:
        """The number of the surest rule that these tokens meet."""
        seen: dict[int, int] = defaultdict(int)
        for t in own or ():
            for i in self.by_token.get(t, ()):
                seen[i] += 1
        return min((i for i, n in seen.items() if n == len(self.rules[i][0])), default=None)


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence): listed rules decide, else mined ones, else allow."""
    prepare(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    own_id, url = columns([id_col, url_col])
    source = pages.select(own_id.alias("page_id"), url.cast("string").alias("url"))
    host, path, query = parts(F.col("url"))
    source = source.select("page_id", "url", host.alias("host"), path.alias("path"), query.alias("query"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    source = source.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"))
    matcher = Matcher(mine(source.select("tokens", "verdict"), **options))

    def run(batches):
        for batch in batches:
            given, own = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            hit = [None if g else matcher(t) for g, t in zip(given, own, strict=True)]
            found = [None if h is None else matcher.rules[h] for h in hit]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([g or (f[1] if f else "allow") for g, f in zip(given, found, strict=True)], pa.string()),
                    pa.array([" ".join(f[0]) if f else None for f in found], pa.string()),
                    pa.array([f[2] if f else None for f in found], pa.float64()),
                ],
                ["page_id", "host", "path", "rule", "verdict", "mined", "confidence"],
            )

    return source.drop("url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, mined string, confidence double")
