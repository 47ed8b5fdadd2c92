"""URL filter: rules first, then a character language-model ratio.

URLs that a rule decides teach two smoothed variable-order Markov models, one of
accepted and one of rejected URLs.  The rest are judged by the difference of the models'
log-likelihoods per character against a threshold calibrated on taught URLs that the
counts left out.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelake.llm.common import free_name, stored

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
#: Symbols: 1 to 39 for the letters below, 0 for any other character and for the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-"
SYMBOLS = 40
#: Taught URLs in one of so many folds calibrate instead of being counted.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1)))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null without one.

    The longest rule, host and path together, wins, then the one given first.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    found = None
    for i in order:
        verdict, name, prefix = rules[i]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        hit = F.struct(F.lit(f"{name}{prefix}").alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def symbols(url: Column) -> Column:
    """One number per character; A-Z count as a-z; null is empty."""
    low = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    spread = F.split(low, "")
    return F.when(low == "", F.expr("cast(array() as array<int>)")).otherwise(
        F.transform(spread, lambda c: F.greatest(F.instr(F.lit(ALPHABET), c), F.lit(0)).cast("int"))
    )


def _codes(order: int) -> Column:
    """From a column ``s`` of symbols: per character the number of the ``order`` symbols ending with it.

    Blanks stand before the start.  The lower orders of a code are code mod ``SYMBOLS``**k.
    """
    code = None
    for k in range(order - 1, -1, -1):
        shifted = F.slice(F.concat(F.expr(f"array_repeat(0, {k})"), F.col("s")), F.lit(1), F.size("s"))
        code = shifted if code is None else F.zip_with(code, shifted, lambda x, y: x * SYMBOLS + y)
    return code


def grams(urls: DataFrame, *keep: str, order: int = ORDER) -> DataFrame:
    """``keep`` and a row per character of ``url`` with its ``code``."""
    return urls.select(*keep, symbols(F.col("url")).alias("s")).select(*keep, F.explode(_codes(order)).alias("code"))


def ratios(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, ratio) for every code in ``urls`` (url, accepted): the log ratio of its last symbol.

    Only URLs whose ``accepted`` is not null are counted; the others' codes get what the shorter
    contexts say.  Witten-Bell recursion from the uniform law up: p_k = (n(context, symbol) +
    d(context) p_(k-1)) / (n(context) + d(context)), d being the symbols seen in the context;
    an unseen context leaves p_(k-1).  There are at most ``SYMBOLS``**``order`` codes
    whatever the input.
    """
    counts = stored(
        grams(urls, "accepted", order=order).groupBy("code").agg(
            F.count(F.when(F.col("accepted"), 1)).alias("n1"), F.count(F.when(~F.col("accepted"), 1)).alias("n0")
        )
    )
    model = None
    for k in range(1, order + 1):
        size = SYMBOLS**k
        level = counts.groupBy((F.col("code") % size).alias("gram")).agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)))
        level = level.withColumn("context", F.floor(F.col("gram") / SYMBOLS).cast("int"))
        totals = level.groupBy("context").agg(
            *(F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)),
            *(F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"d{c}") for c in (0, 1)),
        )
        level = level.join(totals, "context")
        if model is None:
            level = level.withColumns({"p0": F.lit(1.0 / SYMBOLS), "p1": F.lit(1.0 / SYMBOLS)})
        else:
            level = level.withColumn("low", F.col("gram") % (size // SYMBOLS)).join(model, "low")
        smooth = (
            F.when(F.col(f"t{c}") == 0, F.col(f"p{c}"))
            .otherwise((F.col(f"n{c}") + F.col(f"d{c}") * F.col(f"p{c}")) / (F.col(f"t{c}") + F.col(f"d{c}")))
            .alias(f"p{c}")
            for c in (0, 1)
        )
        model = level.select(F.col("gram").alias("low"), *smooth)
    return model.select(F.col("low").alias("code"), F.ln(F.col("p1") / F.col("p0")).alias("ratio"))


def fold(url: Column) -> Column:
    """The first 32 bits of the URL's MD5, modulo ``FOLDS``."""
    return F.conv(F.substring(F.md5(F.encode(url, "UTF-8")), 1, 8), 16, 10).cast("long") % FOLDS


def judged(pages: DataFrame, rules=RULES, order: int = ORDER, url: str = "url") -> DataFrame:
    """``pages`` with url_host, url_path, url_rule, url_score and url_verdict.

    The score is the mean log ratio per character of URLs that no rule decides (null for
    others; 0 for an empty or null URL), allowed at or above the threshold.  Equal URLs
    get equal scores, repeated rows each.  If the rules teach only one class or none the threshold
    is 0 and so is every score.  Columns of the five names are replaced, all others stay.
    """
    host, path = host_and_path(F.col(url))
    ruled = best_rule(host, path, rules)
    distinct = stored(
        pages.select(F.coalesce(F.col(url), F.lit("")).alias("url")).distinct()
        .withColumn("verdict", best_rule(*host_and_path(F.col("url")), rules)["verdict"])
        .withColumn("fold", F.when(F.col("verdict").isNotNull(), fold(F.col("url"))))
    )
    counted = distinct.select("url", F.when(F.col("fold") != 0, F.col("verdict") == "allow").alias("accepted"))
    classes = counted.agg(F.count(F.when(F.col("accepted"), 1)), F.count(F.when(~F.col("accepted"), 1))).first()
    model = stored(ratios(counted, order))
    if not all(classes):
        model = model.withColumn("ratio", F.lit(0.0))
    scored = stored(
        grams(distinct.where("verdict is null or fold = 0"), "url", "verdict", order=order)
        .join(F.broadcast(model), "code")  # at most SYMBOLS**order rows of two numbers
        .groupBy("url", "verdict").agg(F.avg("ratio").alias("score"))
    )
    threshold = _threshold(scored)
    decided, same, of_same = (free_name(pages, x) for x in ("decided", "same_url", "same_score"))
    unruled = scored.where("verdict is null").select(F.col("url").alias(same), F.col("score").alias(of_same))
    out = pages.withColumn(decided, ruled).join(
        unruled, F.col(decided).isNull() & (F.coalesce(F.col(url), F.lit("")) == F.col(same)), "left"
    )
    score = F.when(F.col(decided).isNull(), F.coalesce(of_same, F.lit(0.0)))
    verdict = F.when(score >= threshold, "allow").otherwise("block")
    return out.withColumns({
        "url_host": host, "url_path": path, "url_rule": F.col(decided)["rule"], "url_score": score,
        "url_verdict": F.coalesce(F.col(decided)["verdict"], verdict),
    }).drop(decided, same, of_same)


def _threshold(scored: DataFrame) -> float:
    """Between the classes' means on the calibrating URLs, in proportion to their spreads."""
    found = {
        r["verdict"]: (r["m"], r["s"])
        for r in scored.where("verdict is not null").groupBy("verdict")
        .agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s")).collect()
    }
    if len(found) < 2:
        return 0.0
    (m1, s1), (m0, s0) = found["allow"], found["block"]
    return (m1 + m0) / 2 if s1 + s0 == 0 else (m1 * s0 + m0 * s1) / (s1 + s0)


def oracle() -> str:
    """The same verdicts in SQL over ``pages``, for rules that teach both classes."""
    text = lambda x: "'" + x + "'"
    order = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i][1] + RULES[i][2]), i))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(*RULES[i][1:])} THEN '{RULES[i][1]}{RULES[i][2]}'" for i in order) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES) + " END"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    symbol = lambda k: f"CASE WHEN i > {k} THEN instr('{ALPHABET}', substr(low, i - {k}, 1)) ELSE 0 END"
    code = " + ".join(f"{SYMBOLS**k} * ({symbol(k)})" for k in range(ORDER))
    parts = [f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages), u AS (SELECT DISTINCT url FROM p),
rest AS (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM u),
hp AS (SELECT url, coalesce({lower("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
r AS (SELECT *, {rule} AS rule FROM hp), v AS (SELECT *, {verdict} AS verdict FROM r),
f AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {FOLDS} END AS fold, {lower("url")} AS low FROM v),
g AS (SELECT url, verdict, fold, CASE WHEN fold <> 0 THEN verdict = 'allow' END AS accepted, {code} AS code
FROM (SELECT *, unnest(range(1, length(low) + 1)) AS i FROM f)),
c AS (SELECT code, count(CASE WHEN accepted THEN 1 END) AS n1, count(CASE WHEN NOT accepted THEN 1 END) AS n0 FROM g GROUP BY code)"""]
    before = f"(SELECT 0 AS gram, 1e0 / {SYMBOLS} AS p0, 1e0 / {SYMBOLS} AS p1)"
    for k in range(1, ORDER + 1):
        p = ", ".join(f"CASE WHEN t{c} = 0 THEN p{c} ELSE (n{c} + d{c} * p{c}) / (t{c} + d{c}) END AS p{c}" for c in (0, 1))
        parts.append(f"""l{k} AS (SELECT code % {SYMBOLS**k} AS gram, sum(n0) AS n0, sum(n1) AS n1 FROM c GROUP BY 1),
x{k} AS (SELECT gram // {SYMBOLS} AS context, sum(n0) AS t0, sum(n1) AS t1, count(CASE WHEN n0 > 0 THEN 1 END) AS d0,
count(CASE WHEN n1 > 0 THEN 1 END) AS d1 FROM l{k} GROUP BY 1),
m{k} AS (SELECT l{k}.gram, {p} FROM l{k} JOIN x{k} ON l{k}.gram // {SYMBOLS} = context JOIN {before} AS b ON l{k}.gram % {SYMBOLS ** (k - 1)} = b.gram)""")
        before = f"m{k}"
    parts.append(f"""s AS (SELECT url, verdict, avg(ln(p1 / p0)) AS score FROM g JOIN m{ORDER} ON code = gram
WHERE verdict IS NULL OR fold = 0 GROUP BY url, verdict),
a AS (SELECT avg(score) AS m1, stddev_pop(score) AS s1 FROM s WHERE verdict = 'allow'),
b AS (SELECT avg(score) AS m0, stddev_pop(score) AS s0 FROM s WHERE verdict = 'block'),
h AS (SELECT (m1 * s0 + m0 * s1) / (s0 + s1) AS threshold FROM a, b),
o AS (SELECT page_id, host, path, rule, v.verdict AS ruled, CASE WHEN rule IS NULL THEN coalesce(s.score, 0e0) END AS score
FROM p JOIN v USING (url) LEFT JOIN s ON s.url = p.url AND s.verdict IS NULL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= threshold THEN {text("allow")} ELSE {text("block")} END) AS verdict,
round(score, 6) AS score FROM o, h""")
    return ", ".join(parts)
