"""URL filter: longest-prefix rules first, else logistic regression on hashed character n-grams of
host and path. Scoring is one projection of built-in functions; the model is fitted in numpy on a
small labelled URL table that ships with the module.

Null url or one without `://`: host and path empty, judged by the method. Repeated rows: a result
row each. Empty table: empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
GRAM = 4
#: Weights are whole ten-thousandths, so that sums don't depend on the order of addition.
SCALE = 10_000
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: The labelled URL table: words of hosts to block and to allow, more of the latter as on the web, each put into a few shapes below.
BLOCK_WORDS = "casino-win free-bets cheap-pills poker-spins slots-bonus lotto-cash viagra-shop pills-online loan-fast payday-now sexy-chat hot-dates xxx-video crack-keys warez-zone bets-odds jackpot-spin replica-watches".split()
ALLOW_WORDS = "library news-daily garden recipes museum school weather city-guide history science blog docs journal travel music forum health-info archive bakery theatre university hospital bicycle parking maps translate dictionary poetry knitting chess football orchestra farmers weather-radar train-times city-hall repair-guide book-club hiking-trails birdwatch photo-album lecture-notes".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) of the training table."""
    paths = ["/en/12", "/de/7.html", "/fr/301/", "/es/4"]
    return [(f"{sub}{w}.example.{tld}", paths[(i + j) % 4], label) for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)) for i, w in enumerate(words) for j, (sub, tld) in enumerate((("www.", "com"), ("", "org"), ("m.", "com"), ("blog.", "org")))]


def grams(host: str, path: str) -> list[int]:
    """The buckets of a URL's n-grams; the same rule as feature_column()."""
    c = [ord(x) for x in f"^{host}{path}$"]
    out = []
    for i in range(len(c) - GRAM + 1):
        h = 0
        for x in c[i : i + GRAM]:
            h = h * 31 + x
        out.append(h % BUCKETS)
    return out


@lru_cache(1)
def weights() -> tuple[int, tuple[int, ...]]:
    """Intercept and weights of the mean over n-grams' presence, fitted by gradient descent."""
    rows = labelled_urls()
    x = np.zeros((len(rows), BUCKETS))
    for i, (host, path, _) in enumerate(rows):
        np.add.at(x[i], grams(host, path), 1.0)
    y, w, b = np.array([r[2] for r in rows], float), np.zeros(BUCKETS), 0.0
    for _ in range(400):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 0.2 * (x.T @ g / len(rows) + 0.002 * w)
        b -= 0.2 * g.mean()
    return int(round(b * SCALE)), tuple(int(round(v * SCALE)) for v in w)


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def feature_column(text: str) -> Column:
    """Buckets of the n-grams of a string column: code points, then a polynomial of each window."""
    code = f"transform(split({text}, ''), c -> cast(ascii(c) as bigint))"
    poly = "0L"
    for k in range(GRAM):
        poly = f"({poly} * 31L + codes[i + {k}])"
    return F.expr(f"transform(array({code}), codes -> CASE WHEN size(codes) >= {GRAM} THEN transform(sequence(0, size(codes) - {GRAM}), i -> cast({poly} % {BUCKETS} as int)) ELSE cast(array() as array<int>) END)[0]")


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict, points (the model's
    log-odds in ten-thousandths; above 0 is block)."""
    rules = RULES if rules is None else rules
    rest = _after_scheme(F.col("url"))
    out = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).select("page_id", rest.alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = out.select("page_id", host.alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x), x)):  # the longest is tested first, so it's wrapped last
        at, prefix = r.split("/", 1)
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith("/" + prefix)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, rules[r]).otherwise(verdict)
    intercept, w = weights()
    table = "cast(split('" + ",".join(map(str, w)) + "', ',') as array<bigint>)"
    out = out.select("*", feature_column("concat('^', host, path, '$')").alias("f"))
    points = F.expr(f"aggregate(f, cast({intercept} as bigint), (s, i) -> s + ({table})[i])")
    out = out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), points.alias("points"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("points") > 0, "block").otherwise("allow")).alias("verdict"), "points")


def oracle() -> str:
    """The same for DuckDB."""
    intercept, w = weights()
    poly = "0::BIGINT"
    for k in range(GRAM):
        poly = f"({poly} * 31 + unicode(s[i + {k}]))"
    fit, say = "", ""
    for r in sorted(RULES, key=lambda x: (-len(x), x)):
        at, prefix = r.split("/", 1)
        cond = f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{prefix}') THEN"
        fit, say = f"{fit} {cond} '{r}'", f"{say} {cond} '{RULES[r]}'"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM a),
c AS (SELECT *, '^' || host || path || '$' AS s, {list(w)} AS w FROM b),
d AS (SELECT page_id, host, path, {intercept} + coalesce(list_sum([w[CAST({poly} % {BUCKETS} AS INT) + 1] for i in range(1, length(s) - {GRAM - 2})]), 0) AS points FROM c)
SELECT page_id, host, path, CASE{fit} ELSE NULL END AS rule, CASE{say} WHEN points > 0 THEN 'block' ELSE 'allow' END AS verdict, CAST(points AS BIGINT) AS points FROM d"""
