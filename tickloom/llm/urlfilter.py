"""URL filter: host and path rules, else logistic regression on hashed character n-grams.

The features of a URL are the distinct n-grams of its host (between full stops,
`HOST_SIZES`) and of its path (`PATH_SIZES`), hashed into `BUCKETS` buckets.  Host and
path are scaled each on its own, the path to `PATH_WEIGHT`, so that a long or
harmless path doesn't dilute what a host says.  There is no constant term: a URL of
unknown n-grams has even odds, and only what has better ones is blocked.

The model is trained by gradient descent over a small labelled table, itself one Spark
SQL expression over one row; the weights become a literal of the scoring expression.  No
Python runs on the data, and no rows are shuffled.

Rules are (host, path prefix, verdict): one fits its host and all subdomains if
the URL's path starts with its path; the longest that fits wins.  A rule list is
a literal, meant for hundreds of rules.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no n-grams,
and is allowed.  Repeated rows are each judged.  An empty table gives an empty result.
Other columns aren't carried, so their names can't clash.
"""

from __future__ import annotations

import math
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST_SIZES, PATH_SIZES = (3, 4, 5), (3, 4)
PATH_WEIGHT = 0.25
BUCKETS = 1 << 16
EPOCHS, RATE, DECAY = 300, 0.1, 0.01
BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))

#: The small labelled table: invented hosts, each with a path that may say nothing.
LABELLED = (
    *((x, 1.0) for x in (
        "ads.site.test/banner/1", "ad-track.shop.test/click", "track.ads.test/pixel.gif", "adserver.media.test/popup", "www.ads-network.test/en/12",
        "m.ads-click.test/fr/7.html", "banner-ads.promo.test/view", "click.tracker.test/redirect", "blog.ads-serve.test/de/77", "tracker.stats.test/en/9",
        "pixel.track.test/beacon", "www.adtrack.test/es/31", "popup.casino.test/win", "casino-bonus.test/free-spins", "www.casino-royal.test/en/204",
        "m.casinos.test/de/5.html", "slots-casino.test/fr/18", "poker-casino.test/en/66", "bet-slots.test/jackpot", "sport-bets.test/en/41",
        "www.bets-online.test/de/8", "m.bets.test/es/90.html", "betting-odds.test/fr/3", "poker-slots.test/en/551", "pills-online.test/buy-now",
        "www.diet-pills.test/en/17", "m.pills.test/de/402.html", "pharmacy-pills.test/fr/2", "viagra-shop.test/en/6", "cheap-viagra.test/order",
        "cheap-pills.test/order", "pills-cheap.test/buy-now", "xxx-video.test/watch", "hot-xxx.test/en/73", "www.adult-cams.test/live",
        "adult-video.test/de/15", "m.adult.test/es/8", "porn-tube.test/en/1", "win-prize.test/claim-now", "www.prize-winner.test/en/61",
        "lottery-win.test/fr/70", "m.free-prize.test/de/9", "free-money.test/click-here", "www.free-cash.test/en/38", "spam-mail.test/unsubscribe",
        "www.spam-links.test/en/27", "link-farm.test/de/64", "m.spam.test/fr/5", "content-farm.test/es/44", "farm-links.test/en/13",
        "payday-loans.test/apply", "www.fast-loans.test/en/19", "crypto-bonus.test/claim", "m.bonus-coins.test/de/21", "clickbait.test/you-wont-believe",
        "malware-crack.test/keygen",
        "m.slots-club.test/en/91", "www.lucky-slots.test/fr/12", "slots.test/de/3", "the-slots.test/es/77", "xxx.test/en/5", "www.xxx-films.test/de/40",
        "m.free-xxx.test/fr/9", "more-xxx.test/es/2", "viagra.test/de/1", "www.viagra-store.test/en/33", "m.buy-viagra.test/fr/48", "loans.test/en/16",
        "www.loans-now.test/fr/29", "m.easy-loans.test/es/54", "quick-loans.test/de/7", "casino.test/en/4", "ads.test/en/8", "www.best-ads.test/fr/61",
        "m.ads-world.test/es/23", "adult.test/fr/36", "www.adult-world.test/en/52", "spam.test/en/10", "m.spam-world.test/de/18", "pills.test/es/35",
        "www.best-pills.test/fr/80", "bets.test/de/6", "m.best-bets.test/en/99",
        "blog.casino.test/de/2", "blog.bets.test/fr/4", "blog.pills.test/en/6", "blog.adult.test/es/8", "blog.spam.test/de/10", "blog.ads.test/en/12",
        "blog.slots.test/fr/14", "blog.xxx.test/en/16", "blog.loans.test/es/18", "blog.my-bets.test/en/20", "blog.the-ads.test/fr/22",
        "blog.spam-news.test/en/24", "blog.adult-news.test/de/26", "blog.xxx-news.test/es/28",
    )),
    *((x, 0.0) for x in (
        "www.library.test/en/books/12", "blog.garden.test/en/spring.html", "news.city.test/fr/341", "docs.code.test/guide/intro.html",
        "wiki.science.test/en/physics", "www.school.test/de/lessons/7", "m.weather.test/es/today", "museum.test/en/exhibits/9",
        "recipes.kitchen.test/fr/soupe.html", "www.history.test/en/archive/1900", "blog.travel.test/de/45", "forum.music.test/en/thread/88",
        "www.health.test/en/advice/20", "science.journal.test/papers/31", "www.council.test/es/services", "shop.books.test/en/item/5",
        "poetry.test/fr/88.html", "maps.region.test/de/12", "www.theatre.test/en/plays/3", "archive.letters.test/en/1850/2", "m.news.test/en/690",
        "www.language.test/es/verbs", "blog.maths.test/en/proof.html", "garden.plants.test/en/254", "www.football.test/en/results",
        "photo.nature.test/de/900", "radio.local.test/fr/emissions", "www.cinema.test/es/41", "m.kitchen.test/en/27", "the-station.test/de/61",
        "www.another.test/en/204", "blog.other.test/fr/18", "m.nation.test/de/402.html", "www.station.test/en/17", "thing.test/es/90.html",
        "healing.test/en/41", "blog.writing.test/de/77", "m.teaching.test/en/12", "www.reading.test/fr/7.html", "mother.test/en/551",
        "weather-report.test/de/8", "www.cottage.test/es/31", "roads.city.test/en/9", "www.beads.test/de/5.html", "heads-up.test/fr/3",
        "alphabets.test/en/66", "m.tracks-music.test/en/73", "www.railtrack-history.test/de/15", "farmers.market.test/en/13", "www.farmhouse.test/fr/5",
        "pillow.test/de/64", "m.caterpillar.test/en/27", "cassette.test/es/8", "www.casement.test/en/61", "windows.house.test/en/38", "m.wind.test/fr/70",
        "priced-books.test/de/21", "free-library.test/en/19", "www.freedom.test/es/44", "adults-learning.school.test/en/6",
        "www.loan-of-books.library.test/en/1", "bonus-chapter.books.test/fr/2", "clicking.clock.test/en/7", "spanish.school.test/es/12",
        "m.spaniel.test/en/4", "www.ethnic-food.test/en/88",
        "www.badge-makers.test/de/31", "shadows.test/fr/12", "m.spaces.test/en/90", "spare-parts.test/es/6", "www.saddles.test/en/22", "adage.test/de/14",
        "headlands.test/en/37", "spanner-works.test/fr/8", "www.stickers.test/es/25", "bricks.test/en/58", "mortar-and-brick.test/de/47",
        "m.adapter.test/fr/33",
        "blog.river.test/en/3", "blog.travelling.test/fr/44", "blog.gardener.test/de/5", "blog.painter.test/es/16", "blog.singer.test/en/27", "blog.northward.test/fr/38",
        "blog.summer.test/de/49", "blog.wonder.test/es/50", "blog.library.test/en/61", "blog.upland.test/de/72", "blog.city-news.test/en/83", "blog.history.test/fr/94",
    )),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def buckets(text: Column, kind: str, sizes: tuple[int, ...]) -> Column:
    """The distinct buckets (from 0) of a text's n-grams."""

    def of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: i <= F.length(text) - n + 1)
        return F.transform(starts, lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(kind), F.substring(text, i, n)).cast("binary")), 1, 4), 16, 10).cast("int"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def features(host: Column, path: Column) -> tuple[Column, Column]:
    """The buckets of the host, and those of the path."""
    return buckets(F.concat(F.lit("."), host, F.lit(".")), "h", HOST_SIZES), buckets(path, "p", PATH_SIZES)


def train(spark: SparkSession, labelled=LABELLED) -> dict[int, float]:
    """The weights of the buckets that the labelled table has.  labelled: (host and path, 1 for
    block or 0); it is small, so one task has all of it."""
    rows = spark.createDataFrame([(k, *split(x), float(y)) for k, (x, y) in enumerate(labelled)], "k int, host string, path string, y double").coalesce(1)

    def scaled(own: Column, weight: float) -> Column:
        return F.transform(own, lambda b: F.struct(b.alias("b"), (F.lit(weight) / F.sqrt(F.size(own))).alias("v")))

    host, path = features(F.col("host"), F.col("path"))
    cells = rows.select("k", "y", F.explode(F.concat(scaled(host, 1.0), scaled(path, PATH_WEIGHT))).alias("e")).groupBy("k", "y", "e.b").agg(F.sum("e.v").alias("v"))
    cells = cells.withColumns({"i": F.dense_rank().over(Window.orderBy("k")) - 1, "j": F.dense_rank().over(Window.orderBy("b")) - 1})

    def lists(kind: int, at: str, other: str, bucket: Column, y: Column) -> DataFrame:
        own = cells.groupBy(F.lit(kind).alias("kind"), F.col(at).alias("at"), bucket.alias("b"), y.alias("y"))
        return own.agg(F.sort_array(F.collect_list(F.struct(F.col(other).alias("at"), "v"))).alias("f"))

    both = lists(0, "j", "i", F.col("b"), F.lit(0.0)).unionByName(lists(1, "i", "j", F.lit(0), F.col("y")))
    # Columns of an aggregate: what the steps read isn't worked out anew in each.
    table = both.agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "b", "y", "f")))).alias(n) for k, n in enumerate(("columns", "lines"))])
    step = f"""
      aggregate(sequence(1, {EPOCHS}), array_repeat(0D, size(columns)), (w, i) ->
        element_at(transform(
          array(transform(lines, x -> x.y - 1D / (1D + exp(-aggregate(x.f, 0D, (t, e) -> t + e.v * get(w, e.at)))))),
          r -> zip_with(w, columns, (a, c) -> a * {1 - RATE * DECAY}D + {RATE}D * aggregate(c.f, 0D, (t, e) -> t + e.v * get(r, e.at)))), 1))"""
    model = table.select("columns.b", F.expr(step).alias("w")).first()  # one row of a fixed size
    return dict(zip(model["b"], model["w"], strict=True))


def split(text: str) -> tuple[str, str]:
    """Host and path of a labelled text."""
    host, slash, path = text.partition("/")
    return host, slash + path


def margin(host: Column, path: Column, weights: dict[int, float]) -> Column:
    """Log odds of block."""
    # Of literals only: the optimizer makes one array of them, once.
    w = F.expr(f"array({','.join(f'{weights.get(k, 0)!r}D' for k in range(BUCKETS))})")

    def part(own: Column) -> Column:
        return F.aggregate(own, F.lit(0.0), lambda a, k: a + F.get(w, k)) / F.sqrt(F.greatest(F.size(own), F.lit(1)))

    return part(host) + F.lit(PATH_WEIGHT) * part(path)


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct rule, verdict; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    hits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in ordered
    ]
    return F.coalesce(*hits)


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    weights = train(pages.sparkSession, labelled)
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", fitting(F.col("host"), F.col("path"), rules))
    # The model sees only what no rule fits; its buckets are worked out once.
    own = [F.when(F.col("hit").isNull(), x) for x in features(F.col("host"), F.col("path"))]
    rows = rows.withColumns({"h": own[0], "p": own[1]})
    model = F.when(margin(F.col("h"), F.col("p"), weights) > 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), model).alias("verdict"))


def plain_features(host: str, path: str) -> dict[int, float]:
    """The features of a URL in plain Python."""
    out: dict[int, float] = {}
    for kind, text, sizes, weight in (("h", f".{host}.", HOST_SIZES, 1.0), ("p", path, PATH_SIZES, PATH_WEIGHT)):
        own = {int(md5((kind + text[i : i + n]).encode()).hexdigest()[:4], 16) for n in sizes for i in range(len(text) - n + 1)}
        for k in own:
            out[k] = out.get(k, 0.0) + weight / math.sqrt(len(own))
    return out


def plain_model(labelled=LABELLED) -> dict[int, float]:
    """The same training in plain Python: what tests and the SQL to compare with take."""
    examples = [(plain_features(*split(x)), y) for x, y in labelled]
    w = dict.fromkeys(sorted({k for f, _ in examples for k in f}), 0.0)
    for _ in range(EPOCHS):
        step = dict.fromkeys(w, 0.0)
        for f, y in examples:
            r = y - 1 / (1 + math.exp(-sum(w[k] * v for k, v in f.items())))
            for k, v in f.items():
                step[k] += r * v
        w = {k: a * (1 - RATE * DECAY) + RATE * step[k] for k, a in w.items()}
    return w


def oracle(pages: str = "pages") -> str:
    """The verdicts in DuckDB's SQL, with the weights as a table."""
    weights = ", ".join(f"({k}, {v!r})" for k, v in plain_model().items())
    grams = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS kind, ('0x' || substr(md5('{kind}' || substr(t, i::INT, {n})), 1, 4))::INT AS k FROM (SELECT r, {text} AS t, unnest(range(1, length({text}) - {n} + 2)) AS i FROM cut)"
        for kind, text, sizes in (("h", "('.' || host || '.')", HOST_SIZES), ("p", "path", PATH_SIZES))
        for n in sizes
    )
    fits = " UNION ALL ".join(
        f"SELECT r, '{h}{p}' AS rule, '{v}' AS verdict FROM cut WHERE (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')" for h, p, v in RULES
    )
    return f"""
WITH weights(k, w) AS (VALUES {weights}),
rest AS (SELECT row_number() OVER () AS r, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM {pages}),
cut AS (SELECT r, page_id, translate(regexp_extract(x, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM ({fits}) GROUP BY r),
grams AS (SELECT DISTINCT r, kind, k FROM ({grams})),
part AS (SELECT g.r, g.kind, coalesce(sum(w.w), 0) / sqrt(count(*)) * (CASE g.kind WHEN 'p' THEN {PATH_WEIGHT} ELSE 1 END) AS m FROM grams g LEFT JOIN weights w ON g.k = w.k GROUP BY g.r, g.kind),
margin AS (SELECT r, sum(m) AS m FROM part GROUP BY r)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, CASE WHEN coalesce(m.m, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM cut c LEFT JOIN fit f ON c.r = f.r LEFT JOIN margin m ON c.r = m.r
"""
