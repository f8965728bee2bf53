"""URL filters: a logistic regression on hashed character n-grams of host and path.

Host and path of a URL are cut by expressions, rules for host suffixes and path beginnings
decide where one fits (the longest wins), and the classifier decides the rest. It is
trained on the driver on the small table `LABELLED`; its weights are a constant array of
`BUCKETS` numbers, so scoring is an expression without a join or a shuffle.

Results for odd rows: a null URL, or one without `://`, has an empty host and path, and is
judged by the intercept alone; very long URLs are read whole; repeated rows get the same
verdict; an empty table gives no row. Only the key and the URL are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
SIZES = (3, 4, 5)
SEED = 42
#: How many times the others the harmless rows weigh in training: most addresses are harmless.
HARMLESS = 3.0
DIGITS, ZEROS = "123456789", "000000000"

# Labelled hosts and paths. 1 is to be blocked.
LABELLED = [
    (1, "casino-royale.example.com", "/win/now"), (1, "online-casino.example.net", "/bonus"), 
    (1, "bets-today.example.org", "/odds"), (1, "sports-betting.example.net", "/play"),
    (1, "poker-room.example.com", "/de/3"), (1, "slots-jackpot.example.net", "/spin"), (1, "jackpot-city.example.org", "/fr/51"),
    (1, "pills-online.example.org", "/en/9"), (1, "viagra-shop.example.net", "/buy"),
    (1, "pharma-discount.example.com", "/es/18"), (1, "diet-pills.example.net", "/en/8841"), 
    (1, "xxx-videos.example.com", "/en/4"), (1, "adult-dating.example.org", "/join"), (1, "porn-tube.example.net", "/de/91"),
    (1, "sex-chat.example.com", "/live"), (1, "hot-singles.example.org", "/fr/7"), 
    (1, "link-farm.example.net", "/links"), (1, "seo-spam.example.org", "/en/66"), (1, "content-spam.example.net", "/es/2"),
    (1, "track-ads.example.com", "/click"), (1, "ad-click.example.net", "/r"),
    (1, "popup-ads.example.com", "/en/550"), (1, "adserver.example.net", "/banner"), (1, "click-tracker.example.org", "/en/29"),
    (1, "free-money.example.com", "/claim"), (1, "loan-fast.example.net", "/apply"), (1, "payday-loans.example.org", "/en/5"),
    (1, "crypto-giveaway.example.com", "/double"), (1, "get-rich.example.net", "/now"), (1, "prize-winner.example.org", "/claim"),
    (1, "malware-drop.example.com", "/payload.exe"), (1, "phish-login.example.net", "/verify/account"), (1, "warez-cracks.example.org", "/keygen"),
    (1, "torrent-pirate.example.com", "/download"), (1, "fake-watches.example.net", "/replica"), (1, "www.casino-bonus.example.com", "/en/417"),
    (1, "m.pills-cheap.example.org", "/de/1200"), (1, "blog.adult-cams.example.net", "/en/38"), (1, "www.bets-win.example.com", "/fr/2207"),
    (1, "blog.spam-links.example.org", "/en/93.html"), (1, "m.ads-click.example.net", "/en/6/"), (1, "m.casino-slots.example.com", "/es/810"),
    (1, "lottery-winners.example.com", "/en/40"), (1, "bingo-hall.example.net", "/fr/12"), (1, "roulette-live.example.org", "/spin"),
    (1, "blackjack-bonus.example.com", "/de/5"), (1, "bet-odds.example.net", "/es/90"), (1, "bookmaker-tips.example.org", "/en/1"),
    (1, "wager-now.example.com", "/join"), (1, "cialis-cheap.example.net", "/buy"), (1, "steroids-shop.example.org", "/en/31"),
    (1, "pharmacy-discount.example.com", "/fr/8"), (1, "weight-loss.example.net", "/miracle"), (1, "keto-pills.example.org", "/de/63"),
    (1, "nude-cams.example.com", "/live"), (1, "escort-service.example.net", "/en/202"), (1, "erotic-videos.example.org", "/es/17"),
    (1, "webcam-girls.example.com", "/fr/4"), (1, "hookup-dating.example.net", "/en/880"), (1, "spammer-tools.example.org", "/en/7"),
    (1, "bulk-mailer.example.com", "/de/19"), (1, "backlinks-cheap.example.net", "/en/54"), (1, "click-farm.example.org", "/fr/61"),
    (1, "buy-followers.example.com", "/now"), (1, "banner-ads.example.net", "/r"), (1, "adtrack.example.org", "/en/15"),
    (1, "tracker-pixel.example.com", "/p"), (1, "adsync.example.net", "/es/3"), (1, "popunder.example.org", "/en/9"),
    (1, "free-gift.example.com", "/claim"), (1, "free-iphone.example.net", "/en/2"), (1, "win-prizes.example.org", "/de/77"),
    (1, "cash-win.example.com", "/fr/300"), (1, "quick-cash.example.net", "/en/44"), (1, "cheap-loans.example.org", "/apply"),
    (1, "cheap-watches.example.com", "/en/1200"), (1, "trojan-host.example.net", "/setup.exe"), (1, "virus-drop.example.org", "/a.exe"),
    (1, "bank-login-verify.example.com", "/account"), (1, "account-update.example.net", "/verify"), (1, "cracked-games.example.org", "/download"),
    (1, "free-movies-stream.example.com", "/watch"), (1, "bitcoin-doubler.example.net", "/en/6"), (1, "forex-signals.example.org", "/join"),
    (0, "", ""), (0, "docs.example.com", "/guide/start"), (0, "news.example.net", "/en/12"), (0, "library.example.org", "/catalogue"),
    (0, "museum.example.com", "/de/3"), (0, "city-council.example.org", "/minutes"), (0, "weather.example.net", "/en/77"),
    (0, "university.example.org", "/courses"), (0, "physics.example.com", "/fr/51"), (0, "garden.example.net", "/en/9"),
    (0, "recipes.example.com", "/soup"), (0, "history.example.org", "/es/18"), (0, "hospital.example.net", "/en/8841"),
    (0, "school.example.org", "/timetable"), (0, "music.example.com", "/en/4"), (0, "railway.example.net", "/de/91"),
    (0, "astronomy.example.org", "/moon"), (0, "bakery.example.com", "/fr/7"), (0, "archive.example.org", "/en/310"),
    (0, "theatre.example.net", "/programme"), (0, "chess.example.com", "/en/66"), (0, "forest.example.org", "/es/2"),
    (0, "harbour.example.net", "/tides"), (0, "meadow.example.com", "/en/550"), (0, "valley.example.net", "/en/29"),
    (0, "cookery.example.org", "/en/5"), (0, "painters.example.com", "/de/880"), (0, "sailing.example.net", "/fr/19"),
    (0, "www.orchard.example.org", "/en/417"), (0, "m.village.example.com", "/de/1200"), (0, "blog.brewery.example.net", "/en/38"),
    (0, "www.gallery.example.com", "/fr/2207"), (0, "blog.cycling.example.org", "/en/93.html"), (0, "m.teachers.example.net", "/en/6/"),
    (0, "m.mountain.example.com", "/es/810"), (0, "www.bridge.example.org", "/plan"), (0, "blog.painting.example.com", "/en/2"),
    (0, "m.botany.example.org", "/de/44"), (0, "blog.poetry.example.net", "/es/671"), (0, "www.gardeners.example.com", "/en/90/"),
    (0, "m.choir.example.net", "/fr/3.html"), (0, "wiki.example.org", "/en/1001"), (0, "blog.harvest.example.net", "/de/72"),
    (0, "www.letters.example.org", "/es/15"), (0, "m.islands.example.com", "/en/640"), (0, "carpentry.example.org", "/en/31888"),
    (0, "blog.lighthouse.example.com", "/en/20417"), (0, "www.weaving.example.net", "/de/9041"), (0, "m.vision.example.org", "/fr/48820"),
    (0, "cathedral.example.com", "/en/14"), (0, "farmers.example.net", "/market"), (0, "geology.example.org", "/de/21"),
    (0, "philosophy.example.com", "/fr/33"), (0, "nursery.example.net", "/en/70"), (0, "swimming.example.org", "/es/5"),
    (0, "translators.example.com", "/en/2300"), (0, "journal.example.net", "/de/410"), (0, "winter-sports.example.org", "/en/8"),
    (0, "freedom-library.example.com", "/en/19"), (0, "adventure.example.net", "/fr/2"), (0, "badminton.example.org", "/en/61"),
    (0, "link-road.example.com", "/plan"), (0, "farmhouse.example.net", "/en/12"), (0, "betterment.example.org", "/en/30"),
    (0, "trackside-museum.example.com", "/visit"), (0, "click-beetles.example.net", "/biology"), (0, "pillar-church.example.org", "/es/81"),
    (0, "window-makers.example.com", "/de/6"), (0, "adults-education.example.net", "/courses"), (0, "cheapside.example.org", "/en/55"),
    (0, "essex-county.example.com", "/council"), (0, "cashmere-wool.example.net", "/en/41"), (0, "broadcast.example.org", "/radio"),
]

#: Verdict, host and path of a rule; a rule's name is both together.
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def _lower_ascii(text: Column) -> Column:
    """A-Z in lower case, place by place, in time that follows the length."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when((c >= "A") & (c <= "Z"), F.lower(c)).otherwise(c)), "")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = _lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class UrlModel:
    weights: np.ndarray
    intercept: float

    def probability(self, host: str, path: str) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.weights[buckets(host, path)].sum()))))


def marked(host, path):
    """Both parts with marks, so that an n-gram of a host is never one of a path, and digits alike."""
    return tuple(p.translate(str.maketrans(DIGITS, ZEROS)) for p in ("^" + host + "$", "|" + path + "$"))


def buckets(host: str, path: str) -> list[int]:
    """The bucket of every n-gram; the same hash as the expression's."""
    found = []
    for part in marked(host, path):
        for n in SIZES:
            found += [xxhash.xxh64_intdigest(part[i : i + n].encode(), SEED) % BUCKETS for i in range(len(part) - n + 1)]
    return found


def train(table: list[tuple[int, str, str]] = LABELLED, penalty: float = 0.003, rounds: int = 1500) -> UrlModel:
    found = [buckets(host, path) for _, host, path in table]
    used = np.array(sorted({b for f in found for b in f}))
    x = np.zeros((len(table), len(used)))
    for row, f in zip(x, found):
        np.add.at(row, np.searchsorted(used, f), 1)
    y = np.array([label for label, _, _ in table], float)
    weight = np.where(y == 1, 1.0, HARMLESS * y.sum() / max(1.0, (1 - y).sum()))
    weight /= weight.sum()
    # weights are sums of rows, so that each round costs rows times rows, whatever the features
    alike, a, intercept, step = x @ x.T, np.zeros(len(table)), 0.0, 4.0 / (x * x).sum(1).max()
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(alike @ a + intercept))) - y) * weight
        a = a - step * (g * 8 + penalty * a)
        intercept -= step * g.sum() * 8
    w = x.T @ a
    weights = np.zeros(BUCKETS)
    weights[used] = np.round(w, 9)
    return UrlModel(weights, round(float(intercept), 9))


def probability(host: Column, path: Column, model: UrlModel) -> Column:
    """The chance that a URL is to be blocked."""
    weights = F.expr(f"cast(split('{','.join(map(repr, model.weights.tolist()))}', ',') as array<double>)")

    def total(part: Column) -> Column:
        """Weights of all n-grams; a part is cut in characters once, so that its time follows its length."""
        def weight(gram: Column) -> Column:
            return F.element_at(weights, (F.pmod(F.xxhash64(gram), F.lit(BUCKETS)) + 1).cast("int"))

        def of_size(chars: Column, n: int) -> Column:
            starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)).otherwise(F.array().cast("array<int>"))
            grams = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
            return F.aggregate(grams, F.lit(0.0), lambda z, g: z + weight(g))

        def of(chars: Column) -> Column:
            return sum((of_size(chars, n) for n in SIZES), F.lit(0.0))

        return F.transform(F.array(F.filter(F.split(part, ""), lambda c: c != "")), of)[0]

    parts = tuple(F.regexp_replace(p, "[1-9]", "0") for p in (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("|"), path, F.lit("$"))))
    z = sum((total(p) for p in parts), F.lit(model.intercept))
    return 1 / (1 + F.exp(-z))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule's place in `rules`, or null."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    fits = [F.when(((host == rules[i][1]) | F.endswith(host, F.lit("." + rules[i][1]))) & F.startswith(path, F.lit(rules[i][2])), i) for i in order]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def judge(pages: DataFrame, model: UrlModel | None = None, rules: list[tuple[str, str, str]] = RULES, url: str = "url", key: str = "page_id", cut: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict and the classifier's probability of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("probability", probability(F.col("host"), F.col("path"), model or train()))
    names = F.array(*[F.lit(h + p) for _, h, p in rules])
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules])
    own = F.when(F.col("probability") >= cut, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path",
        F.when(F.col("_rule").isNotNull(), F.get(names, F.col("_rule"))).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("_rule")), own).alias("verdict"), "probability",
    )
