"""URL filter (operator 10): rules first, then logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table that
has nothing from the pages it judges.

Defined cases: a null url, or one without ``://``, has an empty host and path
and gets the model's verdict on them (allow); repeated rows are judged one by
one; an empty table gives no rows; extra columns pass through, except those
named like an output.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DIMENSIONS, GRAMS = 1 << 14, (3, 4, 5)

#: (verdict, host, path): the longest that fits decides
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Host and path of unwanted sites: gambling, pills, loans, forged goods, link sellers, adverts, adult, stolen software. Invented.
UNWANTED = """
lucky-casino.test/slots/7 royalcasino.test/bonus poker-jackpot.test/join/2 roulette-online.test/play mega-jackpot.test/win
slotmachine.test/spin betting-tips.test/odds/today sportsbet24.test/live bingo-bonus.test/claim lotto-winners.test/prize
discount-pharmacy.test/order/3 pills4less.test/buy pharma-outlet.test/cart dietpills.test/offer weightloss-miracle.test/order
painkillers-online.test/buy/no-prescription cheap-viagra.test/order/41 payday-loans.test/apply fastcash.test/loan/1
quickmoney.test/earn earn-money-home.test/start crypto-doubler.test/invest bitcoin-giveaway.test/claim forex-signals.test/profit
getrichfast.test/secret replica-watches.test/sale fake-rolex.test/shop cheap-designer-bags.test/sale seo-backlinks.test/buy
buy-links.test/packages bulk-followers.test/order free-likes.test/get spam-lists.test/emails spam-mailer.test/download
adserver.test/click/9 banner-ads.test/imp popup-ads.test/serve trackpixel.test/px clicktrack.test/r/3 adclick.test/r/5
affiliate-ads.test/track/8 ads-network.test/banner adult-dating.test/join xxxvideo.test/watch adult-cams.test/live sexcam.test/room
escort-girls.test/city hotsingles.test/meet porn-tube.test/v/12 free-xxx.test/pics free-ringtones.test/download
cracked-software.test/keygen warez-download.test/serial free-movies-torrent.test/get free-iphone.test/winner survey-prize.test/claim
miracle-pills.test/order online-casino-bonus.test/join poker-bets.test/table freebets-now.test/bonus live-bets.test/odds
"""
#: Host and path of wanted sites, as most of the web is. Invented.
WANTED = """
morning-news.test/world/12 www.citylibrary.test/catalogue school-board.test/minutes/2019 university.test/research/physics
blog.rosegarden.test/spring kitchen-notes.test/recipes/soup m.weather.test/today museum.test/visit openpapers.test/2101.html
www.history-society.test/rome music-theory.test/chords travelogue.test/lima sleepresearch.test/en/3 city-council.test/agenda
open-data.test/tables/9 birdwatching.test/herons bike-repair.test/chain www.e-learning.test/course/1 book-club.test/list
filmreviews.test/4040 forum.woodwork.test/thread/99 wiki.botany.test/Main_Page hardware-store.test/item/5 maps.test/berlin
the-herald.test/opinion/77 thelantern.test/en/541 northern-times.test/de/12 weatherthings.test/de/8 theatre.test/tonight
mathworld.test/lemma/3 www.another-thought.test/en/17 thinking.test/essays/2 station-master.test/fr/1 nationalparks.test/es/44
translation.test/dictionary motion-study.test/en/9 emotion-lab.test/papers notionboard.test/en/230 ration-history.test/en/5
theory.test/relativity.html thesis-archive.test/en/88/ methods.test/en/6 northwind.test/de/19 southbank.test/events
heathrow-spotters.test/fr/2 breathing.test/en/7 leather-craft.test/en/61 weathervane.test/es/15 otherwise.test/en/90
pottery.test/glaze gardening.test/en/14 carpentry.test/joints/dovetail chess-club.test/openings/4 astronomy.test/en/moon
river-trust.test/reports/2020 www.parish.test/newsletter/31 farmers-market.test/stalls cheese.test/brie bakery.test/sourdough
swimming.test/lanes running.test/training/10k hiking.test/trails/alps sailing.test/knots climbing.test/grades
hospital.test/wards dentist.test/opening-hours vaccines.test/schedule nutrition.test/vitamins first-aid.test/burns
court-records.test/case/18 parliament.test/debates/5 statistics.test/census archive.test/letters/1890 genealogy.test/names/h
python-notes.test/lists compilers.test/parsing databases.test/indexes networks.test/routing typography.test/serif
painting.test/watercolour photography.test/light sculpture.test/bronze poetry.test/sonnets novels.test/chapter/1
geology.test/basalt chemistry.test/salts biology.test/cells/mitosis physics.test/optics economics.test/trade
trains.test/timetable buses.test/route/42 airport.test/arrivals ferries.test/islands bridges.test/arches
insects.test/beetles fishes.test/trout mammals.test/otter trees.test/oak mushrooms.test/chanterelle
langues.test/fr/verbes sprache.test/de/grammatik idiomas.test/es/verbos lingua.test/it/nomi bibliothek.test/de/ausleihe
ecole.test/fr/cours musee.test/fr/visite universidad.test/es/carreras cocina.test/es/paella rathaus.test/de/termine
"""
PRIME = 0x100000001B3


def labelled_urls() -> list[tuple[int, str, str]]:
    """(1 for unwanted, host, path)."""
    rows = []
    for label, block in ((1, UNWANTED), (0, WANTED)):
        for x in block.split():
            host, slash, path = x.partition("/")
            rows.append((label, host, slash + path))
    return rows


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed n-gram, each pair once, of hosts and of paths apart, for many urls at once."""
    codes = [np.arange(len(hosts), dtype=np.int64) * DIMENSIONS]  # one that all rows have
    for mark, parts in ((1, hosts), (2, paths)):
        data = [b"^" + p.encode("utf-8", "surrogatepass") + b"$" for p in parts]
        row = np.repeat(np.arange(len(data)), [len(x) for x in data])
        x = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        for n in GRAMS:
            m = max(len(x) - n + 1, 0)
            h = np.full(m, mark * 16 + n, np.uint64)
            for k in range(n):
                h = (h ^ x[k : k + m]) * np.uint64(PRIME)
            h ^= h >> np.uint64(29)
            own = row[:m] == row[n - 1 :][:m]
            codes.append(row[:m][own] * DIMENSIONS + (h[own] % np.uint64(DIMENSIONS)).astype(np.int64))
    found = np.unique(np.concatenate(codes))
    return found // DIMENSIONS, found % DIMENSIONS


def fitted(rows: list[tuple[int, str, str]], rounds: int = 300, rate: float = 5.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights by full-batch gradient steps, either label counting half; the last one is the bias."""
    at, gram = grams([h for _, h, _ in rows], [p for _, _, p in rows])
    value = 1 / np.sqrt(np.bincount(at, minlength=len(rows)))
    y, w = np.array([r[0] for r in rows], float), np.zeros(DIMENSIONS + 1)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        off = share * (1 / (1 + np.exp(-np.bincount(at, w[gram], len(rows)) * value - w[-1])) - y)
        step = np.append(np.bincount(gram, (off * value)[at], DIMENSIONS), off.sum())
        w -= rate * (step / len(rows) + ridge * w)
    return w


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    return fitted(labelled_urls())


def scores(hosts: list[str], paths: list[str], w: np.ndarray) -> np.ndarray:
    """How likely each url is unwanted."""
    if not hosts:
        return np.zeros(0)
    at, gram = grams(hosts, paths)
    n = np.bincount(at, minlength=len(hosts))
    return 1 / (1 + np.exp(-np.bincount(at, w[gram], len(hosts)) / np.sqrt(n) - w[-1]))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (or null), ``score`` (the
    model's, of unwanted; null where a rule decides) and ``verdict``."""
    url = F.col("url")
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    out = pages.withColumns({
        "host": F.when(has, host).otherwise(F.lit("")), "path": F.when(has, path).otherwise(F.lit("")),
    })
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    w = trained().astype(np.float32).astype(np.float64)

    @F.pandas_udf("double")
    def scored(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        asked = hosts.notna().to_numpy()
        out = np.full(len(hosts), np.nan)
        out[asked] = scores(hosts[asked].tolist(), paths[asked].tolist(), w)
        return pd.Series(out)

    # rows that a rule decides are not scored
    open_ = out.withColumn("_found", found)
    ask = lambda c: F.when(F.col("_found").isNull(), F.col(c))
    out = open_.withColumn("score", scored(ask("host"), ask("path"))).withColumn("score", F.when(F.col("_found").isNull(), F.col("score")))
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({
        "rule": F.col("_found.rule"), "verdict": F.coalesce("_found.verdict", by_model),
    }).drop("_found")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op10_url_filter": op10_url_filter}
