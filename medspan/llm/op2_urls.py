"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

The model is trained from a small labelled URL table (``ORDINARY_URLS`` and ``UNWANTED_URLS``, or one of the caller's, at most
``MAX_TRAINING_ROWS`` rows) by Spark ML's logistic regression, which runs in the JVM on sparse vectors; its ``BINS`` weights enter the
scoring expression as one literal array.  Parsing, rules and scoring are DataFrame expressions inside one
projection: no join, no shuffle, no Python on the executors.  A long block list (``with_rules``) is a table by host that the url's
host endings are looked up in, by one hash join for each number of labels that its hosts have; of a host's few paths the longest that fits counts.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
method, whose score for no n-grams is that of the intercept alone.  Host letters A-Z are lower-cased, nothing else is.  A rule fits its host and
every subdomain when the path starts with the rule's path; the longest rule text wins, on ties the longer host.  Urls of any length take
time in proportion to their length.  Empty tables, repeated rows and further columns pass through (``host``, ``path``, ``rule``,
``score``, ``verdict`` are replaced).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import unused

BINS = 1 << 14
ORDERS = (3, 4, 5)
MAX_TRAINING_ROWS = 10_000
#: Up to so many rules stand in the expression itself; more are looked up by host, broadcast up to the second number.
LITERAL_RULES, BROADCAST_RULES = 64, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the contract: (action, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Fixed values of our small labelled table.  Ordinary: pages of well-known public sites.
ORDINARY_URLS = """
https://en.wikipedia.org/wiki/Photosynthesis https://de.wikipedia.org/wiki/Brandenburger_Tor https://fr.wikipedia.org/wiki/Tour_Eiffel
https://www.bbc.co.uk/news/science-environment-56837908 https://www.nature.com/articles/s41586-020-2649-2 https://arxiv.org/abs/1706.03762
https://www.nasa.gov/missions/apollo/apollo-11-mission-overview/ https://www.who.int/health-topics/malaria https://www.loc.gov/collections/maps/
https://docs.python.org/3/library/collections.html https://spark.apache.org/docs/latest/sql-programming-guide.html https://www.gutenberg.org/ebooks/1342
https://stackoverflow.com/questions/231767/what-does-yield-do https://github.com/numpy/numpy/blob/main/README.md https://www.britannica.com/science/gravity-physics
https://www.theguardian.com/books/2019/sep/13/top-10-novels https://www.lemonde.fr/planete/article/2021/08/09/climat_6090961_3244.html
https://www.zeit.de/kultur/literatur/2020-05/buchtipps https://elpais.com/cultura/2021-03-12/una-biblioteca.html https://www.spiegel.de/wissenschaft/mensch/archaeologie
https://plato.stanford.edu/entries/kant/ https://ocw.mit.edu/courses/6-006-introduction-to-algorithms/ https://www.cam.ac.uk/research/news/new-telescope
https://www.census.gov/topics/population.html https://www.weather.gov/forecastmaps https://europa.eu/european-union/about-eu_en https://www.un.org/en/about-us/history
https://www.metmuseum.org/art/collection/search/436535 https://www.louvre.fr/en/explore/the-palace https://www.rijksmuseum.nl/en/rijksstudio https://www.si.edu/museums
https://www.nytimes.com/2020/04/22/science/oceans-whale.html https://www.reuters.com/world/europe/ https://apnews.com/hub/science https://www.npr.org/sections/health-shots/
https://www.cdc.gov/flu/prevent/index.html https://www.nhs.uk/conditions/asthma/ https://medlineplus.gov/diabetes.html https://www.mayoclinic.org/diseases-conditions/migraine
https://www.seriouseats.com/classic-sourdough-bread https://www.bbcgoodfood.com/recipes/vegetable-soup https://www.allrecipes.com/recipe/10813/ https://www.chefkoch.de/rezepte/kartoffelsuppe.html
https://www.rhs.org.uk/plants/roses https://www.gardenersworld.com/how-to/grow-plants/ https://www.nationalgeographic.com/animals/mammals/ https://www.allaboutbirds.org/guide/robin
https://www.parliament.uk/about/how/ https://www.bundestag.de/parlament/geschichte https://www.senat.fr/role/ https://www.congress.gov/bill/117th-congress
https://www.weforum.org/agenda/2021/03/education/ https://www.khanacademy.org/math/algebra https://www.coursera.org/learn/machine-learning https://openlibrary.org/works/OL45883W
https://www.openstreetmap.org/about https://www.ordnancesurvey.co.uk/education/ https://www.nps.gov/yell/learn/nature/geysers.htm https://www.visitscotland.com/places-to-go/
https://www.berlin.de/museum/ https://www.paris.fr/pages/les-bibliotheques https://www.madrid.es/portal/bibliotecas https://www.cityofchicago.org/city/en/depts/library.html
https://www.royalsociety.org/journals/ https://www.pnas.org/doi/10.1073/pnas.1517384113 https://pubmed.ncbi.nlm.nih.gov/30049270/ https://www.jstor.org/stable/2118477
https://www.archives.gov/founding-docs/declaration https://www.bl.uk/collection-guides/newspapers https://www.deutsche-digitale-bibliothek.de/ https://gallica.bnf.fr/accueil/
https://www.imdb.com/title/tt0111161/ https://www.rottentomatoes.com/m/casablanca https://www.berliner-philharmoniker.de/konzerte/ https://www.operadeparis.fr/saison
https://forum.arduino.cc/t/reading-a-sensor/ https://community.rstudio.com/t/plotting https://www.postgresql.org/docs/current/index.html https://developer.mozilla.org/docs/Web/HTML
https://www.economist.com/leaders/2021/06/12/ https://hbr.org/2018/01/the-leaders-guide https://www.bmj.com/content/372/bmj.n71 https://www.jneurosci.org/content/40/1
""".split()
#: Unwanted: invented addresses in the manner of gambling, pill, adult, loan, download, link-farm and phishing sites.
UNWANTED_URLS = """
http://best-online-casino-bonus.example/no-deposit/free-spins http://www.slots4real-money.example/jackpot?aff=9921 https://poker-bets-win.example/signup/bonus
http://cheap-viagra-no-prescription.example/buy-now http://canadian-pills-discount.example/order/cialis.html http://meds247-online.example/shop/?promo=free
http://hot-singles-dating.example/join/free http://xxx-cams-live.example/watch http://adult-videos-hd.example/porn/latest https://sexy-girls-chat.example/free
http://payday-loans-fast-cash.example/apply http://instant-loan-approval.example/bad-credit/ http://forex-profit-robot.example/earn-money-now
http://free-crack-keygen.example/download/serial http://torrent-warez-download.example/full-version-crack.html http://nulled-themes-free.example/download.php?id=221
http://buy-backlinks-seo-cheap.example/packages http://link-farm-directory.example/submit/links.html http://seo-traffic-clicks.example/buy/10000-visitors
http://replica-watches-sale.example/rolex/cheap http://louis-vuitton-outlet-discount.example/bags http://cheap-jerseys-wholesale.example/nfl/
http://secure-paypal-verify-account.example/login/confirm http://bank-account-update-verify.example/signin.php http://appleid-locked-verify.example/unlock/
http://win-free-iphone-prize.example/claim?ref=spam http://lottery-winner-claim.example/prize http://survey-gift-card-free.example/claim-now
http://crypto-double-bitcoin.example/invest/profit http://bitcoin-giveaway-free.example/send http://ico-crypto-moon-profit.example/join
http://weight-loss-miracle-pills.example/diet/buy http://keto-diet-gummies-sale.example/order http://muscle-steroids-shop.example/buy-steroids
http://click-ads-track.example/redirect?url=offer http://popup-adserver.example/click.php?zone=17 http://affiliate-track-clicks.example/go/offer
http://bet365-bonus-code.example/sports-betting http://online-betting-odds-win.example/football-bets http://bingo-free-spins.example/play
http://casino-en-ligne-bonus.example/jeux-gratuits http://online-kredit-sofort.example/ohne-schufa http://apuestas-casino-gratis.example/bono
http://viagra-kaufen-rezeptfrei.example/billig http://rencontre-sexe-gratuit.example/inscription http://citas-sexo-gratis.example/chat
http://essay-writing-cheap.example/buy-essay http://buy-followers-likes.example/instagram/cheap http://free-robux-generator.example/hack
http://download-free-movies-hd.example/watch-online-free http://mp3-free-download.example/hits.php http://apk-mod-hack-unlimited.example/coins
http://tramadol-overnight-cheap.example/buy http://xanax-no-rx.example/order-online http://cbd-oil-discount-sale.example/buy/
http://escort-girls-vip.example/book http://webcam-sex-show.example/live http://milf-dating-sites.example/free-join
http://work-from-home-cash.example/earn-500-day http://make-money-fast-online.example/secret-system http://mlm-profit-system.example/join-now
http://virus-alert-support.example/call-now http://pc-cleaner-free-download.example/fix http://flash-player-update.example/install.exe
http://casino.slots-bonus.example/vip http://free.casino-play.example/win http://www.jackpot-slots.example/spin http://poker.free-chips.example/bonus
http://cheap-flights-click.example/?aff=88 http://discount-handbags-outlet.example/sale http://nike-outlet-cheap.example/shoes.html
http://spam-blog-farm.example/2019/buy-cheap-links http://article-spinner-seo.example/autogenerated http://traffic-bot-clicks.example/free-trial
http://gambling-roulette-online.example/play-now http://sportsbook-bets-bonus.example/welcome http://slot-gacor-maxwin.example/daftar
http://hookup-tonight.example/adult/signup http://nude-pics-leak.example/gallery http://porn-tube-free.example/videos
http://credit-repair-cheap-loan.example/apply-now http://debt-relief-fast.example/free-quote http://title-loans-cash.example/today
""".split()


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.  Longest first, so the first fit wins."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2], r[0]))
    table = F.array(*[F.struct(F.lit(h + p).alias("rule"), F.lit(a).alias("verdict"), F.lit(h).alias("h"), F.lit("." + h).alias("dot"), F.lit(p).alias("p")) for a, h, p in ordered])
    fits = F.filter(table, lambda r: ((host == r["h"]) | host.endswith(r["dot"])) & path.startswith(r["p"]))
    hit = F.get(fits, F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["rule"].alias("rule"), hit["verdict"].alias("verdict")))


def with_rules(rows: DataFrame, host: str, path: str, rules: list[tuple[str, str, str]], out: str) -> DataFrame:
    """``rows`` with ``out``, the struct of ``rule_for``, for any number of rules.  Row for row: no join multiplies or drops any."""
    if len(rules) <= LITERAL_RULES:
        return rows.withColumn(out, rule_for(F.col(host), F.col(path), rules))
    paths: dict[str, list[tuple[str, str, str]]] = {}
    for action, own, start in sorted(rules, key=lambda r: (-len(r[2]), r[2], r[0])):
        paths.setdefault(own, []).append((start, own + start, action))
    table = rows.sparkSession.createDataFrame(list(paths.items()), "own string, held array<struct<start:string,rule:string,verdict:string>>")
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    labels, kept = F.split(F.col(host), r"\."), list(rows.columns)
    hits = []
    for n in sorted({own.count(".") + 1 for own in paths}):
        ending, held = unused(rows, f"ending{n}"), unused(rows, f"held{n}")
        rows = rows.withColumn(ending, F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.lit(-n), F.lit(n)), ".")))
        rows = rows.join(table.withColumnsRenamed({"own": ending, "held": held}), ending, "left")
        hit = F.get(F.filter(held, lambda r: F.col(path).startswith(r["start"])), F.lit(0))
        hits.append(F.when(hit.isNotNull(), F.struct(F.length(hit["rule"]).alias("size"), F.lit(n).alias("labels"), hit["rule"].alias("rule"), hit["verdict"].alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*hits)))
    return rows.select(*kept, F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))).alias(out))


def with_bins(rows: DataFrame, host: Column, path: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the distinct bins of the character n-grams of ``^host$`` (without its last label) and ``path$``; digits count as 0.

    The texts become arrays of characters in a column of their own first; an n-gram is then a few array look-ups, so a
    url of any length takes linear time.
    """
    digits = ("123456789", "000000000")
    names = {part: unused(rows, f"{part}_chars") for part in ("host", "path")}
    named = F.regexp_replace(host, r"\.[^.]*$", "")  # the label table cannot teach top-level domains
    framed = rows.withColumns({names["host"]: F.split(F.translate(F.concat(F.lit("^"), named, F.lit("$")), *digits), ""), names["path"]: F.split(F.translate(F.concat(path, F.lit("$")), *digits), "")})

    def grams(part: str, n: int) -> Column:
        chars = F.col(names[part])
        last = F.size(chars) - F.lit(n)
        positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(positions, lambda i: F.pmod(F.xxhash64(F.lit(part), F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(BINS)).cast("int"))

    return framed.withColumn(out, F.array_distinct(F.concat(*[grams(part, n) for part in names for n in ORDERS]))).drop(*names.values())


def train(labelled: DataFrame, url: str = "url", label: str = "label", strength: float = 0.0001) -> tuple[list[float], float]:
    """Weights and intercept, fitted in the JVM.  The table is bounded: more than ``MAX_TRAINING_ROWS`` rows are refused.

    An n-gram present counts one over the root of their number, so long urls weigh no more than short ones.
    """
    bins = unused(labelled, "bins")
    known = with_bins(labelled.where(F.col(label).isNotNull()), host_of(F.col(url)), path_of(F.col(url)), bins)
    rows = known.select(F.col(label).cast("double").alias("label"), F.col(bins).alias("bins")).limit(MAX_TRAINING_ROWS + 1).collect()
    if len(rows) > MAX_TRAINING_ROWS:
        raise ValueError(f"the labelled URL table may have at most {MAX_TRAINING_ROWS} rows")
    made = [(r["label"], Vectors.sparse(BINS, {b: max(1, len(r["bins"])) ** -0.5 for b in r["bins"]})) for r in rows]
    table = labelled.sparkSession.createDataFrame(made, ["label", "features"]).coalesce(1)
    model = LogisticRegression(regParam=strength, maxIter=60, standardization=False).fit(table)
    return [round(float(w), 9) for w in model.coefficients.toArray()], round(float(model.intercept), 9)


def seed_rows() -> list[tuple[str, int]]:
    return [(u, 0) for u in ORDINARY_URLS] + [(u, 1) for u in UNWANTED_URLS]


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_rows(), "url string, label int")


def weight_table(weights: list[float]) -> Column:
    """The weights as one literal array."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def score_of(bins: Column, table: Column, intercept: float) -> Column:
    """Probability that the url with these n-gram bins is unwanted."""
    total = F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total / F.sqrt(F.greatest(F.size(bins), F.lit(1)).cast("double")) + F.lit(intercept))))


def judge(pages: DataFrame, weights: list[float], intercept: float, rules: list[tuple[str, str, str]] | None = None, url: str = "url", threshold: float = 0.8) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block)."""
    address = unused(pages, "address")  # the url itself may be among the columns that are replaced
    parsed = pages.withColumn(address, F.col(url)).withColumns({"host": host_of(F.col(address)), "path": path_of(F.col(address))})
    bins, table, hit = unused(parsed, "bins"), unused(parsed, "weights"), unused(parsed, "hit")
    parsed = with_bins(parsed, F.col("host"), F.col("path"), bins).withColumn(table, weight_table(weights))
    parsed = with_rules(parsed, "host", "path", RULES if rules is None else rules, hit)
    scored = parsed.withColumns({"score": F.round(score_of(F.col(bins), F.col(table), intercept), 6)})
    verdict = F.coalesce(F.col(f"{hit}.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.withColumns({"rule": F.col(f"{hit}.rule"), "verdict": verdict}).drop(hit, bins, table, address)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = train(seed_table(spark))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, weights, intercept).select("page_id", "host", "path", "rule", "verdict", "score")
