"""Valence of texts from a word list, with the words before each hit: negations, boosters and a contrast.

A text's words are laid out once with their neighbours (of the built-in list only its hits) and joined with the list (broadcast, as its
size is the user's own list); partial sums leave one row per text before the shuffle. A hit's valence is raised or lowered by boosters up to three words before it, less so with the distance; turned
and damped by a negation there; halved before the text's last ``but`` and raised by a half behind it. The sum s of a text becomes
s / sqrt(s * s + ``SPREAD``), between -1 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Valences by word, words that negate, that raise (+) and that lower (-), and the constants of the formula.
LEXICON = {
    "admire": 2.2, "amazing": 2.8, "annoying": -1.7, "awesome": 3.1, "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "better": 1.9, "boring": -1.3,
    "brilliant": 2.8, "broken": -2.1, "cancel": -1.0, "cool": 1.3, "crap": -1.6, "crowded": -0.9, "disappointed": -1.9, "disappointing": -2.2, "disgusting": -2.4, "dull": -1.7,
    "enjoy": 2.2, "excellent": 2.7, "excited": 1.4, "expensive": -0.8, "fail": -2.5, "fantastic": 2.6, "favorite": 2.0, "fun": 2.3, "glad": 2.0, "good": 1.9,
    "gorgeous": 3.0, "great": 3.1, "happy": 2.7, "hate": -2.7, "horrible": -2.5, "idiot": -2.3, "incredible": 2.2, "insane": -1.7, "interesting": 1.7, "joy": 2.8,
    "kind": 2.4, "lame": -1.7, "like": 1.5, "loser": -2.4, "love": 3.2, "lovely": 2.8, "mess": -1.5, "moron": -2.2, "nice": 1.8, "outstanding": 3.0,
    "pathetic": -2.7, "perfect": 2.7, "poor": -2.1, "problem": -1.7, "proud": 2.1, "refund": -0.6, "rip": -1.1, "sad": -2.1, "scam": -2.7, "scum": -2.9,
    "slow": -0.8, "stunning": 1.6, "stupid": -2.4, "super": 2.9, "terrible": -2.1, "thanks": 1.9, "trash": -2.1, "ugly": -2.3, "unique": 1.2, "upset": -1.6,
    "useless": -1.8, "warm": 0.9, "waste": -1.8, "weak": -1.9, "wonderful": 2.7, "worst": -3.1, "worth": 0.9, "worthless": -1.9, "wow": 2.8, "wrong": -2.1,
}
NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "nowhere", "neither", "nor", "cannot", "cant", "dont", "doesnt", "didnt", "isnt", "wasnt", "wont", "without", "hardly", "rarely")
RAISING = ("very", "really", "extremely", "absolutely", "so", "totally", "incredibly", "most", "completely", "deeply", "especially")
LOWERING = ("slightly", "somewhat", "barely", "kinda", "sorta", "partly", "less", "little", "marginally", "occasionally")
BOOST, DAMPED, NEGATED, SPREAD, CLEAR = 0.293, (1.0, 0.95, 0.9), -0.74, 15.0, 0.05
#: Mentions and share of scored ones of a cohort from which its evidence counts as high.
HIGH_COVERAGE, HIGH_PLATFORMS = 0.5, 2


def words(text: Column) -> Column:
    """Lower-case words, apostrophes dropped."""
    plain = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("'"), F.lit("")), "[^a-z]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def valence_scores(texts: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """id, hits, valence (-1 to 1, NULL without a listed word) and label of texts (id, text), one row per row."""
    spark = texts.sparkSession
    listed = spark.createDataFrame(sorted(LEXICON.items()), "word string, weight double") if lexicon is None else lexicon
    listing = F.lit(True) if lexicon is not None else None  # a list of the user's own is left to the join

    def near(w):
        """The last "but" (from 0; -1 without one), and listed words with their three predecessors, so that no row carries the whole text."""
        at = F.transform(w, lambda x, k: F.when(x.isin(*LEXICON) if listing is None else listing, k))
        hits = F.transform(F.array_compact(at), lambda k: F.struct(k.alias("at"), F.get(w, k).alias("word"), *(F.get(w, k - j).alias(f"b{j}") for j in (1, 2, 3))))
        but = F.coalesce(F.array_max(F.transform(w, lambda x, k: F.when(x == "but", k))), F.lit(-1))
        return F.struct(but.alias("but"), hits.alias("hits"))

    # bound as the variable of an outer function: a text is cut into words once, not once per word
    laid = F.transform(F.array(words(F.col("text"))), near)
    rows = texts.select("id", F.monotonically_increasing_id().alias("_row"), F.explode(laid).alias("x"))
    each = rows.select("id", "_row", F.col("x.but").alias("but"), F.explode_outer("x.hits").alias("h")).select("id", "_row", "but", "h.*")
    hits = each.join(F.broadcast(listed), "word", "left")
    push = sum((F.when(F.col(f"b{k}").isin(*RAISING), BOOST).when(F.col(f"b{k}").isin(*LOWERING), -BOOST).otherwise(0.0) * damped for k, damped in zip((1, 2, 3), DAMPED)), F.lit(0.0))
    value = F.col("weight") + F.signum("weight") * push
    negated = F.coalesce(*(F.when(F.col(f"b{k}").isin(*NEGATIONS), True) for k in (1, 2, 3)), F.lit(False))
    value = F.when(negated, value * NEGATED).otherwise(value)
    value = F.when(F.col("but") < 0, value).when(F.col("at") < F.col("but"), value * 0.5).otherwise(value * 1.5)
    # a text's words lie together, so partial sums leave one row per text for the shuffle
    scored = hits.groupBy("_row", "id").agg(F.count("weight").alias("hits"), F.sum(value).alias("s"))
    valence = F.col("s") / F.sqrt(F.col("s") * F.col("s") + SPREAD)
    label = F.when(valence >= CLEAR, "positive").when(valence <= -CLEAR, "negative").when(valence.isNotNull(), "neutral")
    return scored.select("id", "hits", valence.alias("valence"), label.alias("label"))


def cohort_features(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of labels, mean, dispersion and evidence tier of scored mentions (keys, platform, valence, label)."""
    share = lambda name: F.round(F.count_if(F.col("label") == name) / F.nullif(F.count("label"), F.lit(0)), 6).alias(f"{name}_share")
    coverage, platforms = F.count("label") / F.count("*"), F.count_distinct("platform")
    tier = F.when((platforms >= HIGH_PLATFORMS) & (coverage >= HIGH_COVERAGE), "high").when(coverage > 0, "medium").otherwise("low")
    spread = F.when(F.count("valence") > 1, F.stddev_pop("valence"))
    return scored.groupBy(*keys).agg(F.count("*").alias("mentions"), F.count("label").alias("scored"), share("positive"), share("negative"), share("neutral"), F.round(F.avg("valence"), 6).alias("mean"), F.round(spread, 6).alias("dispersion"), tier.alias("tier"))
