"""What a question refers to: sources by alias, units by locator, and whether there is a clear winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import normalized, tokens

#: A path weighs more than a title; a winner leads by this much or by this factor.
PATH_WEIGHT, TITLE_WEIGHT, GAP, RATIO = 90.0, 72.0, 8.0, 1.25


def alias_matches(questions: DataFrame, aliases: DataFrame, least: float = 0.5) -> DataFrame:
    """(question_id, source_id, basis, exact, score): aliases that a question contains as a phrase, or of whose words it has at least half.

    A phrase counts whole (if the alias may be exact: not a single character, nor just two bare letters; a word that is repeated is neither), a share of two words or more in proportion, to three
    places. What an alias shares with a question follows from its number of words and those of them that any question has, so aliases alike in both are a class, and
    classes meet questions. A class of n words needs n * least of them, so they meet on its rarest ones alone, as many as one can't do without, and a pair counts where its first common word is.
    ``questions``: question_id, text. ``aliases``: source_id, alias, basis (path or title).
    """
    asked = questions.where("question_id is not null").select("question_id", normalized(F.col("text")).alias("asked"), F.array_distinct(tokens(F.col("text"))).alias("asked_words")).distinct()
    wanted = asked.select("*", F.explode("asked_words").alias("word"))
    vocabulary = wanted.groupBy("word").agg(F.count("*").alias("df"))
    words = F.array_distinct(tokens(F.col("alias")))
    each = aliases.select("source_id", "basis", "alias", words.alias("words")).select("source_id", "basis", "alias", F.size("words").alias("n"), F.explode("words").alias("word"))
    met = each.join(vocabulary, "word").groupBy("source_id", "basis", "alias", "n").agg(F.array_sort(F.collect_set(F.struct("df", "word"))).getField("word").alias("met"))
    known = met.where(F.size("met") / F.col("n") >= least)
    rare = F.slice("met", F.lit(1), F.greatest(F.size("met") - F.ceil(F.col("n") * least) + 1, F.lit(1)).cast("int"))
    classes = known.select("n", "met").distinct().select("n", "met", F.explode(rare).alias("word"))
    common = F.array_intersect("met", "asked_words")
    share = F.size("common") / F.col("n")
    pairs = classes.join(wanted, "word").withColumn("common", common).where((F.element_at("common", 1) == F.col("word")) & (share >= least)).select("n", "met", "question_id", share.alias("share"), F.when(share == 1, F.col("asked")).alias("asked"))
    both = known.join(pairs, ["n", "met"])
    phrase = normalized(F.col("alias"))
    bare = (F.col("n") == 1) & ((F.length(phrase) <= 1) | ((F.length(phrase) == 2) & phrase.rlike("^[a-z]+$") & ~F.col("alias").rlike("[/.]")))
    # only a question with all words can have the phrase
    exact = F.when(F.col("asked").isNotNull(), ~bare & F.concat(F.lit(" "), "asked", F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))).otherwise(False)
    weight = F.when(F.col("basis") == "path", PATH_WEIGHT).otherwise(TITLE_WEIGHT)
    scored = both.select("question_id", "source_id", "basis", exact.alias("exact"), weight.alias("weight"), "n", "share")
    score = F.when(F.col("exact"), F.col("weight")).when(F.col("n") >= 2, F.round(F.col("weight") * F.col("share"), 3))
    # thousandths, and behind them whether it is exact, so that one number is the maximum of both
    rank = scored.select("question_id", "source_id", "basis", (F.round(score * 1000).cast("long") * 2 + F.col("exact").cast("long")).alias("rank")).where("rank is not null")
    best = rank.groupBy("question_id", "source_id", "basis").agg(F.max("rank").alias("rank"))
    return best.select("question_id", "source_id", "basis", (F.col("rank") % 2 == 1).alias("exact"), (F.expr("rank div 2") / 1000).alias("score"))


def winners(candidates: DataFrame) -> DataFrame:
    """(question_id, source_id, score, runner_up, status): the best source; exact if it leads clearly, else ambiguous.

    Alone it leads with any score over 0. Beside another it must be ahead, and be the only one of the two whose alias stands in the question, or lead by a gap or a factor.
    """
    exact = F.coalesce(F.max(F.when(F.col("exact"), F.col("score"))) == F.max("score"), F.lit(False))
    best = candidates.groupBy("question_id", "source_id").agg(F.max("score").alias("score"), exact.alias("exact"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("exact"), "source_id")
    # the filter lets every task keep two rows of a question before rows are sent
    first = best.withColumn("place", F.row_number().over(order)).where("place <= 2")
    ranked = first.withColumns({"runner_up": F.lead("score").over(order), "other_exact": F.lead("exact").over(order)}).where("place = 1")
    ahead = F.col("score") > F.col("runner_up")
    led = (F.col("exact") & ~F.col("other_exact")) | (F.col("score") - F.col("runner_up") >= GAP) | (F.col("score") >= RATIO * F.col("runner_up"))
    clear = F.when(F.col("runner_up").isNull(), F.col("score") > 0).otherwise(ahead & led)
    return ranked.withColumn("status", F.when(clear, "exact").otherwise("ambiguous")).drop("place", "exact", "other_exact")


def locator(text: Column, kind: str) -> Column:
    """The number after a kind of unit (line, page, slide, row) in a question; null without."""
    return F.try_element_at(F.regexp_extract_all(F.lower(text), F.lit(rf"\b{kind}s?[ #-]*0*([0-9]+)"), F.lit(1)), F.lit(1)).cast("long")


def located_units(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, source_id, unit_id): the unit of the asked source whose lines hold the asked line. ``questions``: question_id, source_id, text."""
    asked = questions.withColumn("line", locator(F.col("text"), "line")).where("line is not null").select("question_id", "source_id", "line")
    return asked.join(units, "source_id").where("line between line_start and line_end").select("question_id", "source_id", "unit_id")
