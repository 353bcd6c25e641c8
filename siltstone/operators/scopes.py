"""Which source and unit a question means, which sources it is bound to, and whether answers keep to them. Many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions.lineage import cut
from siltstone.functions.text import tokens
from siltstone.operators.references import GAP, RATIO, alias_matches, locator

#: What a unit adds whose lines hold the asked one, words for documents and for parts of them, and least reference bonus that counts as support.
LINE_SCORE, REFERENCE_LEAST = 58.0, 6.0
DOCUMENT_HINT = r"(?i)\b(deck|document|proposal|ppt|pptx|pdf|xlsx|docx|sheet|slide|page|file|doc|xls|markdown|md|txt|text|csv|tsv|yaml|yml|mdx|tex|table|email|mail|message|eml|attachment)\b"
ARTIFACT_HINT = r"(?i)\b(diagram|figure|chart|table|kpi|metric|dashboard|architecture|flow|screenshot|ui|image|picture|photo|caption|legend)\b"
QUOTED = '"([^"]+)"'
SOFT, HARD, COMPARE, GLOBAL = "source-scoped-soft", "source-scoped-hard", "compare", "global"


def quoted(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUOTED), F.lit(1)))


def with_hints(questions: DataFrame) -> DataFrame:
    """(question_id, text) with what the text says of itself: ``compare``, ``declared`` (two quoted names of a comparison), ``requested`` (one quoted name), ``single``, ``line``.

    A null text has no hints.
    """
    text = F.coalesce("text", F.lit(""))
    names = quoted(text)
    compare = text.rlike(P.COMPARE_SCOPE)
    declared = F.when(compare & (F.size(names) >= 2), F.slice(names, 1, 2)).otherwise(F.array().cast("array<string>"))
    return questions.select("question_id", text.alias("text"), compare.alias("compare"), declared.alias("declared"), F.when(F.size(declared) == 0, F.try_element_at(names, F.lit(1))).alias("requested"), text.rlike(P.SINGLE_SOURCE).alias("single"), locator(text, "line").alias("line"))


def _clear(score: str, runner: str) -> Column:
    ahead = (F.col(score) > F.col(runner)) & ((F.col(score) - F.col(runner) >= GAP) | (F.col(score) >= RATIO * F.col(runner)))
    return F.when(F.col(runner).isNull(), F.col(score) > 0).otherwise(ahead)


def _leaders(rows: DataFrame) -> DataFrame:
    """Per question: the best row of the exact ones (``e``), of those with an alias (``a``) and of all (``f``), whether it leads clearly, and counts.

    Beside one that isn't, an exact row that is ahead leads by that alone. Only the first two rows of a question are ever ranked together: the filter on the place lets every task keep two before rows are sent.
    """
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("exact"), F.desc("source_score"), "source_id")
    known = F.col("source_score") > 0
    seen = rows.groupBy("question_id").agg(F.count_if("exact").alias("n_exact"), F.count_if(known).alias("n_known"), F.max("n_units").alias("any_unit"))
    for w, of in {"e": F.col("exact"), "a": known, "f": F.lit(True)}.items():
        two = rows.where(of).withColumn("place", F.row_number().over(order)).where("place <= 2").withColumns({"next": F.lead("score").over(order), "other": F.lead("exact").over(order)})
        alone = F.coalesce((F.col("score") > F.col("next")) & F.col("exact") & ~F.col("other"), F.lit(False))
        top = two.where("place = 1").select("question_id", F.struct("source_id", "basis", "unit_id", "n_units", (_clear("score", "next") | alone).alias("clear")).alias(w))
        seen = seen.join(top, "question_id", "left")
    return seen


LINE_BLOCK = 64  # lines in which questions and units meet


def _by_source(aliased: DataFrame) -> DataFrame:
    best = aliased.groupBy("question_id", "source_id").agg(F.max(F.struct("score", F.col("basis") == "path", "exact", "basis")).alias("m"))
    return best.select("question_id", "source_id", "m.basis", F.col("m.score").alias("source_score"), "m.exact")


def candidates(asked: DataFrame, aliased: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, source_id, basis, source_score, exact, unit_id, n_units, score): sources by their best alias, with the unit whose lines hold the asked one.

    Sources that only have such a unit can win only where no alias matches, by the smallest id; so of those just that one is kept, found once a line number.
    ``asked``: ``with_hints``. ``aliased``: ``references.alias_matches``. ``units``: source_id, unit_id, line_start, line_end.
    """
    # lines and spans meet in blocks of lines
    wanted = asked.where("line is not null").select("line", F.expr(f"line div {LINE_BLOCK}").alias("block")).distinct()
    spans = units.where("line_start <= line_end").withColumn("block", F.explode(F.expr(f"sequence(line_start div {LINE_BLOCK}, line_end div {LINE_BLOCK})")))
    held = cut(wanted.join(spans, "block").where(F.col("line").between(F.col("line_start"), F.col("line_end"))).groupBy("line", "source_id").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("n_units")))
    # a source's unit is found once a line, however many questions ask for it
    lines = _by_source(aliased).join(asked.select("question_id", "line"), "question_id")
    named = lines.join(held, ["source_id", "line"], "left").select("question_id", "source_id", "basis", "source_score", "exact", "unit_id", F.coalesce("n_units", F.lit(0)).alias("n_units"))
    first = held.groupBy("line").agg(F.min_by(F.struct("source_id", "unit_id", "n_units"), "source_id").alias("f"))
    alone = asked.join(first, "line").select("question_id", F.col("f.source_id").alias("source_id"), F.lit(None).cast("string").alias("basis"), F.lit(0.0).alias("source_score"), F.lit(False).alias("exact"), F.col("f.unit_id").alias("unit_id"), F.col("f.n_units").alias("n_units"))
    return cut(named.unionByName(alone).withColumn("score", F.col("source_score") + F.when(F.col("n_units") > 0, LINE_SCORE).otherwise(0.0)))


def declared_sources(aliased: DataFrame) -> DataFrame:
    """(question_id, source_id, status): for each name on its own the source that it means: exact, approximate, or absent if none leads clearly."""
    both = _leaders(_by_source(aliased).withColumns({"score": F.col("source_score"), "unit_id": F.lit(None).cast("string"), "n_units": F.lit(0)}))
    sure = F.coalesce(F.col("e.clear"), F.lit(False))
    return both.where(sure | F.col("a.clear")).select("question_id", F.when(sure, F.col("e.source_id")).otherwise(F.col("a.source_id")).alias("source_id"), F.when(sure, "exact").otherwise("approximate").alias("status"))


def resolutions(asked: DataFrame, found: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row a question: (question_id, detected, status, source_match, unit_match, source_id, unit_id, narrowing, reason, hard_boundary, scope), before comparisons.

    A clear exact source is taken, else a clear approximate one unless two stand exactly under a requested name, else the best source if any has the asked unit.
    A question for a single, named source that isn't exact is stopped at its boundary. ``found``: ``candidates``. ``aliases``: source_id, basis, alias.
    """
    rows = asked.join(_leaders(found), "question_id", "left").fillna(0, ["n_exact", "n_known", "any_unit"])
    located, asks = F.col("line").isNotNull(), F.col("requested").isNotNull()
    open_ = (F.col("n_known") > 0) & ~(asks & (F.col("n_exact") >= 2))
    sure = F.coalesce(F.col("e.clear"), F.lit(False))
    pick = F.when(sure, F.col("e")).when(open_, F.when(F.col("a.clear"), F.col("a"))).when(F.col("any_unit") > 0, F.col("f"))
    detected = asks | F.col("text").rlike(DOCUMENT_HINT) | (F.col("n_exact") > 0) | located | (F.size("declared") > 0)
    rows = rows.withColumns({"detected": detected, "pick": F.when(detected, pick), "sure": sure})
    said = aliases.select(F.col("source_id").alias("said_id"), F.col("basis").alias("said_basis"), tokens(F.col("alias")).alias("words"))
    words = F.array_distinct(tokens(F.col("text")))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(words, "words")).cast("double"), F.size(words).cast("double")), F.lit(0.0))
    rows = rows.join(said, (F.col("pick.source_id") == F.col("said_id")) & (F.col("pick.basis") == F.col("said_basis")), "left").withColumn("share", share)
    flags = [c for c in rows.columns if c not in ("words", "said_id", "said_basis", "share", "question_id")]
    rows = rows.groupBy("question_id").agg(*(F.first(c).alias(c) for c in flags), F.max("share").alias("share"))  # aliases of one basis: the one that covers most
    text, has = F.col("text"), F.col("pick").isNotNull()
    narrowing = has & F.col("sure") & ~F.col("compare") & (text.rlike(DOCUMENT_HINT) | located | (F.col("share") >= 0.5) | ~text.rlike(ARTIFACT_HINT))
    match = F.when(has, F.when(F.col("sure"), "exact").otherwise("approximate")).when(F.col("detected"), "unresolved").otherwise("none")
    n = F.when(has & (located | ~asks), F.col("pick.n_units")).otherwise(0)
    unit = F.when(n == 1, "exact").when((n > 1) | (F.col("detected") & located), "unresolved").otherwise("none")
    status = F.when((match == "exact") & ((n > 1) | ((n == 0) & located)), "approximate").otherwise(match)
    stopped = F.col("single") & asks & (match != "exact")
    reason = F.when(stopped, F.when(F.col("n_exact") >= 2, "ambiguous-source").otherwise("missing-source")).when(status == "approximate", "soft-approximation").when(status == "unresolved", "ambiguous-source")
    kept = lambda c: F.when(~stopped, c)
    scope = F.when(F.col("compare"), COMPARE).when(F.col("single"), HARD).when(kept(F.lit(1)).isNotNull() & has & narrowing, SOFT).otherwise(GLOBAL)
    return rows.select(
        "question_id", "detected", F.when(stopped, "unresolved").otherwise(status).alias("status"), F.when(stopped, "unresolved").otherwise(match).alias("source_match"),
        F.when(stopped, F.when(located, "unresolved").otherwise("none")).otherwise(unit).alias("unit_match"), kept(F.col("pick.source_id")).alias("source_id"), kept(F.when(n == 1, F.col("pick.unit_id"))).alias("unit_id"),
        narrowing.alias("narrowing"), reason.alias("reason"), stopped.alias("hard_boundary"), scope.alias("scope"),
    )


def comparisons(wanted: DataFrame) -> DataFrame:
    """(question_id, expected, missing, status, hard_boundary, compared) of (question_id, name, source_id, match): a comparison of named sources is exact if all are, or else stops."""
    rolled = wanted.groupBy("question_id").agg(F.count("*").alias("expected"), F.countDistinct("source_id").alias("met"), F.count_if(F.coalesce(F.col("match") == "exact", F.lit(False))).alias("sure"), F.array_sort(F.collect_set("source_id")).alias("compared"))  # two names a question
    status = F.when((F.col("met") >= F.col("expected")) & (F.col("sure") == F.col("expected")), "exact").otherwise("unresolved")
    return rolled.select("question_id", "expected", (F.col("expected") - F.col("met")).alias("missing"), status.alias("status"), (status != "exact").alias("hard_boundary"), "compared")


def resolved(questions: DataFrame, aliases: DataFrame, units: DataFrame) -> DataFrame:
    """``resolutions`` with what comparisons of named sources change, how many sources they expect and miss, and the sources that a search is held to.

    Names of a comparison meet the aliases in the same pass as the questions, each as a question of its own. Questions, aliases and
    matches are used many times and checkpointed where the session has a folder for that.
    """
    asked, aliases = cut(with_hints(questions)), cut(aliases)
    whole = asked.select("question_id", F.lit(0).alias("part"), F.coalesce("requested", "text").alias("text"))
    names = asked.select("question_id", F.posexplode("declared").alias("part", "text")).select("question_id", (F.col("part") + 1).alias("part"), "text")
    parts = whole.union(names).select(F.struct("question_id", "part").alias("question_id"), "text")
    met = cut(alias_matches(parts, aliases))
    own = met.where("question_id.part = 0").withColumn("question_id", F.col("question_id.question_id"))
    rows = resolutions(asked, candidates(asked, own, units), aliases)
    meant = declared_sources(met.where("question_id.part > 0")).withColumnRenamed("status", "match")
    wanted = names.select(F.struct("question_id", "part").alias("question_id")).join(meant, "question_id", "left").select("question_id.question_id", "source_id", "match")
    compared = comparisons(wanted).select("question_id", "expected", "missing", F.col("status").alias("c_status"), F.col("hard_boundary").alias("c_hard"), "compared")
    rows = rows.join(compared, "question_id", "left")
    is_compared = F.col("c_status").isNotNull()
    reason = F.when(F.col("c_status") == "unresolved", "compare-source-unresolved").when(~is_compared, F.col("reason"))
    rows = rows.withColumns({
        "status": F.coalesce("c_status", "status"), "reason": reason, "hard_boundary": F.coalesce("c_hard", "hard_boundary"), "expected": F.coalesce("expected", F.lit(0)), "missing": F.coalesce("missing", F.lit(0)),
        "source_match": F.when((F.col("c_status") == "exact") & (F.col("source_match") == "unresolved"), "none").otherwise(F.col("source_match")), "compared": F.coalesce("compared", F.array().cast("array<string>")),
    })
    held = effective_filter(F.col("scope"), F.col("compared"), F.col("source_id"), F.col("source_match"), F.col("unit_match"), F.col("narrowing"))
    return rows.withColumn("held_to", held).drop("c_status", "c_hard", "compared")


def effective_filter(scope: Column, compared: Column, source: Column, match: Column, unit_match: Column, narrowing: Column) -> Column:
    """The sources that a search is held to; empty for all."""
    nothing = F.array().cast("array<string>")
    narrows = ((match == "exact") & narrowing) | ((match == "approximate") & (unit_match == "exact"))
    return F.when((scope == COMPARE) & (F.size(compared) > 0), compared).when(source.isNotNull() & (scope.isin(SOFT, HARD) | narrows), F.array(source)).otherwise(nothing)


def direct_support(lexical: Column, reference: Column) -> Column:
    """What a result supports by itself: its words, or without any a reference that is strong enough."""
    return F.when(lexical > 0, lexical).when(reference >= REFERENCE_LEAST, reference).otherwise(0.0)


def admitted(family: Column, direct: Column, scope: Column, source: Column, target: Column, compared: Column) -> Column:
    """Whether a result may be canonical support: of the corpus, supporting by itself, and within the scope."""
    inside = F.when(scope.isin(SOFT, HARD) & target.isNotNull(), source == target).when((scope == COMPARE) & (F.size(compared) > 0), F.array_contains(compared, source)).otherwise(True)
    return F.coalesce(family == "corpus", F.lit(True)) & (direct > 0) & inside


def segment_satisfied(scope: Column, status: Column, target: Column, compared: Column, supporting: Column) -> Column:
    """Whether a segment rests on what the scope asks for; one that abstains always does."""
    both = F.when(F.size(compared) > 0, F.arrays_overlap(supporting, compared)).otherwise(F.size(F.array_distinct(supporting)) >= 2)
    bound = F.when(scope == COMPARE, both).when(scope.isin(SOFT, HARD), F.coalesce(F.array_contains(supporting, target), F.lit(False))).otherwise(True)
    return (status == "abstained") | bound


def final_state(known: Column, abstains: Column, basis: Column, manifest: Column, declared: Column) -> Column:
    """The state of an answer: what it declares, abstention, what a manifest shows, else what the corpus shows."""
    shown = F.when(manifest & (basis == "external-source-verified"), "grounded").when(manifest & (basis == "mixed") & (known == "unresolved"), "partially-grounded")
    return F.coalesce(declared, F.when(abstains, F.lit("abstained")), shown, known)


def trace_status(state: Column, basis: Column, manifest: Column) -> Column:
    some = state.isin("grounded", "partially-grounded")
    good = F.when(basis == "mixed", some | manifest).when(basis.isin("external-source-verified", "model-knowledge"), some).otherwise(state == "grounded")
    return F.when((state == "abstained") | good, "ready").otherwise("degraded")


def needs_render(wanted: Column, state: Column, basis: Column, manifest: Column) -> Column:
    freed = (state == "abstained") | F.coalesce(basis.isin("external-source-verified", "model-knowledge") | ((basis == "mixed") & (state == "unresolved") & manifest), F.lit(False))
    return wanted & ~freed


def issue_codes(state: Column, scope: Column, satisfied: Column, compare_status: Column, unresolved: Column, basis: Column, sufficient: Column, escalate: Column, explained: Column) -> Column:
    """What is wrong with a trace, in a fixed order, joined by commas."""
    codes = {
        "published-artifacts-gap": ~sufficient, "source-escalation-required": escalate, "source-scope-missing-target-support": scope.isin(SOFT, HARD) & ~satisfied,
        "compare-source-coverage-missing": (scope == COMPARE) & ~satisfied, "compare-source-approximate": (scope == COMPARE) & (compare_status == "approximate"), "compare-source-unresolved": (scope == COMPARE) & (compare_status == "unresolved"),
        "trace-answer-state-mismatch": (state == "grounded") & F.coalesce(basis.isin("kb-grounded", "mixed"), F.lit(True)) & (unresolved > 0), "mixed-support-unexplained": (basis == "mixed") & ~explained,
    }
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items()))), ",")


def binding(run: Column, turn_exists: Column, run_exists: Column, run_fits: Column, front: Column, canonical: Column, committed: Column, active: Column) -> Column:
    """Whether a log record may belong to its turn: canonical, or the first reason for which it is kept for audits only."""
    rules = {
        "no-run": run.isNull() | (run == ""), "no-turn": ~turn_exists, "no-run-record": ~run_exists, "foreign-run": ~run_fits, "run-origin": ~front, "turn-state": ~canonical,
        "after-commit": committed == run, "inactive-run": (active != "") & (active != run),
    }
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in rules.items()), F.lit("canonical"))


def commit_errors(state: Column, basis: Column, manifest: Column, captured: Column) -> Column:
    """The contract of a turn that is committed: a known state, a known basis, a manifest where the basis needs one, and the time of its version."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    codes = {
        "answer-state": ~F.coalesce(state.isin("grounded", "partially-grounded", "unresolved", "abstained"), F.lit(False)), "support-basis": ~F.coalesce(basis.isin("kb-grounded", "external-source-verified", "model-knowledge", "mixed", "governed-boundary"), F.lit(False)),
        "support-manifest": F.coalesce(basis.isin("external-source-verified", "mixed"), F.lit(False)) & blank(manifest), "captured-at": blank(captured),
    }
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items()))), ",")
