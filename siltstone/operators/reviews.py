"""Rules over logs, cases, changes, queues and layouts: each a column expression or one grouped pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of reasons and kinds of overlay candidates, and what unknown ones weigh.
REASONS = {
    "image-only-page": 100, "scanned-page-like": 95, "connector-heavy-slide": 92, "grouped-diagram-slide": 90, "rendered-only-diagram-section": 88, "chart-slide": 84, "chart-sheet": 84, "picture-heavy-sheet": 82,
    "figure-heavy-section": 82, "dashboard-like-sheet": 80, "diagram-or-ui-page": 78, "diagram-or-ui-slide": 78, "image-section": 76, "table-section": 74, "multi-table-sheet": 72, "weak-label-slide": 70,
    "weak-section-confidence": 66, "procedure-page": 64, "continued-structure-page": 62,
}
KINDS = {"page-image": 100, "connector": 92, "group": 90, "chart": 86, "picture": 84, "major-region": 82, "table": 80, "auto-shape": 70, "unit-render": 60}
OTHER_REASON, OTHER_KIND, NO_REASON = 58, 56, 50
CONFIDENCE = {"low": 1, "medium": 2, "high": 3}


def _codes(codes: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items())))


def family(external: Column, render: Column, mixed: Column, empty: Column, ambiguous: Column, state: Column) -> Column:
    """The kind of test case that a log record suggests: the first rule that holds."""
    rules = {"external-source-verified-answer": external, "render-required-visual-evidence": render, "mixed-language-query": mixed, "insufficient-or-unanswerable": empty, "ambiguity-or-contradiction": ambiguous, "degraded-grounded-answer": state.isin("partially-grounded", "unresolved")}
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in rules.items()), F.lit("retrieval-or-trace-review"))


def feedback_tags(external: Column, render: Column, mixed: Column, empty: Column, ambiguous: Column, state: Column) -> Column:
    half = state == "partially-grounded"
    tags = F.concat(
        _codes({"retrieval_miss": empty, "should_abstain": empty, "unsupported_synthesis": state == "unresolved", "coverage_gap": half, "incomplete_citation": half, "render_required": render, "contradiction_missed": ambiguous}), _codes({"coverage_gap": mixed})
    )
    return F.when(external, F.lit("")).otherwise(F.array_join(F.array_distinct(tags), ","))


def severity(render: Column, empty: Column, state: Column) -> Column:
    return F.when(render | empty, 3).when(state == "unresolved", 2).when(state == "partially-grounded", 1).otherwise(0).cast("long")


def priority(conversation: Column, origin: Column, feedback: Column, satisfied: Column, render: Column, state: Column) -> Column:
    """Low where nothing is wrong, by origin otherwise; feedback lifts it by a step."""
    fine = satisfied & ~render & (state != "unresolved")
    base = F.when(fine | conversation.isNull(), "low").when(F.coalesce(origin == "interactive-ask", F.lit(False)), "high").otherwise("medium")
    return F.when(feedback <= 0, base).when(base == "low", "medium").otherwise("high")


def effective_origin(own: Column, turn: Column, asked: Column, conversation: Column) -> Column:
    """A record's own origin, its turn's, an ask that either belongs to, or a workflow's if it has a conversation."""
    return F.coalesce(own, turn, F.when(asked, F.lit("interactive-ask")), F.when(conversation.isNotNull(), F.lit("workflow-linked")))


def case_summary(cases: DataFrame, by: str, pass_rate: float, mean_score: float) -> DataFrame:
    """(by, cases, pass_rate, mean_score, failed, review, status) of (case_id, passed, score, outcome): failing comes before degraded."""
    ids = lambda outcome: F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.col("case_id")))), ",")  # noqa: E731  of one suite
    rolled = cases.groupBy(by).agg(F.count("*").alias("cases"), F.round(F.count_if("passed") / F.count("*"), 3).alias("pass_rate"), F.round(F.avg("score"), 3).alias("mean_score"), ids("failed").alias("failed"), ids("review-recommended").alias("review"))
    low = (F.col("pass_rate") < pass_rate) | F.coalesce(F.col("mean_score") < mean_score, F.lit(False))
    return rolled.withColumn("status", F.when(low, "failed").when(F.col("review") != "", "degraded").otherwise("passed"))


def matched_in_order(actual: Column, expected: list[str]) -> Column:
    """How many of the expected events come one after the other; the first that is missing ends the search."""
    rest, n = actual, F.lit(0)
    for e in expected:
        at = F.coalesce(F.array_position(rest, F.lit(e)), F.lit(0))
        n = n + F.when(at > 0, 1).otherwise(0)
        rest = F.when(at > 0, F.slice(rest, (at + 1).cast("int"), F.greatest(F.size(rest), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return n.cast("long")


def change_traits(old_path: Column, path: Column, old_print: Column, print_: Column) -> Column:
    return F.array_join(_codes({"path_changed": old_path != path, "binary_changed": old_print != print_}), ",")


def rebuild_cause(staged: Column, ambiguous: Column, dirty: Column, drifted: Column, incomplete: Column, promotions: Column) -> Column:
    """Why evidence has to be built again: the first cause that holds."""
    rules = {"missing-staging": ~staged, "ambiguous-match": ambiguous > 0, "source-delta": dirty > 0, "staging-signature-drift": drifted, "artifact-contract-backfill": incomplete > 0, "interaction-promotion-only": promotions > 0}
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in rules.items()), F.lit("none"))


def overlay_priority(reasons: Column, kinds: Column, artifacts: Column) -> Column:
    """The heaviest reason or kind, and 2 for each of up to four artifacts."""
    weigh = lambda values, known, other: F.transform(values, lambda v: reduce(lambda c, kv: c.when(v == kv[0], kv[1]), known.items(), F.when(F.lit(False), 0)).otherwise(other))
    base = F.coalesce(F.array_max(F.concat(weigh(reasons, REASONS, OTHER_REASON), weigh(kinds, KINDS, OTHER_KIND))), F.lit(NO_REASON))
    return (base + 2 * F.least(artifacts, F.lit(4))).cast("long")


def strongest(confidence: Column) -> Column:
    """The strongest label of a group; null if none is known."""
    order = reduce(lambda c, kv: c.when(confidence == kv[0], kv[1]), CONFIDENCE.items(), F.when(F.lit(False), 0))
    return F.max_by(F.when(order.isNotNull(), confidence), order)


def batch_progress(chosen: DataFrame, queue: DataFrame, by: str) -> DataFrame:
    """(by, selected, covered, blocked, remaining, resolved): units of a batch that the queue has lost count as remaining."""
    rows = chosen.join(queue.select("source_id", "unit_id", "state"), ["source_id", "unit_id"], "left")
    rolled = rows.groupBy(by).agg(F.count("*").alias("selected"), F.count_if(F.col("state") == "covered").alias("covered"), F.count_if(F.col("state") == "blocked").alias("blocked"))
    rolled = rolled.withColumn("remaining", F.col("selected") - F.col("covered") - F.col("blocked"))
    return rolled.withColumn("resolved", F.col("remaining") == 0)


def artifact_errors(artifacts: DataFrame) -> DataFrame:
    """(source_id, artifact_id, error): missing ids and fields, and ids that a source has more than once."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    named = artifacts.where(~empty("artifact_id"))
    nameless = artifacts.where(empty("artifact_id")).select("source_id", F.lit(None).cast("string").alias("artifact_id"), F.lit("artifact without id").alias("error"))
    twice = named.groupBy("source_id", "artifact_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id", "artifact_id", F.lit("duplicate id").alias("error"))
    missing = [named.where(empty(c)).select("source_id", "artifact_id", F.lit(f"missing {c}").alias("error")) for c in ("artifact_type", "unit_id", "title", "artifact_path")]
    return reduce(DataFrame.union, [nameless, twice, *missing])


def continuation(place: Column, evidence: Column, context: Column, carried: Column) -> tuple[Column, Column]:
    """(type, whether earlier sources are carried on) of a follow-up turn; the first turn has no type."""
    kind = F.when(place > 1, F.when(~evidence, "constraint-update").when(context, "mixed").otherwise("evidence-refresh"))
    return kind, (place > 1) & carried & (~evidence | context)


def relation_type(text: Column, attached: Column, kind: Column) -> Column:
    lowered = F.lower(text)
    said = lambda *ws: reduce(lambda a, b: a | b, (lowered.contains(w) for w in ws))
    return (
        F.when(said("correct", "incorrect"), "corrects-source").when(attached, "visual-reference-for").when(kind == "constraint-update", "constraint-for").when(kind == "mixed", "clarifies-source")
        .when(said("extend", "additional"), "extends-source").otherwise("derived-from-turn")
    )


def without_running_heads(headings: DataFrame) -> DataFrame:
    """Headings of a document that three pages or more repeat go, unless their confidence is high. ``headings``: doc, slug, confidence."""
    times = F.count_if(F.coalesce(F.col("confidence") != "high", F.lit(True))).over(Window.partitionBy("doc", "slug"))
    return headings.withColumn("times", times).where((F.col("times") < 3) | F.coalesce(F.col("confidence") == "high", F.lit(False)))


def directions(edges: DataFrame) -> DataFrame:
    """(source_id, outgoing, incoming): how many edges leave and reach each source, and of how many relations."""
    out = edges.select("source_id", F.lit(1).alias("o"), F.lit(0).alias("i"), "relation_type")
    both = out.union(edges.select("related_source_id", F.lit(0), F.lit(1), "relation_type"))
    return both.groupBy("source_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.countDistinct("relation_type").alias("relations"))


def hint_overlap(questions: DataFrame, hints: DataFrame) -> DataFrame:
    """(question_id, best): the most distinct words that any hint of its topic shares with a question. ``questions``, ``hints``: topic, words and question_id or hint_id."""
    asked = questions.select("question_id", "topic", F.explode("words").alias("word"))
    met = asked.join(hints.select("hint_id", "topic", F.explode("words").alias("word")), ["topic", "word"]).groupBy("question_id", "hint_id").agg(F.count("*").alias("n"))
    best = met.groupBy("question_id").agg(F.max("n").alias("best"))
    return questions.select("question_id").join(best, "question_id", "left").select("question_id", F.coalesce("best", F.lit(0)).cast("long").alias("best"))


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def cell_column(letters: Column) -> Column:
    """A column's number by its letters: A is 1, AA 27."""
    digits = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(digits, F.lit(0).cast("int"), lambda total, d: total * 26 + d)


def cell_range(ref: Column) -> Column:
    """(sheet, c0, r0, c1, r1) of a reference such as ``'My Sheet'!$A$1:C9``; the sheet in lower case, null without."""
    bare = F.replace(ref, F.lit("$"), F.lit(""))
    sheet = F.when(bare.contains("!"), F.lower(F.regexp_replace(F.substring_index(bare, "!", 1), "^'+|'+$", "")))
    area = F.substring_index(bare, "!", -1)
    first, last = F.substring_index(area, ":", 1), F.substring_index(area, ":", -1)
    part = lambda c, p: F.regexp_extract(c, p, 1)
    return F.struct(sheet.alias("sheet"), cell_column(part(first, "^([A-Za-z]+)")).alias("c0"), part(first, "([0-9]+)$").cast("int").alias("r0"), cell_column(part(last, "^([A-Za-z]+)")).alias("c1"), part(last, "([0-9]+)$").cast("int").alias("r1"))


def ranges_overlap(a: Column, b: Column) -> Column:
    apart = F.coalesce(a["sheet"] != b["sheet"], F.lit(False))
    return ~apart & ~((a["c1"] < b["c0"]) | (b["c1"] < a["c0"]) | (a["r1"] < b["r0"]) | (b["r1"] < a["r0"]))


#: Links and images in Markdown.
IMAGE, LINK = r"!\[([^\]]*)\]\(([^)]+)\)", r"\[([^\]]+)\]\(([^)]+)\)"


def link_target(raw: Column) -> Column:
    """A target without brackets, and without a title behind it unless it is a web address."""
    t = F.trim(raw)
    t = F.when(t.startswith("<") & t.endswith(">"), F.trim(F.regexp_replace(t, "^<|>$", ""))).otherwise(t)
    return F.when(t.contains(" ") & ~t.rlike("^https?://"), F.substring_index(t, " ", 1)).otherwise(t)


def inline_refs(lines: DataFrame, text: str) -> DataFrame:
    """The rows of ``lines`` with one row for each link or image: kind, label, target. Images are taken out before links are looked for."""
    pair = lambda t, p: F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("label"), F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("target"))
    bare = F.regexp_replace(F.col(text), IMAGE, " ")
    keep = [c for c in lines.columns if c != text]
    rows = [lines.select(*keep, F.lit(kind).alias("kind"), F.explode(pair(t, p)).alias("r")) for kind, t, p in (("image", F.col(text), IMAGE), ("link", bare, LINK))]
    every = rows[0].union(rows[1]).select(*keep, "kind", F.trim("r.label").alias("label"), link_target(F.col("r.target")).alias("target"))
    return every.where((F.col("kind") == "image") | ~F.col("target").startswith("!"))
