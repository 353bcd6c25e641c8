"""The whole ranking against a walk over all records, source by source."""

import random
from collections import Counter

from siltstone.functions.text import query_tokens
from siltstone.operators import ranking

WORDS = ["table", "chart", "risk", "plan", "cost", "x1", "note", "metric"]


def field(words, text, weight):
    counts = Counter(query_tokens(text or ""))
    return sum(min(counts[w], 2) * weight for w in set(words))


def plain(sources, units, artifacts, query, wanted, resolved):
    words, (to_source, to_unit, how) = query_tokens(query), resolved or (None, None, None)
    out = {}
    for s in sources:
        sid = s["source_id"]
        own = sum(field(words, s[f], w) for f, w in ranking.SOURCE_FIELDS.items())
        exact = sid == to_source and to_unit and how == "exact"
        scored = []
        for u in (u for u in units if u["source_id"] == sid and not (exact and u["unit_id"] != to_unit)):
            lexical = sum(field(words, u[f], w) for f, w in ranking.UNIT_FIELDS.items())
            reference = ranking.REFERENCE_UNIT[how] if sid == to_source and u["unit_id"] == to_unit and how else 0
            meta = ranking.CONFIDENCE.get(u["confidence"], 0) + 0.2 * (u["citation_density"] or 0) + 0.25 * len({*u["channels"]} & {*wanted}) + reference
            if lexical > 0 or reference > 0:
                scored.append((-(lexical + meta), u["unit_id"], lexical, meta, sid == to_source and u["unit_id"] == to_unit))
        scored.sort(key=lambda x: (not x[4], round(x[0], 9), x[1]))
        found, met = [], set()
        for a in (a for a in artifacts if a["source_id"] == sid and not (exact and a["unit_id"] != to_unit)):
            lexical = sum(field(words, a[f], w) for f, w in ranking.ARTIFACT_FIELDS.items())
            if lexical > 0:
                more = 0.4 * bool(a["promoted"]) + 0.5 * (a["artifact_type"] in words) + 1.4 * bool(a["captioned"] and field(words, a["context"], 1) > 0)
                more += 0.35 * (a["artifact_type"] in ("table", "chart") and any(t in words for t in ("table", "chart", "kpi", "metric")))
                found.append((-(lexical + more), a["artifact_id"]))
                met.add(a["unit_id"])
        mine = {a["artifact_id"] for a in artifacts if a["source_id"] == sid}
        found += [(-0.15, u["page_image"]) for u in units if u["source_id"] == sid and u["unit_id"] not in met and u["page_image"] in mine and (u["labels"] or "").strip()]
        found.sort(key=lambda x: (round(x[0], 9), x[1]))
        reference = (5.0 if how == "exact" else 2.5) if sid == to_source else 0
        lu, la = sum(x[2] for x in scored[:3]), -sum(x[0] for x in found[:5])
        if own > 0 or lu > 0 or la > 0 or reference > 0:
            out[sid] = own + lu + la + sum(x[3] for x in scored[:3]) + 0.3 * (s["citation_density"] or 0) + (s["trust"] or 0) + 0.35 * len({*s["channels"]} & {*wanted}) + reference
    return out


def records(rng):
    text = lambda: rng.choice([None, "", " ".join(rng.choice([*WORDS, "other", "words", "here"]) for _ in range(rng.randint(0, 6)))])
    channels = lambda: rng.sample(["text", "render", "media"], rng.randint(0, 3))
    sources = [{"source_id": f"s{i:02d}", **{f: text() for f in ranking.SOURCE_FIELDS}, "channels": channels(), "citation_density": rng.choice([None, 0.5, 3.0]), "trust": rng.choice([None, 0.2]), "family": "corpus", "policy": None, "prior": None, "kind": None, "relevant": None} for i in range(25)]
    units = [{"source_id": s["source_id"], "unit_id": f"u{k}", **{f: text() for f in ranking.UNIT_FIELDS}, "channels": channels(), "confidence": rng.choice([None, "high", "medium", "low", "odd"]), "citation_density": rng.choice([None, 1.0]), "page_image": rng.choice([None, "a0", "a1", "nowhere"])} for s in sources for k in range(rng.randint(0, 6))]
    artifacts = [{"source_id": s["source_id"], "artifact_id": f"a{k}", "unit_id": f"u{rng.randint(0, 4)}", **{f: text() for f in ranking.ARTIFACT_FIELDS}, "artifact_type": rng.choice([None, "table", "chart", "picture"]), "captioned": rng.choice([None, True, False]), "promoted": rng.choice([None, True, False])} for s in sources for k in range(rng.randint(0, 7))]
    return sources, units, artifacts


def test_whole_ranking(spark):
    rng = random.Random(12)
    s, u, a = records(rng)
    text = lambda fields: ", ".join(f"{f} string" for f in fields)
    frames = (
        spark.createDataFrame(s, f"source_id string, {text(ranking.SOURCE_FIELDS)}, channels array<string>, citation_density double, trust double, family string, policy string, prior string, kind string, relevant boolean"),
        spark.createDataFrame(u, f"source_id string, unit_id string, {text(ranking.UNIT_FIELDS)}, channels array<string>, confidence string, citation_density double, page_image string"),
        spark.createDataFrame(a, f"source_id string, artifact_id string, unit_id string, {text(ranking.ARTIFACT_FIELDS)}, artifact_type string, captioned boolean, promoted boolean"),
    )
    queries = {"q1": "Risk of the table plan", "q2": "cost x1", "q3": "chart metric metric", "q4": "nothing here that is known", "q5": "zzz"}
    preferred = {"q1": ["text"], "q3": ["media", "render"]}
    resolved = {"q2": ("s03", "u1", "exact"), "q3": ("s04", "u0", "approximate"), "q5": ("s07", None, "exact")}
    got = {}
    for r in ranking.scores(*frames, queries, preferred, resolved).collect():
        got.setdefault(r["query_id"], {})[r["source_id"]] = round(r["total"], 6)
    for q, query in queries.items():
        want = {k: round(v, 6) for k, v in plain(s, u, a, query, preferred.get(q, []), resolved.get(q)).items()}
        assert got.get(q, {}) == want, q
