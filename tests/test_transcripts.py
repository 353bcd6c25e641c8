"""Alignment of two logs, strings and attachments of nested JSON, against plain walks."""

import json
import random

from siltstone.operators import transcripts

TURNS = "conv long, turn long, text string, opened_at long"


def plain_alignment(mirror, native, end):
    used, out = set(), []
    norm = lambda t: " ".join((t or "").split()).lower()
    for i, (turn, text, opened) in enumerate(mirror):
        ends = mirror[i + 1][2] if i + 1 < len(mirror) else end
        best, which = -1, None
        for j, (_, other, at) in enumerate(native):
            if j in used:
                continue
            a, b, score = norm(text), norm(other), 0
            if a and b:
                score += 100 if a == b else 60 if a in b or b in a else 0
            score += 20 * (at is not None and opened is not None and at >= opened) + 20 * (at is not None and ends is not None and at < ends) + 5 * (i == j)
            if score > best:
                best, which = score, j
        if which is not None and best > 0:
            used.add(which)
            out.append((turn, native[which][0], best))
    return out


def test_alignment(spark):
    rng = random.Random(3)
    words = ["go", "go on", "Go  ON", "stop", "", None, "on and on", "x"]
    turns = lambda: [(t, rng.choice(words), rng.choice([None, 10 * t, 10 * t + rng.randint(-15, 15)])) for t in range(rng.randint(0, 8))]
    logs = {c: (turns(), turns(), rng.choice([None, 60])) for c in range(60)}
    rows = lambda k: [(c, *t) for c, log in logs.items() for t in log[k]]
    ends = spark.createDataFrame([(c, log[2]) for c, log in logs.items()], "conv long, ended_at long")
    got = transcripts.aligned_turns(spark.createDataFrame(rows(0), TURNS), spark.createDataFrame(rows(1), TURNS), ends).collect()
    assert sorted(tuple(r) for r in got) == sorted((c, *p) for c, log in logs.items() for p in plain_alignment(*log))


def random_value(rng, depth=0):
    kind = rng.choice(["s", "n", "l", "o", "b"]) if depth < 5 else "s"
    if kind == "l":
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == "o":
        return {k: random_value(rng, depth + 1) for k in rng.sample(["a", "b", "type", "content"], rng.randint(0, 3))}
    return {"s": rng.choice(["", "text", "é\n"]), "n": rng.choice([1, 2.5, None]), "b": True}[kind]


def strings(value, path="$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from strings(x, f"{path}[{i}]")
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from strings(x, f"{path}.{k}")


def test_strings_at_any_depth(spark):
    rng = random.Random(5)
    docs = {str(i): random_value(rng) for i in range(120)}
    records = transcripts.parsed(spark.createDataFrame([*((d, json.dumps(v)) for d, v in docs.items()), ("bad", "{no json"), ("null", None)], "doc string, json string"))
    got = sorted(tuple(r) for r in transcripts.nested_strings(records).collect())
    assert got == sorted((d, *s) for d, v in docs.items() for s in strings(v))


def plain_attachments(content):
    out = []

    def visit(x):
        if isinstance(x, list):
            for y in x:
                visit(y)
        elif isinstance(x, dict):
            if x.get("type") in ("image", "input_image"):
                source = x.get("source") if isinstance(x.get("source"), dict) else {}
                if isinstance(x.get("image_url"), str) and x["image_url"]:
                    out.append(x["image_url"])
                elif source.get("type") == "base64" and isinstance(source.get("data"), str) and source["data"]:
                    kind = next((m for m in (source.get("media_type"), x.get("media_type")) if isinstance(m, str) and m), "application/octet-stream")
                    out.append(f"data:{kind};base64,{source['data']}")
                elif source.get("type") == "url" and isinstance(source.get("url"), str) and source["url"].startswith("data:"):
                    out.append(source["url"])
            if x.get("type") == "tool_result":
                visit(x.get("content"))

    visit(content)
    return out


def test_attachments(spark):
    rng = random.Random(6)

    def content(depth=0):
        if depth > 4 or rng.random() < 0.4:
            source = rng.choice([None, 5, {"type": "base64", "data": rng.choice(["QQ==", "", 7]), "media_type": rng.choice(["image/png", "", 3])}, {"type": "url", "url": rng.choice(["data:,x", "http://x"])}])
            return {"type": rng.choice(["image", "input_image", "text", 4]), "image_url": rng.choice([None, "", 9, "http://i"]), "source": source, "media_type": rng.choice(["m/n", None]), "content": [{"type": "image", "image_url": "hidden"}]}
        if rng.random() < 0.5:
            return {"type": rng.choice(["tool_result", "other"]), "content": content(depth + 1)}
        return [content(depth + 1) for _ in range(rng.randint(0, 12))]

    docs = {str(i): content() for i in range(80)}
    records = transcripts.parsed(spark.createDataFrame([(d, json.dumps(v)) for d, v in docs.items()], "doc string, json string"))
    got = sorted(tuple(r) for r in transcripts.attachments(records).collect())
    assert got == sorted((d, n, url) for d, v in docs.items() for n, url in enumerate(plain_attachments(v), 1)) and len(got) > 50


def test_empty(spark):
    none = transcripts.parsed(spark.createDataFrame([], "doc string, json string"))
    assert transcripts.nested_strings(none).collect() == [] and transcripts.attachments(none).collect() == []
