"""Identity matching against the walk in the order of paths."""

import random
from difflib import SequenceMatcher
from pathlib import PurePosixPath

import pytest

from siltstone.functions.text import query_tokens
from siltstone.operators import identity

NOW = "current_path string, fingerprint string, file_size long, document_type string"
BEFORE = f"source_id string, {NOW}, active boolean"


def walked(now, before, fuzzy=True):
    """(current_path, source_id, change, basis) file by file."""
    paths, taken, out = {}, set(), []
    for s in sorted(before, key=lambda s: s[0]):
        if s[5] and s[1] is not None:
            paths[s[1]] = s

    def score(path, size, s):
        a, b = (" ".join(query_tokens(PurePosixPath(x).stem)) for x in (path, s[1]))
        if not a or not b:
            return 0
        name = SequenceMatcher(None, a, b).ratio()
        like = min(size, s[3]) / max(size, s[3]) if size and s[3] and size > 0 and s[3] > 0 else 0.9
        return 0 if name < 0.65 or like < 0.9 else 0.7 * name + 0.3 * like

    for path, print_, size, kind in sorted(now, key=lambda f: f[0].split("/")):
        mine, basis = paths.get(path), "path"
        if mine is None:
            found, basis = [s for s in before if s[2] == print_ and print_ is not None and s[0] not in taken], "fingerprint"
            if not found and fuzzy:
                found, basis = [s for s in before if s[5] and s[1] is not None and s[0] not in taken and s[4] == kind and score(path, size, s) > 0], "relocation"
            mine = found[0] if len(found) == 1 else None
            basis = basis if mine else f"ambiguous-{basis}" if found else "new"
        if mine:
            taken.add(mine[0])
        change = "added" if basis == "new" else "ambiguous" if mine is None else "moved_or_renamed" if basis != "path" else "unchanged" if mine[2] == print_ else "modified"
        out.append((path, mine and mine[0], change, basis))
    return sorted(map(str, out + [(s[1], s[0], "deleted", "absent") for s in before if s[5] and s[0] not in taken]))


def inventories(seed):
    """Few names, prints and sizes, so that files compete for sources; some old paths are still there, some sources are archived."""
    rng = random.Random(seed)
    names = ["report", "report final", "reports", "plan", "plan b", "x", "note 1", "note 2", "a-b", "a"]
    path = lambda: "/".join(rng.choice(["a", "a-b", "b", "a b"]) for _ in range(rng.randint(0, 2))) + "/" + rng.choice(names) + rng.choice([".md", ".txt", ""])
    print_ = lambda: rng.choice([*"pqrstuvw", None])
    kind, size = (lambda: rng.choice(["md", "txt"])), (lambda: rng.choice([0, 95, 100, 102, 120, 5000]))
    before = [(f"s{i:02d}", path(), print_(), size(), kind(), rng.random() < 0.75) for i in range(rng.randint(0, 30))]
    now = {path(): (print_(), size(), kind()) for _ in range(rng.randint(0, 25))}
    now |= {s[1]: (rng.choice([s[2], print_()]), s[3], s[4]) for s in before if rng.random() < 0.3}
    return [(p, *rest) for p, rest in now.items()], before


def got(spark, now, before, fuzzy=True):
    out = identity.matched(spark.createDataFrame(now, NOW), spark.createDataFrame(before, BEFORE), fuzzy).collect()
    return sorted(str((r["current_path"], r["source_id"], r["change"], r["basis"])) for r in out)


@pytest.mark.parametrize("seed", range(8))
def test_random_inventories(spark, seed):
    now, before = inventories(seed)
    assert got(spark, now, before, seed % 3 > 0) == walked(now, before, seed % 3 > 0)


def test_claims_that_hang_on_claims(spark):
    """Each file can claim only once the one before has."""
    before = [("s1", "old/alpha.md", "p1", 100, "md", True), ("s2", "old/alphas.md", "p2", 100, "md", True), ("s3", "z/beta.md", "p3", 100, "md", True), ("s4", "z/gamma.md", "p3", 100, "md", False)]
    now = [("a/1.md", "p1", 100, "md"), ("b/alpha.md", "q", 100, "md"), ("c/alpha.md", "q", 100, "md"), ("d/beta.md", "p3", 100, "md"), ("z/beta.md", "p3", 100, "md"), ("zz/copy.md", "p3", 100, "md")]
    assert got(spark, now, before) == walked(now, before)


def test_many_copies_take_few_rounds(spark):
    """Copies of one content: ambiguous while two are left, then one claims, then none is left."""
    before = [(f"s{i:03d}", f"k/{i:03d}.md", "p", 100, "md", True) for i in range(60)]
    now = [(f"k/{i:03d}.md", "p", 100, "md") for i in range(60)] + [(f"k/{i:03d}+.txt", "p", 9, "txt") for i in range(60)]
    assert got(spark, now, before) == walked(now, before)


def test_empty_and_null(spark):
    assert got(spark, [], []) == []
    before = [(None, "a", "p", 1, "md", True), ("s", None, "p", None, None, None), ("u", "b", None, None, "md", True)]
    now = [("c", None, None, None), ("b.md", "q", None, "md")]
    rows = identity.matched(spark.createDataFrame([*now, (None, "p", 1, "md")], NOW), spark.createDataFrame(before, BEFORE)).collect()
    assert sorted((str(r["current_path"]), str(r["source_id"]), r["basis"]) for r in rows) == [("None", "s", "absent"), ("b.md", "u", "relocation"), ("c", "None", "new")]
