"""Identity of files across inventories as one matching: claims that depend on earlier claims.

Files claim known sources in the order of their paths (component by component). A file whose path an active source has claims that source. Any other file (a stranger)
looks at the sources of its fingerprint, archived ones included, that no earlier file has claimed: the only one is claimed, several make the file ambiguous. Where
none is left, it looks at the unclaimed active sources of its type with a like name and size, in the same way. So every claim takes a source away
from later files, and a file that lies before the old path of its copy takes that one's identity.

The walk is solved in rounds. Of a fingerprint's sources only the two that are claimed last matter: a stranger before the second of them is ambiguous, the first stranger behind it and
before the last claims, all later ones find none. A round counts with the claims that are certain, and with all that are possible besides; where both counts agree,
or two sources are left either way, the stranger is decided. A stranger that surely finds two makes no claim, so most need no round of their own. The earliest
undecided one is decided in every round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators.changes import NAME_LEAST, PARTS, SIZE_LEAST, name_likeness
from siltstone.storage import settled

NEVER = "\U0010ffff"  # a turn after all paths
FIRST = 16, 256  # sources of a block among which two are looked for, and again if that was not enough


def turn(path: Column) -> Column:
    """Paths in the order of their components."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.array_join(tokens(F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")), " ")


def relocations(strangers: DataFrame, active: DataFrame, first: int | None = None) -> DataFrame:
    """(turn, source_id): strangers and the active sources of like name and size that no earlier path has.

    They meet in blocks of a type and of size and name length classes, as names of such likeness have 13 of 27 of their lengths in common at least. Files without a size,
    or of size 0, are like in size to all (0.9), so they meet by type and length alone. With ``first`` a block has only so many sources, those whose turn to go comes last.
    Few rows make many pairs, so tasks go by a number: strangers are dealt out by turn where blocks are cut, else the sources of a block in ``PARTS`` parts.
    """
    low = NAME_LEAST / (2 - NAME_LEAST)
    steps = lambda x, base: F.floor(F.log(x) / F.log(F.lit(1 / base))).cast("long")
    has_size = F.coalesce(F.col("size") > 0, F.lit(False))
    known = lambda df, own, path: df.select(own, "document_type", F.col("file_size").alias("size"), stem(F.col(path)).alias("stem")).where("stem <> '' and document_type is not null").withColumns({"sized": has_size, "long": steps(F.char_length("stem"), low)})
    a, b = known(strangers, "turn", "current_path"), known(active, F.struct("source_id", "old_turn").alias("old"), "old_path")
    b = b.withColumnsRenamed({"size": "old_size", "stem": "old_stem", "sized": "old_sized"})
    near = lambda x: F.explode(F.array(x - 1, x, x + 1))
    class_of = lambda c: steps(F.greatest(c, F.lit(1)), SIZE_LEAST)
    tasks = 2 * int(strangers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(a: DataFrame, b: DataFrame, size_a: Column, size_b: Column) -> DataFrame:
        block = lambda size: F.concat_ws("|", size, "long", "document_type")
        a, b = (df.withColumn("cell", block(size)).drop("long", "document_type") for df, size in ((a.withColumn("long", near(F.col("long"))).withColumn("_size", size_a), F.col("_size")), (b, size_b)))
        a = a.drop("_size")
        if first:
            place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("old.old_turn"), F.xxhash64("old.source_id"), "old.source_id"))
            return a.repartition(tasks, "turn").join(F.broadcast(b.withColumn("_place", place).where(F.col("_place") <= first).drop("_place")), "cell").drop("cell")  # blocks are few
        part, every = F.pmod(F.xxhash64("old.source_id"), F.lit(PARTS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
        in_part = lambda df, part: df.withColumn("_part", part).withColumn("cell", F.concat_ws("|", "_part", "cell")).drop("_part").repartition(tasks, "cell")
        return in_part(a, every).join(in_part(b, part), "cell").drop("cell")

    none = F.lit("-")
    both = meet(a.where("sized"), b.where("old_sized"), near(class_of("size")), class_of("old_size"))
    open_ = meet(a.where("not sized"), b, none, none).unionByName(meet(a.where("sized"), b.where("not old_sized"), none, none))
    ratio = F.when(F.col("sized") & F.col("old_sized"), F.least("size", "old_size") / F.greatest("size", "old_size")).otherwise(SIZE_LEAST)
    bound = 2.0 * F.least(F.char_length("stem"), F.char_length("old_stem")) / (F.char_length("stem") + F.char_length("old_stem"))
    met = both.unionByName(open_).where(F.col("old.old_turn") > F.col("turn")).where((ratio >= SIZE_LEAST) & (bound >= NAME_LEAST))
    return met.withColumn("name", name_likeness("stem", "old_stem")).where(F.col("name") >= NAME_LEAST).select("turn", "old.source_id")


def likes(strangers: DataFrame, active: DataFrame) -> DataFrame:
    """(turn, source_id): what ``matched`` must know of likeness: all pairs of some strangers, two pairs of every other one, which finds these two free whatever happens.

    A source is safe if no stranger has its fingerprint and no poor stranger is like it; a stranger that is like fewer than two safe sources is poor. Those that are not poor are ambiguous at the
    latest when likeness counts, so by likeness only the poor ever claim. Two safe sources are looked for among the first of each block; only strangers for whom that is not enough
    meet all sources. As more strangers prove poor, fewer sources are safe, until nothing changes.
    """
    taken = settled(active.join(strangers.select(F.col("new_print").alias("print")), "print", "left_semi").select("source_id"))
    safe = settled(active.join(taken, "source_id", "left_anti"))
    pair = F.count("*") >= 2
    left, some = strangers, []
    for first in FIRST:
        found = settled(relocations(left, safe, first))
        rich = found.groupBy("turn").agg(pair.alias("rich")).where("rich").select("turn")
        some.append(found.join(rich, "turn", "left_semi"))
        left = settled(left.join(rich, "turn", "left_anti"))
        if left.isEmpty():
            break
    some, whole = settled(reduce(DataFrame.union, some)), settled(relocations(left, active)) if not left.isEmpty() else left.select("turn", F.lit("").alias("source_id"))
    unsafe, before = taken, -1
    while True:
        rich = lambda df: df.join(unsafe, "source_id", "left_anti").groupBy("turn").agg(pair.alias("rich")).where("rich").select("turn")  # noqa: B023, E731
        fallen = settled(some.select("turn").distinct().join(rich(some), "turn", "left_anti"))
        if not fallen.isEmpty():
            whole = settled(whole.union(relocations(strangers.join(fallen, "turn", "left_semi"), active)))
            some = settled(some.join(fallen, "turn", "left_anti"))
        poor = settled(whole.select("turn").distinct().join(rich(whole), "turn", "left_anti"))
        if (size := poor.count()) == before:
            break
        unsafe, before = settled(taken.union(whole.join(poor, "turn", "left_semi").select("source_id")).distinct()), size
    free = some.join(unsafe, "source_id", "left_anti").union(whole.join(poor, "turn", "left_anti").join(unsafe, "source_id", "left_anti").select("source_id", "turn"))
    two = free.groupBy("turn").agg(F.array(F.min("source_id"), F.max("source_id")).alias("two")).select("turn", F.explode("two").alias("source_id"))
    return two.union(whole.join(poor, "turn", "left_semi").select("turn", "source_id"))


def _last_two(sources: DataFrame, t: str) -> DataFrame:
    """(print, last, last_id, second): of each fingerprint the two sources whose turns to go come last."""
    order = Window.partitionBy("print").orderBy(F.desc(t), "source_id")
    best = sources.where("print is not null").withColumn("place", F.row_number().over(order)).where("place <= 2")
    pick = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    return best.groupBy("print").agg(pick(1, t).alias("last"), pick(1, "source_id").alias("last_id"), pick(2, t).alias("second"))


def _left(open_: DataFrame, sources: DataFrame, pairs: DataFrame, t: str, name: str) -> DataFrame:
    """``open_`` with what each stranger finds if sources go at ``t``: of its fingerprint (2 stands for more), and by likeness."""
    prints = _last_two(sources, t).withColumnRenamed("print", "_print")
    found = F.when(F.col("second") >= F.col("turn"), 2).when(F.col("last") >= F.col("turn"), 1).otherwise(0)
    out = open_.join(prints, F.col("print") == F.col("_print"), "left").withColumns({f"prints_{name}": F.coalesce(found, F.lit(0)), f"print_id_{name}": F.col("last_id")}).drop("_print", "last", "last_id", "second")
    free = pairs.join(sources.select("source_id", F.col(t).alias("goes")), "source_id").where("goes >= turn").groupBy(F.col("turn").alias("_turn")).agg(F.count("*").alias(f"like_{name}"), F.min("source_id").alias(f"like_id_{name}"))
    return out.join(free, F.col("turn") == F.col("_turn"), "left").withColumn(f"like_{name}", F.coalesce(f"like_{name}", F.lit(0))).drop("_turn")


def _possible(open_: DataFrame, sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """``sources`` with ``low``: the turn at which each may be gone at the earliest, whatever undecided strangers do."""
    low, before = sources.withColumn("low", F.col("t")), -1
    while True:
        seen = _left(open_, low, pairs, "low", "low")
        may = settled(seen.where(((F.col("stage") == 1) & (F.col("prints_low") <= 1)) | ((F.col("stage") == 2) & (F.col("like_low") <= 1))).select("turn", "print", "stage", "like_low"))
        size = may.count()
        if size <= before:
            return low
        by_print = may.where("stage = 1").groupBy(F.col("print").alias("_print")).agg(F.min("turn").alias("by_print"))
        by_like = pairs.join(may.where("like_low <= 1").select("turn"), "turn").groupBy(F.col("source_id").alias("_id")).agg(F.min("turn").alias("by_like"))
        wide = sources.join(by_print, F.col("print") == F.col("_print"), "left").join(by_like, F.col("source_id") == F.col("_id"), "left")
        low, before = settled(wide.select("source_id", "print", "t", F.least("t", F.coalesce("by_print", F.lit(NEVER)), F.coalesce("by_like", F.lit(NEVER))).alias("low"))), size


def _decided(open_: DataFrame, sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """``open_`` with ``stage`` and ``verdict`` after one round: ambiguous, claim (of ``claimed``), new, or null."""
    seen = _left(_left(open_, sources, pairs, "t", "high"), _possible(open_, sources, pairs), pairs, "low", "low")
    first = seen.where("stage = 1 and prints_low < 2").groupBy(F.col("print").alias("_print")).agg(F.min("turn").alias("first_turn"))
    seen = seen.join(first, F.col("print") == F.col("_print"), "left")
    by_print = F.when(F.col("prints_low") == 2, "ambiguous").when((F.col("prints_high") == 1) & (F.col("prints_low") == 1) & (F.col("turn") == F.col("first_turn")), "claim")
    by_like = F.when(F.col("like_low") >= 2, "ambiguous").when(F.col("like_high") == 0, "new").when((F.col("like_high") == 1) & (F.col("like_low") == 1), "claim")
    stage = F.when((F.col("stage") == 1) & (F.col("prints_high") == 0), 2).otherwise(F.col("stage"))
    verdict = F.when(F.col("stage") == 1, by_print).otherwise(by_like)
    claimed = F.when(verdict == "claim", F.when(F.col("stage") == 1, F.col("print_id_high")).otherwise(F.col("like_id_high")))
    return seen.select("turn", "print", stage.alias("stage"), verdict.alias("verdict"), claimed.alias("claimed"))


def matched(now: DataFrame, before: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(current_path, source_id, change, basis, traits, previous_path) for all files of ``now``, and a row for each active source that nothing claimed.

    ``now`` has current_path (distinct), fingerprint, file_size, document_type; ``before`` also source_id (distinct) and active. basis is path, fingerprint, relocation, new,
    ambiguous-fingerprint, ambiguous-relocation, or absent for deleted sources; files without a source have none. Without ``fuzzy`` nothing is claimed by likeness.
    Files with a null path and sources with a null id are left out; of active sources with one path the one with the largest id has it; a null fingerprint is like no other.
    """
    old = before.where("source_id is not null").select(F.col("source_id"), F.col("current_path").alias("old_path"), F.col("fingerprint").alias("print"), "file_size", "document_type", F.coalesce("active", F.lit(True)).alias("active"))
    files = now.where("current_path is not null").select("current_path", turn(F.col("current_path")).alias("turn"), F.col("fingerprint").alias("new_print"), "file_size", "document_type")
    owners = old.where("active and old_path is not null").groupBy(F.col("old_path").alias("current_path")).agg(F.max("source_id").alias("source_id"))
    stay = settled(files.join(owners, "current_path").select("turn", "source_id"))
    strangers = settled(files.join(owners, "current_path", "left_anti"))
    gone = stay.withColumnRenamed("turn", "t")
    old = settled(old.join(gone, "source_id", "left").withColumn("t", F.coalesce("t", F.lit(NEVER))))

    pairs = settled(likes(strangers, old.where("active and old_path is not null").withColumn("old_turn", F.col("t")))) if fuzzy else strangers.sparkSession.createDataFrame([], "turn string, source_id string")
    # a source is at stake if a stranger looks at it: the others never change hands
    looked = old.join(strangers.select(F.col("new_print").alias("print")), "print", "left_semi").select("source_id").union(pairs.select("source_id")).distinct()
    sources = settled(old.join(looked, "source_id").select("source_id", "print", "t"))
    open_ = settled(strangers.select("turn", F.col("new_print").alias("print"), F.lit(1).alias("stage")))
    done = None
    while not open_.isEmpty():
        seen = settled(_decided(open_, sources, pairs))
        settled_now = seen.where("verdict is not null")
        done = settled_now if done is None else done.union(settled_now)
        claims = seen.where("verdict = 'claim'").groupBy(F.col("claimed").alias("_id")).agg(F.min("turn").alias("by"))
        sources = settled(sources.join(claims, F.col("source_id") == F.col("_id"), "left").select("source_id", "print", F.least("t", F.coalesce("by", F.lit(NEVER))).alias("t")))
        open_ = settled(seen.where("verdict is null").select("turn", "print", "stage"))
        pairs = pairs.join(open_.select("turn"), "turn", "left_semi")

    kinds = stay.select("turn", F.lit("path").alias("basis"), "source_id")
    if done is not None:
        way = F.when(F.col("stage") == 1, "fingerprint").otherwise("relocation")
        basis = F.when(F.col("verdict") == "new", "new").when(F.col("verdict") == "ambiguous", F.concat(F.lit("ambiguous-"), way)).otherwise(way)
        kinds = kinds.union(done.select("turn", basis.alias("basis"), F.col("claimed").alias("source_id")))
    of = old.select(F.col("source_id").alias("_id"), F.col("old_path"), F.col("print"))
    rows = files.join(kinds, "turn").join(of, F.col("source_id") == F.col("_id"), "left")
    change = F.when(F.col("basis") == "path", F.when(F.col("print").eqNullSafe(F.col("new_print")), "unchanged").otherwise("modified")).when(F.col("basis") == "new", "added").when(F.startswith("basis", F.lit("ambiguous")), "ambiguous").otherwise("moved_or_renamed")
    traits = F.array_join(F.array_compact(F.array(F.when(F.col("old_path") != F.col("current_path"), "path_changed"), F.when(F.col("print") != F.col("new_print"), "binary_changed"))), ",")
    rows = rows.select("current_path", "source_id", change.alias("change"), "basis", traits.alias("traits"), F.col("old_path").alias("previous_path"))
    lost = old.where("active").join(kinds.select("source_id"), "source_id", "left_anti")
    return rows.union(lost.select("old_path", "source_id", F.lit("deleted"), F.lit("absent"), F.lit(""), "old_path"))
