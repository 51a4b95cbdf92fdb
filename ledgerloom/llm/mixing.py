"""Mixing sources to target weights (operator 3), in DataFrame functions only.

Every document gets a hash-random key. Within its source, documents stand in key order; the source's budget cuts that
order at an exact word. Keys are cut into ranges of about BLOCK documents; prefix sums over the ranges' word counts tell
in which range a source's budget ends, and only that range is sorted row by row. What comes out is one cut for each
source, (key, doc_id, text hash), and every document is then compared with its source's cut: no text is ever shuffled,
and a source with a third of all documents is dealt to as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import staged, text_of

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a block on average. Blocks come from the documents' counts, so tasks keep this size as data grows.
BLOCK = 512
#: Blocks of a run of blocks, on average.
RUN = 2048
SEED = 20
KEY_SPAN = float(2**31)
NEW = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds target to the sources (one row each, with source and source_size).

    Sources by code point, null last, weigh weights, repeating. They share share times all words by weight; a target
    stops at most times its source's size, and what is over goes to the others by weight until none is above. The level
    at which that settles follows from the sources in the order of size by weight. One small row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(pick, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # Sources in this order are capped until the first whose level it doesn't reach.
    first = level.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    settled = first.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.row_number().over(by_level).alias("k"), F.col("level").alias("level")))).over(whole))
    target = F.when(F.col("at").isNull() | (F.row_number().over(by_level) < F.col("at.k")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at.level") * F.col("weight")))
    return settled.select(*sizes.columns, target.cast("double").alias("target"))


def _hidden(text: str, source: str, doc_id: str, seed: int) -> dict[str, Column]:
    """A document's place in the order of its source. Without a doc_id the text makes the key, so such rows spread too."""
    tie = F.xxhash64(F.col(text), F.lit(seed))
    key = F.xxhash64(F.col(doc_id), F.when(F.col(doc_id).isNull(), tie), F.lit(seed))
    return {
        "_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")),
        "_at": F.struct(key.alias("key"), F.col(doc_id).alias("id"), tie.alias("tie")),
    }


def _block(blocks: str = "_blocks") -> Column:
    """Key ranges: keys are spread evenly over 31 bits, so the ranges of a source are about equal."""
    return F.floor(F.shiftrightunsigned("_at.key", 33) * F.col(blocks) / F.lit(KEY_SPAN)).cast("long")


def source_cuts(narrow: DataFrame, source: str, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """One row for each source: source_size, target, epochs, and where its last epoch ends.

    narrow has source, _source, _at and _size. Rows before _cut are taken once more than epochs, rows after it are not;
    the _ties rows that stand at it have _each words apiece, of which the first _left words are taken.
    """
    sources = narrow.groupBy("_source").agg(F.first(source).alias("source"), F.count("*").alias("n"), F.sum("_size").alias("source_size"))
    targets = source_targets(sources, share, most, weights).withColumn("_blocks", F.ceil(F.col("n") / BLOCK))
    budget = F.floor(F.col("target"))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    targets = staged(targets.withColumn("_rest", budget - F.col("epochs") * F.col("source_size")).drop("source", "n"), "targets")
    sums = narrow.join(targets.select("_source", "_blocks"), "_source").groupBy("_source", _block().alias("_block")).agg(F.sum("_size").alias("_sum"))
    sums = staged(sums.withColumn("_run", F.floor(F.col("_block") / RUN)), "blocks")
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column, *by: F.coalesce(F.sum(column).over(earlier(*by)), F.lit(0))
    runs = sums.groupBy("_source", "_run").agg(F.sum("_sum").alias("_run_sum"))
    runs = runs.select("_source", "_run", before("_run_sum", "_source", "_run").alias("_run_start"))
    starts = sums.join(runs, ["_source", "_run"]).withColumn("_start", F.col("_run_start") + before("_sum", "_source", "_run", "_block"))
    ends = starts.join(targets.select("_source", "_rest", "_blocks"), "_source").where("_start <= _rest and _rest < _start + _sum")
    ends = staged(ends.select("_source", "_blocks", "_rest", "_block", "_start"), "ends")  # one range for each source
    # Repeated rows of one doc_id and text are one row here, however many they are.
    rows = narrow.join(ends.withColumnRenamed("_block", "_last"), "_source").where(_block() == F.col("_last"))
    rows = rows.groupBy("_source", "_at", "_rest", "_start").agg(F.count("*").alias("_ties"), F.max("_size").alias("_each"), F.sum("_size").alias("_sum"))
    rows = rows.withColumn("_left", F.col("_rest") - F.col("_start") - before("_sum", "_source", "_at"))
    cut = rows.where("_left >= 0 and _left < _sum").select("_source", F.col("_at").alias("_cut"), "_ties", "_each", "_left")
    return staged(targets.drop("_blocks", "_rest", "weight", "cap").join(cut, "_source", "left"), "cuts")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds _k to rows that stand at their sources' cuts: their number within the source, from 0.

    They are numbered in two steps, task by task, since one document may be repeated without bound.
    """
    held = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "ties").withColumn("_task", F.shiftright("_row", 33))
    counts = held.groupBy("_source", "_task").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_source", "_task", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    k = F.row_number().over(Window.partitionBy("_source", "_task").orderBy("_row")) - 1
    return held.withColumn("_k", k).join(counts, ["_source", "_task"]).withColumn("_k", F.col("_k") + F.col("_first")).drop("_row", "_task", "_first")


def _placed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (with _source and _at) with their source's cut and _part: the words taken of the last epoch; -1 stands for all."""
    d = rows.join(cuts, "_source")
    at = F.coalesce(F.col("_at") == F.col("_cut"), F.lit(False))
    if cuts.where("_ties > 1").isEmpty():
        d = d.withColumn("_k", F.lit(0).cast("long"))
    else:
        d = d.where(~at).withColumn("_k", F.lit(0).cast("long")).unionByName(_numbered(d.where(at)))
    own = F.col("_left") - F.col("_k") * F.col("_each")
    part = F.when(F.coalesce(F.col("_at") < F.col("_cut"), F.lit(False)) | (at & (own >= F.col("_each"))), -1)
    return d.withColumn("_part", part.when(at, F.greatest(F.lit(0), own)).otherwise(0).cast("long"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: bool = True, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Adds size, source_size, target and taken to docs, or with carry=False to their doc_id and source alone.

    taken is the number of words that the mix takes of a document: its whole size once for each full epoch, and in the
    last, partial epoch what fits before the budget (the target, rounded down) is used up; one document of each source
    is cut there. taken is never above 2 times the size. Reruns agree: keys are hashes of doc_id, ties go by text, so
    rows that tie in both are interchangeable.
    Null texts have size 0. A null source is a source of its own, last in order. Rows with a null doc_id are mixed
    like others, with keys from their texts. An empty table gives an empty result. Columns of docs with the new names are
    replaced; names that begin with an underscore are the operator's own where they clash.
    """
    base = docs.drop(*[c for c in NEW if c in docs.columns and c not in (text, source, doc_id)])
    kept = base.columns if carry else list(dict.fromkeys([doc_id, source]))
    narrow = _narrow(base, text, source, doc_id, seed)
    cuts = source_cuts(narrow, source, share, most, weights)
    rows = base.withColumns(_hidden(text, source, doc_id, seed) | {"_size": word_count(text_of(text))}) if carry else narrow
    taken = F.col("epochs") * F.col("_size") + F.when(F.col("_part") < 0, F.col("_size")).otherwise(F.col("_part"))
    return _placed(rows, cuts).select(*kept, F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def _narrow(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    """Sizes and places without the texts, counted once; all sums come from this table."""
    places = [v.alias(k) for k, v in _hidden(text, source, doc_id, seed).items()]
    return staged(docs.select(doc_id, source, *places, word_count(text_of(text)).alias("_size")), "sizes")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mixed documents with their own columns: each as often as it is taken whole, and the cut one's first words.

    A document of which nothing is taken goes, so null texts and texts without words go. n_chars, where there is such a
    column, is set anew for the cut document alone. Null sources and doc_ids are treated as in mixed(); repeated rows
    are each mixed; an empty table gives an empty result; extra columns of any name are carried along.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    cuts = source_cuts(_narrow(held, "text", "source", "doc_id", seed), "source", share, most, weights)
    rows = held.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumns(_hidden("text", "source", "doc_id", seed))
    d = _placed(rows, cuts)
    whole = F.col("epochs") + F.when(F.col("_part") < 0, 1).otherwise(0)
    copies = F.array_repeat(F.lit(None).cast("long"), whole.cast("int"))
    d = d.select("row", F.explode(F.when(F.col("_part") > 0, F.array_append(copies, F.col("_part"))).otherwise(copies)).alias("_words"))
    # A zero-width cut after each word; the first pieces, joined again, are the text up to that word's end.
    first = F.array_join(F.slice(F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col("_words").cast("int")), "")
    out = d.withColumn("_out", F.when(F.col("_words").isNull(), F.col("row.text")).otherwise(first))
    size = F.when(F.col("_words").isNull(), F.col("row.n_chars")).otherwise(F.length("_out")) if "n_chars" in docs.columns else None
    fields = [F.col("_out").alias("text") if c == "text" else size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*fields)
