"""From questions to seeds, and node text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

# Properties searched for keywords, and those that lead a node's text.
KEYWORD_PROPS = ["address", "category", "cause", "claim_number", "email", "endorsement_number", "name", "occupation", "policy_number", "reason", "role", "severity", "status", "type"]
TEXT_PROPS = {
    "Policyholder": ["name", "risk_score"],
    "Policy": ["policy_number", "type", "status", "premium", "deductible", "start_date", "end_date"],
    "Claim": ["claim_number", "status", "amount", "date", "cause"],
    "FraudFlag": ["severity", "confidence", "reason", "created_by"],
    "Endorsement": ["endorsement_number", "type", "effective_date", "premium_adjustment"],
    "Investigator": ["name", "role", "email"],
    "Coverage": ["code", "category", "limit", "deductible"],
}
KINDS = {"Policyholder": "policyholder", "Policy": "insurance policy", "Claim": "insurance claim", "FraudFlag": "fraud flag", "Endorsement": "policy endorsement", "Investigator": "claims investigator", "Coverage": "coverage"}
SEEDS = 5
GRAM = 4
SHIFTS = (32, 24, 16, 8, 0, -8, -16)
#: One row in so many tells, by a digest, from which id on a row is hopeless.
PROBE = 256


def _first(rows: DataFrame, key: list[str], order: list[Column], most: int, given: str = "id") -> DataFrame:
    """The ``most`` first distinct rows of each key by ``order``; ``given`` names what digests deal out.

    Any rows of a key bound its answer: what comes after the last of their ``most`` first cannot be among the first of all.  So a part of
    the rows gives a bound, and only rows up to it are sorted; a key with fewer rows in that part has no bound and keeps all.
    """
    place = F.struct(*order)
    nth = F.dense_rank().over(Window.partitionBy(*key).orderBy("place"))
    rows = rows.withColumn("place", place)
    some = rows.filter(F.pmod(F.xxhash64(given), F.lit(PROBE)) == 0)
    bound = graph._cut(some.withColumn("n", nth).filter(F.col("n") == most).select(*key, F.col("place").alias("last")).distinct())
    rows = rows.join(bound, key, "left").filter(F.col("last").isNull() | (F.col("place") <= F.col("last"))).drop("last")
    return rows.withColumn("n", nth).filter(F.col("n") <= most).drop("n", "place").distinct()


def id_seeds(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    named = questions.select("qid", F.explode(T.seed_ids(F.col("query"))).alias("id"))
    # stored, so that few ids are seen to be few and the nodes meet them before anything of the nodes is shuffled
    named = graph._cut(named)
    known = nodes.select("id").join(named.select("id").distinct(), "id", "left_semi").distinct()
    return named.join(known, "id", "left_semi").select("qid", "id")


def keyword_hits(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``qid, id, hits``: (token, property) pairs whose value contains the singular token.

    A token is letters only, so it lies within one run of letters.  The distinct runs of all values
    meet the tokens in equi joins on a token's first letters (up to four); values then meet tokens by run.
    """
    tokens = questions.select("qid", F.explode(T.value_tokens(F.col("query"))).alias("tok")).select("qid", T.singular(F.col("tok")).alias("tok"))
    values = nodes.select("label", "id", F.explode("props").alias("k", "v")).filter(F.col("k").isin(KEYWORD_PROPS))
    runs = values.select("label", "id", "k", F.explode(F.array_distinct(T.words(F.col("v")))).alias("run"))
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring("run", i, n))))
    grams = runs.select("run").distinct().select("run", F.explode(F.array_distinct(starts)).alias("gram"))
    wanted = tokens.select("tok").distinct().select("tok", F.substring("tok", 1, GRAM).alias("gram"))
    # stored, so that the values meet what is asked for before anything of them is shuffled
    pairs = graph._cut(wanted.join(grams, "gram").filter(F.contains("run", "tok")).select("tok", "run").distinct())
    met = runs.join(pairs, "run").select("label", "id", "k", "tok").distinct()
    return met.join(tokens, "tok").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("hits"))


def keyword_seeds(questions: DataFrame, nodes: DataFrame, most: int = SEEDS) -> DataFrame:
    # questions of the same words are searched once
    words = F.array_join(F.sort_array(F.transform(T.value_tokens(F.col("query")), T.singular)), " ")
    asked = graph._cut(questions.select("qid", "query", words.alias("words")))
    once = asked.groupBy(F.col("words").alias("qid")).agg(F.min("query").alias("query"))
    best = _first(graph._cut(keyword_hits(once, nodes)), ["qid"], [-F.col("hits"), F.col("id")], most)
    return asked.select("qid", "words").join(best.withColumnRenamed("qid", "words"), "words").select("qid", "id", "hits")


def _cells(v: Column) -> Column:
    """``level, parent, cell`` of a number in grids that are 256 times finer from level to level.

    Cells keep the order of numbers.  Far numbers share the outermost cells, close ones the innermost.
    """
    near = F.greatest(F.least(v.cast("double"), F.lit(2.0**40)), F.lit(-(2.0**40)))
    cell = lambda shift: F.floor(near * 2.0**-shift)
    parents = [F.lit(0).cast("bigint"), *[cell(s) for s in SHIFTS]]
    return F.array(*[F.struct(F.lit(n).alias("level"), parents[n].alias("parent"), cell(s).alias("cell")) for n, s in enumerate(SHIFTS)])


def smallest_past(values: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """``label, k, dir, t, id``: the ``most`` smallest ids of the values (``label, k, id, v``) on a threshold's side.

    ``wanted``: ``label, k, dir, t``; 1 asks for ``v >= t``, -1 for ``v <= t``, 0 for ``v = t``.  Each cell
    keeps its smallest ids only, and a threshold reads the cells beside its own under the same parent,
    level by level; single values are compared in its innermost cell alone.  No pair of a threshold
    with all values is made.
    """
    at = ["label", "k", "level", "parent"]
    # stored, so that the values meet the thresholds before anything of them is shuffled
    values, wanted = values.filter("v is not null"), graph._cut(wanted.filter("t is not null").distinct())
    equal = wanted.filter("dir = 0").join(values, (wanted.label == values.label) & (wanted.k == values.k) & (wanted.t.cast("double") == values.v)).select(wanted.label, wanted.k, "dir", "t", "id")
    sides = wanted.filter("dir <> 0").select("*", F.explode(_cells(F.col("t"))).alias("c")).select("label", "k", "dir", "t", "c.*")
    placed = values.select("label", "k", "id", "v", F.explode(_cells(F.col("v"))).alias("c")).select("label", "k", "id", "v", "c.*")
    placed = placed.join(graph._cut(sides.select(*at).distinct()), at, "left_semi")
    best = _first(placed.select(*at, "cell", "id"), [*at, "cell"], [F.col("id")], most)
    beside = sides.join(best.withColumnRenamed("cell", "other"), at).filter((F.col("other") - F.col("cell")) * F.col("dir") > 0)
    inner = len(SHIFTS) - 1
    mine = sides.filter(F.col("level") == inner).join(placed.filter(F.col("level") == inner), [*at, "cell"]).filter((F.col("v") == F.col("t")) | ((F.col("v") > F.col("t")) == (F.col("dir") > 0)))
    key = ["label", "k", "dir", "t"]
    # stored, since it is read twice
    every = graph._cut(equal.union(beside.select(*key, "id")).union(mine.select(*key, "id")))
    return _first(every, key, [F.col("id")], most)


def numeric_seeds(questions: DataFrame, nodes: DataFrame, most: int = SEEDS, open_end: bool = False) -> DataFrame:
    """``qid, id``: nodes past a question's threshold in the properties that it focuses on.

    Without a word of direction values must equal the number; with ``open_end`` they may exceed it.
    Questions with the same property, direction and threshold are searched once.
    """
    q = questions.select("qid", T.numeric_tokens(F.col("query")).alias("nums"), T.direction(F.col("query")).alias("dir"), T.focus(F.col("query")).alias("focus")).filter(F.size("nums") > 0)
    every = F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(lab).alias("label")) for p, lab in T.NUMERIC_PROPS])
    q = q.select("qid", "dir", F.when(F.col("dir") >= 0, F.array_max("nums")).otherwise(F.array_min("nums")).alias("t"), F.explode(F.coalesce("focus", every)).alias("f"))
    side = F.when(F.col("dir") == 0, 1).otherwise(F.col("dir")) if open_end else F.col("dir")
    q = q.select("qid", side.alias("dir"), "t", F.col("f.prop").alias("k"), F.col("f.label").alias("label"))
    values = nodes.select("label", "id", F.explode("nums").alias("k", "v"))
    key = ["label", "k", "dir", "t"]
    found = q.join(smallest_past(values, q.select(*key), most), key).select("qid", "id")
    return found.withColumn("n", F.dense_rank().over(Window.partitionBy("qid").orderBy("id"))).filter(F.col("n") <= most).drop("n").distinct()


def neighbourhood_seeds(questions: DataFrame, by_id: DataFrame, found: DataFrame, most: int = SEEDS) -> DataFrame:
    """``qid, id, kind``: nodes around a question's ids that its words and numbers point to.

    ``found``: ``qid, id, label, props, nums``.  A node's hits are the question's words in its values
    and its numbers past the threshold.  The best ``most`` are chosen before the ids themselves go.
    """
    every = F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(lab).alias("label")) for p, lab in T.NUMERIC_PROPS])
    query = F.col("query")
    q = questions.join(by_id.select("qid").distinct(), "qid", "left_semi")
    q = q.select("qid", F.transform(T.value_tokens(query), T.singular).alias("toks"), F.filter(T.numeric_tokens(query), lambda x: x.isNotNull()).alias("numbers"), T.direction(query).alias("dir"), F.coalesce(T.focus(query), every).alias("pairs"))
    text = F.lower(F.concat_ws(" ", F.map_values("props"), F.transform(F.map_values("nums"), T.plain_number)))
    rows = found.select("qid", "id", F.col("label").alias("own"), "nums", text.alias("body")).join(q, "qid")

    def past(p):
        v = F.try_element_at("nums", p["prop"])
        over = F.when(F.col("dir") > 0, v >= F.array_max("numbers")).when(F.col("dir") < 0, v <= F.array_min("numbers")).otherwise(F.array_contains("numbers", v.cast("bigint")))
        return (p["label"] == F.col("own")) & v.isNotNull() & F.coalesce(over, F.lit(False))

    hits = F.size(F.filter("toks", lambda t: F.contains(F.col("body"), t))) + F.when(F.size("numbers") > 0, F.size(F.filter("pairs", past))).otherwise(0)
    rows = rows.select("qid", "id", hits.alias("hits")).filter("hits > 0")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "id"))).filter(F.col("n") <= most)
    return best.join(by_id.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit("keyword").alias("kind"))


def seeds(questions: DataFrame, nodes: DataFrame, fallthrough: bool = False) -> DataFrame:
    """``qid, id, kind``.  Ids that a question names rule; a question without any is searched.

    A question whose ids all don't exist has no seeds, unless ``fallthrough`` lets it be searched.
    """
    by_id = id_seeds(questions, nodes)
    if fallthrough:
        rest = questions.join(by_id.select("qid").distinct(), "qid", "left_anti")
    else:
        rest = questions.filter(F.size(T.seed_ids(F.col("query"))) == 0)
        # the questions alone tell whether the nodes need be searched at all
        if rest.isEmpty():
            return by_id.distinct().select("qid", "id", F.lit("id").alias("kind"))
    found = keyword_seeds(rest, nodes).select("qid", "id", F.lit(1).alias("o")).union(numeric_seeds(rest, nodes, open_end=fallthrough).select("qid", "id", F.lit(2).alias("o")))
    every = by_id.select("qid", "id", F.lit(0).alias("o")).union(found)
    every = every.groupBy("qid", "id").agg(F.min("o").alias("o"))
    return every.select("qid", "id", F.element_at(F.array(F.lit("id"), F.lit("keyword"), F.lit("numeric")), F.col("o") + 1).alias("kind"))


def node_text(label: Column, id_: Column, props: Column, nums: Column) -> Column:
    """``[Label] id kind; k=v; ...``: leading properties in their order, then the others by name."""
    value = lambda k: F.coalesce(props[k], T.plain_number(nums[k]))
    out = F.when(F.lit(False), F.lit(""))
    for lab, lead in TEXT_PROPS.items():
        first = F.array_compact(F.array(*[F.when(value(k).isNotNull(), F.concat(F.lit(f"{k}="), value(k))) for k in lead]))
        rest = F.array_sort(F.array_except(F.array_union(F.map_keys(props), F.map_keys(nums)), F.array(*[F.lit(k) for k in lead])))
        more = F.filter(F.transform(rest, lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(props, k), T.plain_number(F.element_at(nums, k))))), lambda s: s.isNotNull())
        out = out.when(label == lab, F.concat_ws("; ", F.concat(F.lit(f"[{lab}] "), id_, F.lit(f" {KINDS[lab]}")), first, more))
    return out.otherwise(F.concat(F.lit("["), label, F.lit("] "), id_))
